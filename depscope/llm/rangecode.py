"""Token ids as compressed files: an adaptive context-mixing range coder.

The ids of a frame lie in blocks of up to BLOCK ids, each with a payload and a checksum of
its own; all blocks of a frame share one model, fresh for each frame, and are decoded together.
numpy codes them in step, one id of each at a time. An id goes by a number, given when it
has come in the frame. Three predictions of the next id are mixed into the one distribution that the coder uses:
order 2 and order 1 each give all their mass to the id that followed their context most
often so far; order 0 gives each id its count, and a share to those without a number. The weights
of the three are kept for each pair of trusts (how often the guess of a context was right)
and move to the shares that the predictions had in the probabilities of the ids coded last.
An id without a number takes its escape in that distribution, and then one of equal
intervals over all ids of the frame. So encoder and decoder take one arithmetic step for an id, and
a second for a new one.

Counts, guesses and weights are learnt anew from all ids of the frame that are coded after
1, 4, 16, 64 and 256 steps (more often with few blocks), and stay as they are between: the
encoder predicts many steps at once, the decoder by looking up three tables. Sums are of whole
numbers or taken in one order, so that both learn the same.

A file is a Parquet table of frames (one row: whole documents, their ids in
blocks), in ascending order of document ids over the files part-00000, part-00001, ...
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depscope.llm.arrow import free, gathered, keyed_texts, real_id, released, text_bytes
from depscope.llm.store import shared_dir

BLOCK = 1024
#: Bytes of text whose ids are coded in step, and of text in a file.
FRAME_BYTES, FILE_BYTES = 12 << 20, 48 << 20
#: Bits of the mixed distribution, of the table of order-2 contexts, of the trust in a guess (0: there is none).
MIXED, PAIRS, TRUST = 28, 17, 3
LEVELS = 1 << TRUST
#: Ids of a frame that get numbers, the first ones; others are spelt each time.
NUMBERED = 1 << 18
#: The model is learnt anew when the steps have grown fourfold; with fewer than 3 * LEARN blocks, when by one in LEARN of the ids coded.
LEARN = 512
#: Steps of a stretch from which weights are learnt.
WEIGHED = 16
#: Elements that numpy handles at once where rows need not go one by one.
CHUNK = 1 << 14
_M32, _32, _MIXED = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(MIXED)


def _pair(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Place of the context (two, one) in the table of order 2."""
    return (one.astype(np.uint32) * np.uint32(0x9E3779B1) + two.astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - PAIRS)


def _guesses(context: np.ndarray, number: np.ndarray, contexts: int, numbers: int) -> np.ndarray:
    """For each context the number that followed most often (of several, the largest) << TRUST | how far it is to be trusted."""
    kind = np.int32 if contexts * numbers < 1 << 31 else np.int64
    key = context.astype(kind) * kind(numbers) + number.astype(kind, copy=False)
    key.sort()
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    many = np.diff(np.append(head, len(key)))
    of, symbol = np.divmod(key[head].astype(np.int64), numbers)
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    best = np.maximum.reduceat(np.where(symbol > 0, many, 0) << 20 | symbol, first)
    total, many = np.add.reduceat(many, first), best >> 20
    trust = np.where(many > 0, 1 + (LEVELS - 1) * (2 * many - 1) // (2 * total + 2), 0)
    table = np.zeros(contexts, np.int64)
    table[of[first]] = np.where(many > 0, (best & (1 << 20) - 1) << TRUST, 0) | trust
    return table


class _Model:
    """What is known of a frame so far; the encoder and the decoder drive it alike.

    rows[t + 2] has the numbers of the ids at step t, a block a column; 0 stands for an id
    without a number and for what is before a block.
    """

    def __init__(self, blocks: int, symbols: int):
        self.rows = np.zeros((symbols + 2, blocks), np.int32)
        self.names = np.zeros(1, np.int64)  # ids by number
        self.count = np.zeros(1, np.int64)
        two, one = np.divmod(np.arange(LEVELS * LEVELS), LEVELS)
        p2, p1 = (np.maximum(x - 0.5, 0) / (LEVELS - 1) for x in (two, one))
        self.shares = 8 * np.stack([(1 - 0.9 * p2) * (1 - 0.8 * p1), (1 - 0.9 * p2) * 0.8 * p1, 0.9 * p2])
        self.one, self.two = np.zeros(1, np.int64), np.zeros(1 << PAIRS, np.int64)
        self._order_0(1, 1)
        self._weigh()

    def until(self, step: int) -> int:
        """The step before which the model stays as it is."""
        blocks = self.rows.shape[1]
        return min(step + max(1, min(3 * step, step * blocks // LEARN)), len(self.rows) - 2)

    def _order_0(self, new: int, coded: int) -> None:
        """Counts as a cumulative line of 2 ** bits places; the first of them are the escape's, by the share of new ids in those coded last."""
        known = len(self.names) - 1
        self.bits = min(max(16, known.bit_length() + 5), 20)
        line = 1 << self.bits
        escape = min(max(line * (new + 1) // (2 * coded + 2), 1), line // 2) if known else line
        ends = np.cumsum(self.count[1:])
        ends = escape + np.arange(1, known + 1) + ends * (line - escape - known) // max(int(self.count[1:].sum()), 1)
        self.start = np.concatenate([[0, escape], ends])
        self.size = np.diff(self.start)
        self.at: np.ndarray | None = None

    def _weigh(self) -> None:
        """Whole weights of the orders for each pair of trusts; order 0 keeps at least two."""
        top = 1 << MIXED - self.bits
        part = ((top - 2) * self.shares[1:] / self.shares.sum(axis=0)).astype(np.int64)
        self.rest = top - part[0] - part[1]
        self.mass1, self.mass2 = part << self.bits

    def predict(self, one: np.ndarray, two: np.ndarray) -> None:
        """The distribution after the numbers one and, before them, two."""
        e1, e2 = self.one.take(one), self.two.take(_pair(one, two))
        self.pair = (e2 & LEVELS - 1) << TRUST | e1 & LEVELS - 1
        self.g1, self.g2 = e1 >> TRUST, e2 >> TRUST
        self.w0, self.m1, self.m2 = self.rest.take(self.pair), self.mass1.take(self.pair), self.mass2.take(self.pair)

    def interval(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each number in the mixed distribution."""
        start = self.w0 * self.start.take(number) + self.m1 * (self.g1 < number) + self.m2 * (self.g2 < number)
        return start, self.w0 * self.size.take(number) + self.m1 * (self.g1 == number) + self.m2 * (self.g2 == number)

    def find(self, t: np.ndarray) -> np.ndarray:
        """The number in whose interval t lies: the guesses' masses are taken out of t, order 0 says the rest."""
        if self.at is None:
            self.at = np.repeat(np.arange(len(self.size)), self.size)
        first = self.g2 <= self.g1
        inside2 = t - self.w0 * self.start.take(self.g2) - self.m1 * ~first
        inside1 = t - self.w0 * self.start.take(self.g1) - self.m2 * first
        left = t - np.minimum(np.maximum(inside2, 0), self.m2) - np.minimum(np.maximum(inside1, 0), self.m1)
        return self.at.take((left / self.w0).astype(np.int64))  # whole numbers under 2 ** 53

    def learn(self, a: int, b: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Steps a to b are coded; at: their places (of all in these rows) without a number, values: the ids there. Returns the ids that get numbers."""
        self.shares *= 0.5
        for t in range(a, b, max(1, (b - a) // WEIGHED)):  # row by row, so that sums are the same everywhere
            number = self.rows[t + 2]
            self.predict(self.rows[t + 1], self.rows[t])
            size = self.interval(number)[1]
            for k, got in enumerate((self.w0 * self.size.take(number), self.m1 * (self.g1 == number), self.m2 * (self.g2 == number))):
                self.shares[k] += np.bincount(self.pair, got / size, LEVELS * LEVELS)
        fresh, of = np.unique(values, return_inverse=True)
        fresh = fresh[: NUMBERED - len(self.names)]
        coded = self.rows[a + 2 : b + 2].reshape(-1)
        coded[at] = np.where(of < len(fresh), len(self.names) + of, 0)
        self.names = np.concatenate([self.names, fresh])
        numbers = len(self.names)
        self.count = np.append(self.count, np.zeros(len(fresh), np.int64)) + np.bincount(coded, minlength=numbers)
        if b < len(self.rows) - 2:
            self._order_0(len(at), len(coded))
            self._weigh()
            two, one, number = (self.rows[k : b + k].reshape(-1) for k in range(3))
            self.one = _guesses(one, number, numbers, numbers)
            self.one[0] = 0
            self.two = _guesses(_pair(one, two), number, 1 << PAIRS, numbers)
        return fresh


class _Encoder:
    """Arithmetic coding of many blocks with 64 bits of state; words of 32 bits go out, a later carry is added to them."""

    def __init__(self, blocks: int, symbols: int):
        self.low, self.range = np.zeros(blocks, np.uint64), np.full(blocks, 2**64 - 1, np.uint64)
        room, self.used = blocks * (3 * symbols + 4), 0
        self.words, self.lanes, self.link = np.empty(room, "<u4"), np.empty(room, np.uint16 if blocks <= 1 << 16 else np.int32), np.empty(room, np.int64)
        self.last = np.full(blocks, -1)  # where each block's last word is; link: the one before

    def _put(self, lanes: np.ndarray, word: np.ndarray) -> None:
        here = slice(self.used, self.used + len(lanes))
        self.words[here], self.lanes[here], self.link[here] = word, lanes, self.last[lanes]
        self.last[lanes] = np.arange(here.start, here.stop)
        self.used = here.stop

    def _carry(self, lanes: np.ndarray) -> None:
        at = self.last[lanes]
        while len(at):
            self.words[at] += np.uint32(1)
            at = self.link[at[self.words[at] == 0]]

    def _settle(self, low: np.ndarray, lanes: np.ndarray | None = None) -> None:
        """low: the new lower ends (of lanes); blocks with under 32 bits of range give a word."""
        before = self.low if lanes is None else self.low[lanes]
        over = np.flatnonzero(low < before)
        if len(over):
            self._carry(over if lanes is None else lanes[over])
        if lanes is None:
            self.low = low
        else:
            self.low[lanes] = low
        on = np.flatnonzero(self.range <= _M32)
        low = self.low[on]
        self._put(on, low >> _32)
        self.low[on] = low << _32
        self.range[on] <<= _32

    def put(self, start: np.ndarray, size: np.ndarray) -> None:
        r = self.range >> _MIXED
        self.range = r * size.view(np.uint64)
        self._settle(self.low + r * start.view(np.uint64))

    def put_even(self, lanes: np.ndarray, value: np.ndarray, top: int) -> None:
        """value of each of the lanes, all below top alike."""
        r = self.range[lanes] // np.uint64(top)
        self.range[lanes] = r
        self._settle(self.low[lanes] + r * value.astype(np.uint64), lanes)

    def end(self) -> list[bytes]:
        low = self.low + _M32  # zeros follow the last word
        self._carry(np.flatnonzero(low < self.low))
        self._put(np.arange(len(low)), low >> _32)
        by = np.argsort(self.lanes[: self.used], kind="stable")
        words = self.words[: self.used][by].tobytes()
        cuts = (4 * np.cumsum(np.bincount(self.lanes[: self.used], minlength=len(low)))).tolist()
        return [words[s:t] for s, t in zip([0, *cuts[:-1]], cuts, strict=True)]


class _Decoder:
    def __init__(self, payloads: list[bytes]):
        self.words = np.frombuffer(b"".join(p[: len(p) // 4 * 4] + bytes(16) for p in payloads), "<u4")
        size = np.array([len(p) // 4 + 4 for p in payloads])
        self.next = np.cumsum(size) - size
        self.range = np.full(len(payloads), 2**64 - 1, np.uint64)
        self.ahead = self.words[self.next].astype(np.uint64) << _32 | self.words[self.next + 1]  # above the lower end
        self.next += 2

    def _settle(self) -> None:
        on = np.flatnonzero(self.range <= _M32)
        self.range[on] <<= _32
        at = self.next[on]
        self.ahead[on] = self.ahead[on] << _32 | self.words.take(at, mode="clip")
        self.next[on] = at + 1

    def peek(self) -> np.ndarray:
        self.unit = self.range >> _MIXED
        return np.minimum(self.ahead // self.unit, np.uint64((1 << MIXED) - 1)).view(np.int64)

    def take(self, start: np.ndarray, size: np.ndarray) -> None:
        self.ahead -= self.unit * start.view(np.uint64)
        self.range = self.unit * size.view(np.uint64)
        self._settle()

    def take_even(self, lanes: np.ndarray, top: int) -> np.ndarray:
        r = self.range[lanes] // np.uint64(top)
        ahead = self.ahead[lanes]
        value = np.minimum(ahead // r, np.uint64(top - 1))
        self.ahead[lanes], self.range[lanes] = ahead - r * value, r
        self._settle()
        return value.view(np.int64)


def _digits(top: int) -> list[tuple[int, int]]:
    """(shift, values) of the parts in which an id below top is spelt: 16 bits at most."""
    return [(0, top)] if top <= 1 << 16 else [(16, (top - 1 >> 16) + 1), (0, 1 << 16)]


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[int, list[bytes], list[int]]:
    """Number below which the ids are, the payload of each block, its crc32. The last block is filled up with zeros; a block holds block ids at most."""
    n = len(ids)
    top = int(ids.max()) + 1 if n else 1
    if not n:
        return top, [], []
    sums = [zlib.crc32(ids[a : a + block].astype("<u4").tobytes()) for a in range(0, n, block)]
    blocks, symbols = len(sums), min(block, n)
    grid = np.zeros(blocks * symbols, np.uint32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(blocks, symbols).T)
    distinct, code = None, grid
    if top > 1 << 20:
        distinct, code = np.unique(grid, return_inverse=True)
        code = code.reshape(grid.shape)
    number = np.zeros(top if distinct is None else len(distinct), np.int32)  # by code
    model, coder = _Model(blocks, symbols), _Encoder(blocks, symbols)
    a, many = 0, max(1, CHUNK // blocks)
    while a < symbols:
        b = model.until(a)
        rows = model.rows[a + 2 : b + 2]
        np.take(number, code[a:b], out=rows)
        for c in range(a, b, many):
            d = min(c + many, b)
            model.predict(model.rows[c + 1 : d + 1].reshape(-1), model.rows[c:d].reshape(-1))
            start, size = (x.reshape(-1, blocks) for x in model.interval(model.rows[c + 2 : d + 2].reshape(-1)))
            for t in range(c, d):
                coder.put(start[t - c], size[t - c])
                lanes = np.flatnonzero(model.rows[t + 2] == 0)
                for shift, values in _digits(top) if len(lanes) else ():
                    coder.put_even(lanes, grid[t, lanes] >> shift & 0xFFFF if top > 1 << 16 else grid[t, lanes], values)
        at = np.flatnonzero(rows.reshape(-1) == 0)
        fresh = model.learn(a, b, at, grid[a:b].reshape(-1)[at].astype(np.int64))
        number[fresh if distinct is None else np.searchsorted(distinct, fresh)] = np.arange(len(model.names) - len(fresh), len(model.names))
        a = b
    return top, coder.end(), sums


def decode_blocks(n: int, top: int, payloads: list[bytes], sums: list[int], block: int = BLOCK) -> np.ndarray:
    """The n ids; a block whose checksum differs is an error."""
    if not payloads:
        return np.zeros(0, "<u4")
    blocks, symbols = len(payloads), min(block, n)
    grid = np.zeros((symbols, blocks), "<u4")
    model, coder = _Model(blocks, symbols), _Decoder(payloads)
    a = 0
    while a < symbols:
        b = model.until(a)
        spelt = [np.zeros((2, 0), np.int64)]
        for t in range(a, b):
            model.predict(model.rows[t + 1], model.rows[t])
            number = model.find(coder.peek())
            coder.take(*model.interval(number))
            model.rows[t + 2] = number
            lanes = np.flatnonzero(number == 0)
            if len(lanes):
                value = np.zeros(len(lanes), np.int64)
                for shift, values in _digits(top):
                    value |= coder.take_even(lanes, values) << shift
                spelt.append(np.stack([lanes + (t - a) * blocks, value]))
        at, values = np.concatenate(spelt, axis=1)
        part = grid[a:b].reshape(-1)
        part[:] = model.names.take(model.rows[a + 2 : b + 2].reshape(-1))
        part[at] = values
        model.learn(a, b, at, values)
        a = b
    ids = grid.T.reshape(-1)[:n]
    for k, want in enumerate(sums):
        if zlib.crc32(ids[k * block : (k + 1) * block].tobytes()) != want:
            raise ValueError(f"block {k} does not match its checksum")
    return ids


FRAME = "part int, frame int, first long, n_ids long, top long, doc_ids array<bigint>, doc_sizes array<bigint>, sizes array<int>, sums array<bigint>, payload binary"


def write_ids(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Files of frames under path, documents by ascending id (ties by text hash); each document ends with end_id.

    Null texts count as empty and give end_id alone; a null id comes first;
    repeated rows are written as often as they stand. An empty table gives files without frames.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from depscope.llm.tok import cached_tokenizer

        encoder, part, frame, first = cached_tokenizer(tokenizer), TaskContext.get().partitionId(), 0, 0
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 2, pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
        names = [f.split(" ")[0] for f in FRAME.split(", ")]
        for c in gathered(batches, FRAME_BYTES):
            ids, at = encoder.encode_column(c.column("text"), end_id)
            top, payloads, sums = encode_blocks(ids)
            row = (part, frame, first, len(ids), top, c.column("id"), np.diff(at), [len(p) for p in payloads], sums, b"".join(payloads))
            frame, first = frame + 1, first + len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    files = 1 + text_bytes(docs, text_col) // FILE_BYTES
    rows = keyed_texts(docs, id_col, text_col).repartitionByRange(files, "id", "tk").sortWithinPartitions("id", "tk")
    rows.mapInArrow(released(run), FRAME).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids) of each document in the files; start: ids of all documents before it.

    digest: ids_crc32 in place of ids, taken where the ids are decoded, so that they never leave the task.
    """
    frames = spark.read.schema(FRAME).parquet(path)
    ends = frames.select("part", (F.col("first") + F.col("n_ids")).alias("n")).groupBy("part").agg(F.max("n").alias("n"))
    # one row for each file
    base = ends.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = {n: b.column(n)[k].as_py() for n in b.schema.names}
                cuts = np.append(0, np.cumsum(r["sizes"])).tolist()
                payloads = [r["payload"][s:t] for s, t in zip(cuts[:-1], cuts[1:], strict=True)]
                ids = decode_blocks(r["n_ids"], r["top"], payloads, r["sums"])
                sizes = np.array(r["doc_sizes"], np.int64)
                ends = np.cumsum(sizes)
                start = pa.array(r["base"] + r["first"] + ends - sizes)
                if digest:
                    last = pa.array([zlib.crc32(ids[s:t]) for s, t in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), start, pa.array(sizes), last], ["id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
            free()

    placed = frames.join(base, "part").select("first", "base", "n_ids", "top", "doc_ids", "doc_sizes", "sizes", "sums", "payload")
    return placed.mapInArrow(released(run), "id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<bigint>"))


def id_columns(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from files written for docs."""
    path = f"{shared_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer, id_col, text_col)
    return read_ids(docs.sparkSession, path, digest=True).select(real_id().alias("doc_id"), "start", "n_tokens", "ids_crc32")
