"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is a chunk of an Arrow batch. Its words become symbols; a word that no
benchmark text has ends a run, and runs shorter than the shortest window can't
hold one, so only the others are indexed: suffix array by prefix doubling,
Burrows-Wheeler transform, wavelet matrix, every SAMPLE-th suffix position. All windows are
searched backward at once, their rows are located by walking to a sampled
position, and the word spans found are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depscope.llm.arrow import ITEM_WORD, LOWER_AZ, NULL_ID, chunks, gathered, interned, keyed_texts, long_id, real_id, released, text_buffer, word_spans

WINDOW = 10
SAMPLE = 8
#: Bytes of text in a shard.
SHARD_BYTES = 4 << 20
#: Bytes of benchmark text that go to the tasks at a time; a larger benchmark takes more passes.
BENCH_BYTES = 32 << 20


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of s, whose last symbol is its only smallest one."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth, todo = 1, np.arange(n)
    while True:
        alone = new & np.append(new[1:], True)
        todo, p = todo[~alone], order[todo[~alone]]
        if not len(todo):
            return order
        key = rank[p] * n + rank[p + depth]
        by = np.argsort(key)
        p, key = p[by], key[by]
        order[todo] = p
        new = np.ones(len(p), bool)
        new[1:] = key[1:] != key[:-1]
        rank[p] = todo[np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))]
        depth *= 2


class Bits:
    """Bit vector with constant-time counts of the ones before a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class FmIndex:
    def __init__(self, s: np.ndarray):
        n = len(s)
        sa = suffix_array(s)
        self.bwt = s[sa - 1]
        top = int(s.max())
        self.starts = np.searchsorted(s[sa], np.arange(top + 2))
        self.levels: list[tuple[int, Bits]] = []
        row = self.bwt
        for bit in reversed(range(max(1, top.bit_length()))):
            b = (row >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(b)))
            row = np.concatenate([row[~b], row[b]])
        sampled = sa % SAMPLE == 0
        self.sampled, self.positions = Bits(sampled), sa[sampled]
        self.is_sampled = sampled
        self.n = n

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c is among the first i symbols of the transform."""
        lo, hi = np.zeros_like(i), i
        for bit, bits in self.levels:
            one = (c >> bit & 1).astype(bool)
            a, b = bits.ones(lo), bits.ones(hi)
            lo, hi = np.where(one, bits.zeros + a, lo - a), np.where(one, bits.zeros + b, hi - b)
        return hi - lo

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 row of the suffixes that begin with patterns[k, :sizes[k]]."""
        lo, hi = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n, np.int64)
        for back in range(1, patterns.shape[1] + 1):
            on = np.flatnonzero((sizes >= back) & (lo < hi))
            if not len(on):
                break
            c = patterns[on, sizes[on] - back]
            lo[on], hi[on] = self.starts[c] + self.rank(c, lo[on]), self.starts[c] + self.rank(c, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        on = np.flatnonzero(~self.is_sampled[rows])
        while len(on):
            c = self.bwt[rows[on]]
            rows[on] = self.starts[c] + self.rank(c, rows[on])
            steps[on] += 1
            on = on[~self.is_sampled[rows[on]]]
        return self.positions[self.sampled.ones(rows)] + steps


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray, int]:
    """Number of each word among the distinct ones, those, byte start, byte end and text number of each word, and the number of texts."""
    buf, off = text_buffer(texts)
    buf = LOWER_AZ[buf]
    starts, ends, of = word_spans(buf, off, ITEM_WORD)
    code, distinct = interned(buf, starts, ends)
    return code, distinct, starts - off[of], ends - off[of], of, len(texts)


class Windows:
    """Distinct windows of the items, as rows of numbers of words, and the items that have them. Words are the same if their bytes are."""

    def __init__(self, items: list[str], texts: list[str], n: int):
        h, self.vocabulary, _, _, of, _ = _words(pa.array(texts, pa.string()))
        self.items, self.n = items, n
        count = np.bincount(of, minlength=len(items)) if len(items) else np.zeros(0, np.int64)
        first = np.cumsum(count) - count
        many = np.maximum(count - n + 1, (count > 0).astype(np.int64))
        item = np.repeat(np.arange(len(items)), many)
        at = first[item] + np.arange(len(item)) - (np.cumsum(many) - many)[item]
        size = np.minimum(count, n)[item]
        words = np.zeros((len(item), n), np.int64)
        for j in range(n):
            ok = size > j
            words[ok, j] = h[at[ok] + j]
        key = np.concatenate([words, size[:, None]], axis=1)
        distinct, self.window_of = np.unique(key, axis=0, return_inverse=True) if len(key) else (key, np.zeros(0, np.int64))
        self.window_of = self.window_of.reshape(-1)
        self.item_of = item
        self.words, self.sizes = distinct[:, :n], distinct[:, n].astype(np.int64)
        by = np.argsort(self.window_of, kind="stable")
        self.item_list = item[by]
        self.item_start = np.searchsorted(self.window_of[by], np.arange(len(self.sizes) + 1))

    def find(self, code: np.ndarray, distinct: pa.Array, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence in texts whose words are distinct[code], with text numbers of."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(code) or not len(self.sizes):
            return none
        code = pc.fill_null(pc.index_in(distinct, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
        known = code >= 0
        run = np.cumsum(~known | np.append(True, of[1:] != of[:-1]))  # an unknown word begins a run of its own
        length = np.bincount(run[known], minlength=run[-1] + 1)
        at = np.flatnonzero(known & (length[run] >= self.sizes.min()))
        if not len(at):
            return none
        # symbols: 0 ends the text, 1 lies between runs, words from 2 on
        cut = np.append(False, run[at][1:] != run[at][:-1])
        place = np.arange(len(at)) + np.cumsum(cut)
        present, symbol = np.unique(code[at], return_inverse=True)
        s = np.ones(place[-1] + 2, np.int64)
        s[place], s[-1] = symbol + 2, 0
        word_at = np.zeros(len(s), np.int64)
        word_at[place] = at
        # windows whose words are all present
        inside = np.arange(self.n) < self.sizes[:, None]
        sym = np.minimum(np.searchsorted(present, self.words), len(present) - 1)
        ok = ((present[sym] == self.words) | ~inside).all(axis=1)
        which = np.flatnonzero(ok)
        if not len(which):
            return none
        index = FmIndex(s)
        lo, hi = index.search(sym[which] + 2, self.sizes[which])
        many = np.maximum(hi - lo, 0)
        window = np.repeat(np.arange(len(which)), many)
        rows = lo[window] + np.arange(len(window)) - (np.cumsum(many) - many)[window]
        return word_at[index.locate(rows)], which[window]


SCHEMA = "id long, tk long, n_words long, spans array<struct<start:int,end:int>>, bytes array<struct<start:int,end:int>>, items array<string>"


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _pass(rows: DataFrame, items: list[str], texts: list[str], n: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((items, texts))  # BENCH_BYTES at most
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(*shared.value, n)
        for b in gathered(batches, SHARD_BYTES):
            for c in chunks(b, limit=SHARD_BYTES):
                code, distinct, start, end, of, docs = _words(c.column("text"))
                first, window = windows.find(code, distinct, of)
                mark = np.zeros(len(code) + 1, np.int64)
                np.add.at(mark, first, 1)
                np.add.at(mark, first + windows.sizes[window], -1)
                hit = np.cumsum(mark)[:-1] > 0
                doc_from = np.searchsorted(of, np.arange(docs + 1))
                # an item of each occurrence: one row for each (text, item)
                occurring = np.unique(of[first].astype(np.int64) * max(1, len(windows.sizes)) + window)
                d, w = np.divmod(occurring, max(1, len(windows.sizes)))
                found: dict[int, set[str]] = {}
                for k, v in zip(d.tolist(), w.tolist(), strict=True):
                    for i in windows.item_list[windows.item_start[v] : windows.item_start[v + 1]]:
                        found.setdefault(k, set()).add(windows.items[i])
                spans, in_bytes = [], []
                for k in range(docs):
                    a, z = doc_from[k], doc_from[k + 1]
                    if not hit[a:z].any():
                        spans.append([])
                        in_bytes.append([])
                        continue
                    x, y = _runs(hit[a:z])
                    spans.append([{"start": i, "end": j} for i, j in zip(x.tolist(), y.tolist(), strict=True)])
                    in_bytes.append([{"start": i, "end": j} for i, j in zip(start[a + x].tolist(), end[a + y - 1].tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [
                        c.column("id"),
                        c.column("tk"),
                        pa.array(np.diff(doc_from), pa.int64()),
                        pa.array(spans, span),
                        pa.array(in_bytes, span),
                        pa.array([sorted(found.get(k, ())) for k in range(docs)], pa.list_(pa.string())),
                    ],
                    ["id", "tk", "n_words", "spans", "bytes", "items"],
                )

    return rows.mapInArrow(released(run), SCHEMA)


def _merged(spans):
    """Sorted spans without overlap, from an array column of spans."""
    start = F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    zero = F.array(start)

    def add(done, s):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        head = F.slice(done, 1, F.size(done) - 1)
        return F.when(last["end"] >= s["start"], F.concat(head, F.array(joined).cast("array<struct<start:int,end:int>>"))).otherwise(F.concat(done, F.array(s).cast("array<struct<start:int,end:int>>")))

    return F.filter(F.aggregate(F.array_sort(spans), zero, add), lambda s: s["start"].isNotNull())


def find_benchmark(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW
) -> DataFrame:
    """One row for each document: (id, tk, n_words, spans, bytes, items).

    spans are merged runs of hit words (word numbers, end exclusive), bytes the
    same in UTF-8 bytes, items the sorted ids of items with an occurring window.
    Null texts have no words; an item without words has no window; items of one
    id count as one; null item ids are left out. Repeated documents get a row
    each. Empty tables give no rows, or rows without hits. The benchmark goes to
    the tasks in passes of BENCH_BYTES; only a second pass makes a shuffle.
    """
    items = bench.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("t")).filter("item is not null").distinct()
    total = items.agg(F.sum(F.octet_length("t") + F.octet_length("item"))).head()[0] or 0
    passes = max(1, -(-int(total) * 2 // BENCH_BYTES) if total > BENCH_BYTES else 1)
    rows = keyed_texts(docs, id_col, text_col)
    found = []
    for k in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item", "t"), F.lit(passes)) == k).orderBy("item", "t").collect()
        found.append(_pass(rows, [r["item"] for r in part], [r["t"] for r in part], n))
    if passes == 1:
        return found[0]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    # repeated rows meet here; copies says how many there were
    return (
        every.groupBy("id", "tk")
        .agg(
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.flatten(F.collect_list("bytes")).alias("bytes"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            (F.count(F.lit(1)) / passes).cast("int").alias("copies"),
        )
        .select("id", "tk", "n_words", _merged(F.col("spans")).alias("spans"), _merged(F.col("bytes")).alias("bytes"), "items", F.explode(F.sequence(F.lit(1), "copies")))
        .drop("col")
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The documents without a hit word, with all their columns; a null text has none and stays."""
    bad = find_benchmark(docs, bench, id_col, text_col, **more).filter(F.size("spans") > 0).select(F.col("id").alias("__id"), F.col("tk").alias("__tk")).distinct()
    tagged = docs.withColumns({"__id": keyed_id(docs, id_col), "__tk": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    return tagged.join(bad, ["__id", "__tk"], "left_anti").select(*docs.columns)


def keyed_id(docs: DataFrame, id_col: str) -> Column:
    return F.coalesce(long_id(docs, id_col), F.lit(NULL_ID))


def hit_columns(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) from find_benchmark."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return found.select(
        real_id().alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


__all__ = ["FmIndex", "find_benchmark", "drop_contaminated", "hit_columns"]
