"""Shared helpers of the text operators: column hygiene, Arrow batches, word hashing.

Every operator selects the columns it needs under private names first, so
extra columns of the caller (with whatever names) never clash with ours.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

#: Bytes of text that a vectorised step holds at a time (a longer text is one chunk).
CHUNK_BYTES = 2 << 20
NULL_ID = -(2**63)


def long_id(docs: DataFrame, id_col: str) -> Column:
    """The id column as long. Ids are whole numbers (or a column of nulls); any other type is refused here, before a job begins."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType | NullType):
        raise TypeError(f"{id_col} is {kind.simpleString()}; ids are whole numbers")
    return F.col(id_col).cast("long")


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tk, text): id as given, tk tells rows of one id apart by their text.

    A null text counts as empty, a null id as the smallest long (which is no id of its own then).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.coalesce(long_id(docs, id_col), F.lit(NULL_ID)).alias("id"),
        F.xxhash64(text).alias("tk"),
        text.alias("text"),
    )


def real_id(name: str = "id") -> Column:
    """The id as the caller gave it."""
    return F.when(F.col(name) != NULL_ID, F.col(name))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts, by which the work is dealt out."""
    return docs.agg(F.sum(F.octet_length(text_col))).head()[0] or 0


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def chunks(batch: pa.RecordBatch, col: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most limit bytes of text, or one longer row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def gathered(batches: Iterator[pa.RecordBatch], limit: int, col: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of about limit bytes of text, whole rows, at least one."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for c in chunks(batch, col, max(1, limit // 4)):
            n = pc.sum(pc.binary_length(c.column(col))).as_py() or 0
            if held and size + n > limit:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(c)
            size += n
    if held:
        yield pa.concat_batches(held)


def released(run: Callable) -> Callable:
    """A mapInArrow function that gives its memory back when its task ends: workers live on for other tasks."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            free()

    return freed


def free() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the len + 1 offsets of the texts in them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def word_spans(buf: np.ndarray, off: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, byte end and text number of each run of bytes b with in_word[b]; a text's end ends a run."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    w = in_word[buf]
    prev = np.empty_like(w)
    prev[0], prev[1:] = False, w[:-1]
    prev[off[:-1][off[:-1] < len(buf)]] = False
    starts = np.flatnonzero(w & ~prev)
    prev[:-1], prev[-1] = w[1:], False
    prev[off[1:][off[1:] > 0] - 1] = False
    ends = np.flatnonzero(w & ~prev) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


_P = 0x9E3779B97F4A7C15 | 1
#: Bytes whose spans are hashed together.
_STEP = 256 << 10


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def interned(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Number of each byte span among the distinct ones, and those: equal numbers are equal bytes. Spans ascend and don't overlap."""
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1  # a span may begin where another ends
    held = buf[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    places = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(held)])
    coded = spans.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


#: Spans of more bytes are hashed one by one.
SHORT = 64
_BASES = (_P, 0xD1342543DE82EF95)
#: A random value for each byte, of each of the two hashes.
_BYTES = mix64(np.arange(512, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(0xA0761D6478BD642F)).reshape(2, 256)


@lru_cache(maxsize=2)
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse modulo 2 ** 64, as many as a step needs."""
    out = []
    for p in (base, pow(base, -1, 1 << 64)):
        a = np.full(_STEP + SHORT + 1, p, np.uint64)
        a[0] = 1
        out.append(np.cumprod(a))
    return tuple(out)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: int = 2) -> np.ndarray:
    """Hash of each byte span, the same wherever the bytes stand: rows (1 or 2) of 64 bits. Spans ascend and don't overlap.

    A span of up to SHORT bytes is the sum of its bytes' random values, each times the power of a base that its place has,
    modulo 2 ** 64; such sums know too little of long spans, whose halves may cancel out, so those are hashed by XXH3.
    """
    out = np.empty((rows, len(starts)), np.uint64)
    size = ends - starts
    long = np.flatnonzero(size > SHORT)
    for k in range(rows):
        power, inverse = _powers(_BASES[k])
        at = 0
        while at < len(starts):
            base = starts[at]
            to = max(at + 1, int(np.searchsorted(starts, base + _STEP, side="left")))
            part = buf[base : min(int(ends[to - 1]), int(starts[to - 1]) + SHORT)]
            s = starts[at:to] - base
            e = s + np.minimum(size[at:to], SHORT)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTES[k][part] * power[: len(part)], out=sums[1:])
            out[k, at:to] = mix64((sums[e] - sums[s]) * inverse[s] + size[at:to].astype(np.uint64))
            at = to
    if len(long):
        raw = b"".join(xxhash.xxh3_128_digest(buf[s:e].tobytes()) for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True))
        out[:, long] = np.frombuffer(raw, "<u8").reshape(-1, 2).T[:rows]
    return out


def ngram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of n consecutive 64-bit word hashes (len - n + 1 of them)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    g = words[:m].copy()
    for j in range(1, n):
        g *= np.uint64(_P)
        g += words[j : m + j]
    return mix64(g)


#: Bytes that are not white space \x20 \x09-\x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z and every non-ASCII byte.
ITEM_WORD = np.zeros(256, bool)
ITEM_WORD[0x30:0x3A] = ITEM_WORD[0x61:0x7B] = ITEM_WORD[0x80:] = True
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[0x41:0x5B] += 0x20
