"""Chunks of texts as single rows, and an exchange of sorted fingerprints between all chunks.

Operators that must compare every run of words with all others hold the texts in
chunks: one row, some MB of text as a compressed Arrow batch. A chunk asks about
the distinct fingerprints of its runs; they are sent sorted, as differences, to
ranges of fingerprints, and the answer is one value for each, in that order. So a
run costs some two bytes of shuffle, and one of all documents a row a chunk.

Fingerprints are the top bits of 64-bit hashes, as many as the size of the
corpus asks for: see fingerprint_bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depscope.llm.arrow import gathered, released

#: Bytes of text of a chunk, and of all text for each range of fingerprints.
CHUNK, RANGE = 8 << 20, 8 << 20
ASKED = "p long, chunk long, keys binary, more binary"
ANSWER = "chunk long, p long, value binary"
_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")


def fingerprint_bits(total: int) -> int:
    """Bits of a fingerprint for total bytes of text: a run meets one that is not its like with a chance under 1 in 256.

    A run begins at a word, which with its blank takes two bytes at least, so there are under total / 2 runs.
    """
    return min(63, max(32, total.bit_length() + 7))


def ranges(total: int) -> int:
    return 1 + total // RANGE


def to_blob(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_ZSTD) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_blob(data: pa.Scalar) -> pa.RecordBatch:
    with pa.ipc.open_stream(data.as_buffer()) as r:
        return r.read_next_batch()


def chunked(rows: DataFrame, prepare: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """(chunk, data): prepare(batch) of each chunk of rows (which have a column text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, batch in enumerate(gathered(batches, CHUNK)):
            yield pa.RecordBatch.from_arrays([pa.array([part << 20 | k], pa.int64()), pa.array([to_blob(prepare(batch))], pa.binary())], ["chunk", "data"])

    return rows.mapInArrow(released(run), "chunk long, data binary")


def pack(a: np.ndarray) -> bytes:
    """Whole numbers from 0 on: how many bytes each takes, then one plane for each byte place."""
    a = a.astype("<u8")
    size = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    return bytes([size]) + a.view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    size = b[0]
    flat = np.frombuffer(b, np.uint8, offset=1).reshape(size, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :size] = flat.T
    return out.view("<u8").reshape(-1)


def _base(p: int, bits: int, parts: int) -> int:
    """The least fingerprint of range p."""
    return -(-(p << 32) // parts) << bits - 32


def asks(chunk: int, keys: np.ndarray, more: Callable[[int, int], bytes], bits: int, parts: int) -> pa.RecordBatch:
    """A row for each range that has some of the sorted distinct keys; more(s, t) goes along with keys[s:t]."""
    p = ((keys >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    at = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), len(p)] if len(p) else [0]
    spans = list(zip(at[:-1], at[1:], strict=True))
    packed = [pack(np.diff(keys[s:t], prepend=np.uint64(_base(int(p[s]), bits, parts)))) for s, t in spans]
    return pa.RecordBatch.from_arrays(
        [pa.array([int(p[s]) for s, _ in spans], pa.int64()), pa.array([chunk] * len(spans), pa.int64()), pa.array(packed, pa.binary()), pa.array([more(s, t) for s, t in spans], pa.binary())],
        ["p", "chunk", "keys", "more"],
    )


def answered(asked: DataFrame, decide: Callable[[np.ndarray, np.ndarray, list[bytes]], list[bytes]]) -> DataFrame:
    """(chunk, p, value) for each row of asked; decide sees all keys of a range, the row that each is of, and what goes along with the rows.

    A range's keys are differences to its start there: equal keys are all that counts.
    """

    def run(t: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(k)) for k in t.column("keys").to_pylist()]
        row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        values = decide(np.concatenate(keys), row, t.column("more").to_pylist())
        return pa.table([t.column("chunk"), t.column("p"), pa.array(values, pa.binary())], ["chunk", "p", "value"])

    return asked.groupBy("p").applyInArrow(run, ANSWER)


def in_order(answers: pa.Table) -> list[bytes]:
    """The values of a chunk's answers by range, so by key."""
    return answers.sort_by("p").column("value").to_pylist()


def heads(a: np.ndarray) -> np.ndarray:
    """Where a value of the sorted a stands first."""
    return np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)


def corpus(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Rows, and bytes of text."""
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("size")).head()
    return r["n"], r["size"]
