"""Substring dedup with fixed-block anchors.

A run of n words that stands twice holds, in either place, a block of n // 2
words that begins at a multiple of n // 2. So: (1) the blocks of all documents are the
reference index, every rolling window of that length is a probe, and probes that meet a
block elsewhere are anchors; (2) windows of n words around anchors are compared by
128 bits of hash, which extends the anchors to maximal repeats; every window but the
first of its kind is marked. The 128 bits are two hashes of 64, each over its own half of the words'
128-bit hashes.

Both steps use the exchange of blobs.py: documents stay in chunks, of equal windows in a
chunk one is sent, and the answer is a bit for each. So a passage that many documents share
reaches a range once for each chunk. An anchor's fingerprint may meet another by chance;
that makes a candidate more and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depscope.llm.arrow import NOT_SPACE, free, hash_spans, keyed_texts, ngram_hash, real_id, released, text_buffer, word_spans
from depscope.llm.blobs import answered, asks, chunked, corpus, fingerprint_bits, from_blob, heads, in_order, pack, ranges, unpack
from depscope.llm.store import settled

N = 20


class _Chunk:
    """Words of a chunk's texts and their windows."""

    def __init__(self, data: pa.Scalar, n: int):
        self.batch, self.n, self.half = from_blob(data), n, n // 2
        self.buf, self.off = text_buffer(self.batch.column("text"))
        self.starts, self.ends, self.of = word_spans(self.buf, self.off, NOT_SPACE)
        self.hash, self.second = hash_spans(self.buf, self.starts, self.ends)
        self.first = np.searchsorted(self.of, np.arange(self.batch.num_rows + 1))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of size words that lies in one text."""
        g = ngram_hash(self.hash, size)
        at = np.flatnonzero(self.of[: len(g)] == self.of[size - 1 :][: len(g)]) if len(g) else np.zeros(0, np.int64)
        return at, g[at]

    def probes(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word of each half window, sorted by fingerprint; the fingerprints; where a distinct one begins."""
        at, g = self.windows(self.half)
        by = np.argsort(g, kind="stable")
        key = g[by] >> np.uint64(64 - bits)
        return at[by], key, heads(key)

    def candidates(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word of each window that holds an anchor (a mask of words), sorted by hash and place; its two hashes of 64 bits."""
        at, g = self.windows(self.n)
        seen = np.concatenate([[0], np.cumsum(anchors)])
        ok = seen[at + self.n - self.half + 1] > seen[at]
        at, g = at[ok], g[ok]
        other = ngram_hash(self.second, self.n)[at] if len(at) else g
        ids, tks, doc = *_ids(self.batch), self.of[at]
        by = np.lexsort((at - self.first[doc], tks[doc], ids[doc], other, g))
        return at[by], g[by], other[by]


def _ids(c: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return c.column("id").to_numpy(), c.column("tk").to_numpy()


def _bits(a: np.ndarray) -> bytes:
    return np.packbits(a).tobytes()


def _mask(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)


def _anchors(keys: np.ndarray, row: np.ndarray, more: list[bytes]) -> list[bytes]:
    """A bit for each key: whether a block has it, and another window too."""
    many = np.bincount(row, minlength=len(more)).tolist()
    flags = np.concatenate([_mask(m, 2 * k).reshape(2, k) for m, k in zip(more, many, strict=True)], axis=1)  # a block has it; it stands twice in the chunk
    by = np.argsort(keys, kind="stable")
    head = heads(keys[by])
    size = np.diff(np.append(head, len(keys)))
    twice = (size > 1) | np.logical_or.reduceat(flags[1][by], head)
    hit = np.empty(len(keys), bool)
    hit[by] = np.repeat(twice & np.logical_or.reduceat(flags[0][by], head), size)
    cuts = np.searchsorted(row, np.arange(len(more) + 1)).tolist()
    return [_bits(hit[s:t]) for s, t in zip(cuts[:-1], cuts[1:], strict=True)]


def _places(other: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, tks: np.ndarray) -> bytes:
    """What goes along with windows: the rest of their hashes, and where each stands first."""
    own, of = np.unique(doc, return_inverse=True)
    parts = [pack(other), pack(of), pack(pos), ids[own].astype("<i8").tobytes(), tks[own].astype("<i8").tobytes()]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _placed(m: bytes) -> tuple[np.ndarray, ...]:
    parts = []
    while m:
        n = int.from_bytes(m[:4], "little")
        parts.append(m[4 : 4 + n])
        m = m[4 + n :]
    of = unpack(parts[1]).astype(np.int64)
    return unpack(parts[0]), np.frombuffer(parts[3], "<i8")[of], np.frombuffer(parts[4], "<i8")[of], unpack(parts[2]).astype(np.int64)


def _later(keys: np.ndarray, row: np.ndarray, more: list[bytes]) -> list[bytes]:
    """A bit for each window: whether one of its kind stands earlier. A repeated row (same id and text) is its twin."""
    other, ids, tks, pos = (np.concatenate(x) for x in zip(*map(_placed, more), strict=True))
    by = np.lexsort((pos, tks, ids, other, keys))
    first = np.append(True, (keys[by][1:] != keys[by][:-1]) | (other[by][1:] != other[by][:-1]))
    head = by[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
    later = np.empty(len(keys), bool)
    later[by] = (ids[head] != ids[by]) | (tks[head] != tks[by]) | (pos[head] != pos[by])
    cuts = np.searchsorted(row, np.arange(len(more) + 1)).tolist()
    return [_bits(later[s:t]) for s, t in zip(cuts[:-1], cuts[1:], strict=True)]


def _kinds(g: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (other[1:] != other[:-1]))) if len(g) else np.zeros(0, np.int64)


def _answer_bits(answers: pa.Table, sizes: list[int]) -> np.ndarray:
    got = in_order(answers)
    return np.concatenate([_mask(b, n) for b, n in zip(got, sizes, strict=True)]) if got else np.zeros(0, bool)


def _asked_sizes(keys: np.ndarray, bits: int, parts: int) -> list[int]:
    """How many of the sorted keys go to each range that has some."""
    p = (keys >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)
    return np.diff(np.append(heads(p), len(p))).tolist()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """One row for each document: (id, n_words, n_removed, kept, spans).

    kept: the words that stay, joined by one blank; spans: removed word runs
    (end exclusive). A word is removed if a window of n words that covers it also starts
    earlier: in a document of smaller id, or before in the same document; rows
    of one id and different texts go by their text hash. Null texts have no words; texts of
    fewer than n words lose none. Repeated rows (same id and text) count as
    one document and get a row each. An empty table gives an empty result.
    """
    _, size = corpus(docs, text_col)
    bits, parts = fingerprint_bits(size), ranges(size)
    stored = settled(chunked(keyed_texts(docs, id_col, text_col), lambda b: b.select(["id", "tk", "text"])), "chunks")

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, data in zip(b.column("chunk").to_pylist(), b.column("data"), strict=True):
                c = _Chunk(data, n)
                at, key, head = c.probes(bits)
                if len(head):
                    block = np.logical_or.reduceat((at - c.first[c.of[at]]) % c.half == 0, head)
                    twice = np.diff(np.append(head, len(key))) > 1
                    yield asks(chunk, key[head], lambda s, t, block=block, twice=twice: _bits(np.concatenate([block[s:t], twice[s:t]])), bits, parts)
            free()

    def _found(texts: pa.Table, anchors: pa.Table) -> tuple:
        """A chunk and its candidate windows."""
        c = _Chunk(texts.column("data")[0], n)
        at, key, head = c.probes(bits)
        mark = np.zeros(len(c.hash), bool)
        hit = _answer_bits(anchors, _asked_sizes(key[head], bits, parts))
        mark[at] = np.repeat(hit, np.diff(np.append(head, len(key)))) if len(head) else False
        return c, *c.candidates(mark)

    def candidates(texts: pa.Table, anchors: pa.Table) -> pa.Table:
        c, at, g, other = _found(texts, anchors)
        free()
        if not len(at):
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.binary(), pa.binary())], ["p", "chunk", "keys", "more"])
        head = _kinds(g, other)
        first, (ids, tks) = at[head], _ids(c.batch)
        doc = c.of[first]
        pos = first - c.first[doc]
        more = lambda s, t: _places(other[head][s:t], doc[s:t], pos[s:t], ids, tks)
        return pa.Table.from_batches([asks(texts.column("chunk")[0].as_py(), g[head], more, 64, parts)])

    def cut(texts: pa.Table, answers: pa.Table) -> pa.Table:
        anchors, later = (answers.filter(pa.array([s == k for s in answers.column("step").to_pylist()], pa.bool_())) for k in (1, 2))
        c, at, g, other = _found(texts, anchors)
        mark = np.zeros(len(c.hash), np.int64)
        if len(at):
            head = _kinds(g, other)
            doc, (ids, tks) = c.of[at], _ids(c.batch)
            pos = at - c.first[doc]
            lead = np.repeat(head, np.diff(np.append(head, len(at))))
            # later than one of another chunk, or than the first of its kind here, unless it is that one's twin
            twin = (ids[doc[lead]] == ids[doc]) & (tks[doc[lead]] == tks[doc]) & (pos[lead] == pos)
            mark[at] = np.repeat(_answer_bits(later, _asked_sizes(g[head], 64, parts)), np.diff(np.append(head, len(at)))) | ~twin
        edge = np.zeros(len(mark) + n + 1, np.int64)
        edge[: len(mark)] += mark
        edge[n : n + len(mark)] -= mark
        gone = np.cumsum(edge)[: len(mark)] > 0
        raw, starts, ends = c.buf.tobytes(), c.starts.tolist(), c.ends.tolist()
        kept_of, spans_of, removed_of = [], [], []
        for s, t in zip(c.first[:-1].tolist(), c.first[1:].tolist(), strict=True):
            out = gone[s:t]
            removed_of.append(int(out.sum()))
            kept_of.append(b" ".join([raw[starts[k] : ends[k]] for k in (np.flatnonzero(~out) + s).tolist()]).decode())
            turn = np.diff(np.concatenate([[0], out.astype(np.int8), [0]]))
            spans_of.append([{"start": i, "end": j} for i, j in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True)])
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        free()
        return pa.table(
            [c.batch.column("id"), pa.array(np.diff(c.first), pa.int64()), pa.array(removed_of, pa.int64()), pa.array(kept_of, pa.string()), pa.array(spans_of, span)],
            ["id", "n_words", "n_removed", "kept", "spans"],
        )

    by_chunk = stored.groupBy("chunk")
    anchors = settled(answered(stored.mapInArrow(released(probes), "p long, chunk long, keys binary, more binary"), _anchors), "anchors")
    asked = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(candidates, "p long, chunk long, keys binary, more binary")
    later = answered(asked, _later)
    answers = anchors.withColumn("step", F.lit(1)).unionByName(later.withColumn("step", F.lit(2)))
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(cut, "id long, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>")


def repeat_columns(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256)"""
    return found.select(real_id().alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


__all__ = ["remove_repeats", "repeat_columns"]
