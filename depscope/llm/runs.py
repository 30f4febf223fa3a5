"""Periodic runs of words, by Lyndon arrays in linear time.

The longest Lyndon word at a place ends where the next smaller suffix begins. Suffixes are compared once
for each edge (place, next or previous smaller suffix), from left to right; how far two suffixes
agree (their extension) is kept with the edge. What is known is never matched again:

* right of the last comparison that reached farthest, the text repeats what stands a shift before it,
  so an edge there has the extension of its twin, as far as that region goes;
* going down the chain of smaller suffixes, two known extensions that differ give the third.

A run of period p has, under one of the two orders of the alphabet, a Lyndon word of length p at
its root, so both orders are tried; the edge's extension is the run's end. No suffix array, tree or hash of
words is used. (After Ellert and Fischer, "Linear time runs over general ordered alphabets", 2021.)

Words of an Arrow batch are numbered first; any order of the numbers will do. A word inside a run
of three periods stands three times in it, so words that a stretch has fewer than three times cut it, which
leaves little of ordinary prose to look at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depscope.llm.arrow import NOT_SPACE, chunks, keyed_texts, real_id, released, text_buffer, word_spans

#: A run holds so many periods, and so many words.
PERIODS, WORDS = 3, 24
Run = tuple[int, int, int]


def lyndon_edges(t: list[int]) -> tuple[list[int], list[int], int]:
    """For each place the next smaller suffix (len(t) if there is none) and how far the two agree; last, how many pairs of symbols were looked at.

    The end of the text is less than any symbol.
    """
    n = len(t)
    nxt, agree = [n] * n, [0] * n  # edges to the next smaller suffix
    prev, shared = [-1] * n, [0] * n  # and to the previous one
    end = start = shift = looked = 0  # t[start:end] equals t[start - shift:end - shift]
    for r in range(1, n):
        here, v, open_ = r - 1, 0, True
        while True:
            if open_:
                if r < end and here >= start:
                    x, y = here - shift, r - shift
                    twin = agree[x] if nxt[x] == y else shared[y] if prev[y] == x else 0
                    v = max(v, min(twin, end - r))
                looked += 1 - v
                while r + v < n and t[here + v] == t[r + v]:
                    v += 1
                looked += v
                if r + v > end:
                    end, start, shift = r + v, r, r - here
            if r + v < n and t[here + v] < t[r + v]:
                prev[r], shared[r] = here, v
                break
            nxt[here], agree[here] = r, v
            below = prev[here]
            if below < 0:
                break
            # here agrees with below as far as shared[here], with r as far as v: where the two differ, the lesser holds for below and r
            open_ = shared[here] == v
            v = min(v, shared[here])
            here = below
    return nxt, agree, looked


def find_runs(t: np.ndarray, periods: int = PERIODS, words: int = WORDS) -> list[Run]:
    """(start, length, period) of every run of at least so many periods and words, by start, then period."""
    found: set[Run] = set()
    for order in (t, -t):
        nxt, agree, _ = lyndon_edges(order.tolist())
        period, more = np.array(nxt) - np.arange(len(t)), np.array(agree)
        # the first root of a run lies in its first period
        ok = np.flatnonzero((more > (periods - 2) * period) & (2 * period + more > words))
        first: dict[tuple[int, int], int] = {}
        for i, p, m in zip(ok.tolist(), period[ok].tolist(), more[ok].tolist(), strict=True):
            first.setdefault((p, i + p + m), i)
        for (p, end), i in first.items():
            start = i
            while start and t[start - 1] == t[start - 1 + p]:
                start -= 1
            if end - start >= max(words, periods * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray, of: np.ndarray, periods: int = PERIODS, words: int = WORDS) -> list[tuple[int, int]]:
    """Parts (start, end) of texts that may hold a run: words that a part has fewer than periods times cut it, until none is left."""
    at, part = np.arange(len(codes)), of
    while len(at):
        _, which, many = np.unique(part.astype(np.int64) * (int(codes.max()) + 1) + codes[at], return_inverse=True, return_counts=True)
        alive = many[which] >= periods
        kept, group = at[alive], part[alive]
        new = np.append(True, (np.diff(kept) != 1) | (np.diff(group) != 0)) if len(kept) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        long = np.bincount(number)[number] >= words if len(kept) else new
        if long.all() and alive.all():
            heads = np.flatnonzero(new)
            return [(int(kept[s]), int(kept[t - 1]) + 1) for s, t in zip(heads, np.append(heads[1:], len(kept)), strict=True)]
        at, part = kept[long], number[long]
    return []


def _best(runs: list[Run]) -> Run:
    """The run of the greatest length / period; ties: the smallest start, then period."""
    top = runs[0]
    for r in runs[1:]:
        if r[1] * top[2] > top[1] * r[2]:
            top = r
    return top


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", periods: int = PERIODS, words: int = WORDS) -> DataFrame:
    """(id, n_words, runs, top, kept) of each row.

    runs: (start, length, period) in words, by start and period; top: the run of the greatest length / period, null if
    there is none; kept: the words that stay, joined by one blank: all but those that a run holds after its first period.
    Null texts have no words; texts of fewer words than a run needs have no run; repeated rows get a row each. An empty table gives none.
    """
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b):
                buf, off = text_buffer(c.column("text"))
                starts, ends, of = word_spans(buf, off, NOT_SPACE)
                first = np.searchsorted(of, np.arange(c.num_rows + 1))
                spelled = pa.py_buffer(np.ascontiguousarray(buf[NOT_SPACE[buf]]))
                places = pa.py_buffer(np.append(0, np.cumsum(ends - starts)).astype(np.int64))
                codes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, places, spelled]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                found: dict[int, list[Run]] = {}
                for s, t in stretches(codes, of, periods, words):
                    d = int(of[s])
                    found.setdefault(d, []).extend((s - int(first[d]) + a, n, p) for a, n, p in find_runs(codes[s:t], periods, words))
                raw, off = buf.tobytes(), off.tolist()
                runs, tops, kept = [], [], []
                for d in range(c.num_rows):
                    own = found.get(d) or []
                    word = raw[off[d] : off[d + 1]].split()
                    if own:
                        gone = np.zeros(len(word), bool)
                        for a, n, p in own:
                            gone[a + p : a + n] = True
                        word = [w for w, g in zip(word, gone.tolist(), strict=True) if not g]
                    as_struct = [{"start": a, "length": n, "period": p} for a, n, p in own]
                    runs.append(as_struct)
                    tops.append(as_struct[own.index(_best(own))] if own else None)
                    kept.append(b" ".join(word).decode())
                yield pa.RecordBatch.from_arrays(
                    [c.column("id"), pa.array(np.diff(first), pa.int64()), pa.array(runs, pa.list_(run_type)), pa.array(tops, run_type), pa.array(kept, pa.string())], ["id", "n_words", "runs", "top", "kept"]
                )

    shape = "struct<start:long,length:long,period:long>"
    return keyed_texts(docs, id_col, text_col).mapInArrow(released(run), f"id long, n_words long, runs array<{shape}>, top {shape}, kept string")


def run_columns(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)"""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    top = F.col("top")
    return found.select(
        real_id().alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"),
    )


__all__ = ["find_runs", "periodic_runs", "run_columns"]
