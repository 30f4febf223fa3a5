"""Best-fit packing by minimum bin slack.

Only the histogram of piece lengths (at most `room` entries) reaches the
driver. For each bin a subset-sum over a bitset finds the fullest feasible combination
of the lengths left that holds the largest one; as many bins as the counts
allow are filled with it at once. The pieces then look up their bin by (length,
rank): ranks are dealt out per task with prefix counts, so a frequent length never meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depscope.llm.arrow import gathered, keyed_texts, real_id, released
from depscope.llm.store import settled
from depscope.llm.tok import spread

ROOM = 2048
#: Bytes of text that are encoded together.
STEP_BYTES = 8 << 20
PIECES = "id long, tk long, piece int, start long, length long, ids_crc32 long"


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The fullest combination of lengths within counts and room that holds the largest length; {length: number}.

    Bit t of a bitset says that the sum t can be reached with the lengths seen
    so far. Ties go to the combination with the larger lengths.
    """
    big = max(counts)
    rest = room - big
    items: list[tuple[int, int]] = []  # (length, number taken together)
    for length in sorted(counts, reverse=True):
        n, k = min(counts[length] - (length == big), rest // length), 1
        while n > 0:
            items.append((length, min(k, n)))
            n -= k
            k *= 2
    full, reach = (1 << (rest + 1)) - 1, [1]
    for length, k in items:
        reach.append((reach[-1] | reach[-1] << length * k) & full)
        if reach[-1] >> rest & 1:
            break
    at = reach[-1].bit_length() - 1
    taken = {big: 1}
    for j in range(len(reach) - 1, 0, -1):
        if reach[j - 1] >> at & 1:
            continue
        length, k = items[j - 1]
        taken[length] = taken.get(length, 0) + k
        at -= length * k
    return taken


def plan_bins(counts: dict[int, int], room: int = ROOM) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, {length: pieces in each}) in order, until every piece has its place."""
    left, out = {k: n for k, n in counts.items() if n}, []
    while left:
        combo = fullest(left, room)
        times = min(left[k] // n for k, n in combo.items())
        out.append((times, combo))
        for k, n in combo.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM, end_id: int = 0) -> DataFrame:
    """(id, tk, piece, start, length, ids_crc32): ids of each text and end_id, cut every room ids. Null text: only end_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from depscope.llm.tok import cached_tokenizer

        encoder = cached_tokenizer(tokenizer)
        for b in gathered(batches, STEP_BYTES):
            ids, at = encoder.encode_column(b.column("text"), end_id)
            size = np.diff(at)
            many = -(-size // room)
            row = np.repeat(np.arange(len(size)), many)
            piece = spread(np.zeros(len(many), np.int64), many)
            start = piece * room
            length = np.minimum(room, size[row] - start)
            first = at[:-1][row] + start
            crc = [zlib.crc32(ids[s:t]) for s, t in zip(first.tolist(), (first + length).tolist(), strict=True)]
            cols = [b.column("id").take(pa.array(row)), b.column("tk").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "tk", "piece", "start", "length", "ids_crc32"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(released(run), PIECES)


def pack(pieces: DataFrame, room: int = ROOM) -> DataFrame:
    """pieces with a length column, and sequence_id, offset.

    Each sequence holds at most room, its pieces lie gapless from offset 0.
    Lengths from 1 to room are taken; a length outside is an error. The pieces
    are written to the shared folder once. Ties: pieces of one length are
    interchangeable. An empty table gives an empty result.
    """
    cols = pieces.columns
    pieces = settled(pieces.withColumn("__part", F.spark_partition_id()), "pieces")
    per_part = settled(pieces.groupBy("__part", "length").count(), "piece_counts")
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("count").alias("n")).limit(room + 2).collect()}
    if any(not 1 <= k <= room for k in counts):
        raise ValueError(f"a piece is empty or longer than {room}")
    bins = plan_bins(counts, room)
    # for each length: where the ranks of a plan entry begin, its first bin, pieces a bin, offset of the first in a bin
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for times, combo in bins:
        at = 0
        for length, n in combo.items():
            table.setdefault(length, []).append((used.get(length, 0), first, n, at))
            used[length] = used.get(length, 0) + n * times
            at += length * n
        first += times
    shared = pieces.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in table.items()})
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("__part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    by = Window.partitionBy("__part", "length").orderBy(*[c for c in ("id", "tk", "piece") if c in cols] or ["length"])
    ranked = pieces.withColumn("__rank", F.row_number().over(by) - 1).join(base.hint("merge"), ["__part", "length"])  # base grows with the tasks: never broadcast
    ranked = ranked.select(*cols, (F.col("__rank") + F.col("__base")).alias("__at"))
    schema = ranked.drop("__at").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column("__at").to_numpy(zero_copy_only=False).astype(np.int64)
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                on = np.flatnonzero(length == k)
                t = rows[int(k)]
                e = t[np.searchsorted(t[:, 0], rank[on], side="right") - 1]
                inner = rank[on] - e[:, 0]
                seq[on], off[on] = e[:, 1] + inner // e[:, 2], e[:, 3] + inner % e[:, 2] * k
            out = [b.column(c) for c in cols]
            yield pa.RecordBatch.from_arrays([*out, pa.array(seq), pa.array(off)], [*cols, "sequence_id", "offset"])

    return ranked.mapInArrow(released(run), schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each document."""
    packed = pack(token_pieces(docs, tokenizer, id_col, text_col, room), room)
    return packed.select(real_id().alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
