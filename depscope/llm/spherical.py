"""Near duplicates of vectors: spherical k-means cells, blocked cosine products inside the cells, one vector a group kept.

1. Equal vectors are made one row with their count, so copies of one vector never meet in a task.
2. Centroids of unit length are fitted on a bounded sample; there is one for every CELL vectors, MAX_CELLS at most.
3. Every vector lies in the cell of its nearest centroid and visits the cells whose centroid is less
   near by MARGIN at most, so that a link across a border is found from one of its sides.
4. A cell is cut into blocks of BLOCK_BYTES; the products of two blocks are one task, in double precision. Pairs of two
   visitors are left to the cell of one of them; a pair that two cells see counts in the one of the smaller number.
   A task gives back degrees and the links of a forest, never all pairs.
5. Groups are the connected components of the forests.

Every pair found is compared exactly, so no link is false. A link is missed if each of its vectors
has its home more than MARGIN behind the other's: on random directions (the hardest case: no clusters)
up to 1 % of the links at a cosine of 0.9, under 1 in 2,000 at 0.95; tests/llm/test_vectors.py measures it.
With margin=2 every vector visits every cell and nothing is missed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depscope.llm.arrow import NULL_ID, long_id, real_id, released
from depscope.llm.near import components
from depscope.llm.store import settled

THRESHOLD = 0.9
#: Vectors for each centroid, centroids at most, vectors of the sample for each centroid; how much less near a visited centroid may be.
CELL, MAX_CELLS, SAMPLE, MARGIN = 2048, 4096, 32, 0.12
#: Bytes of vectors in a block; rows of a block that are multiplied at a time; parts into which the copies of one vector are dealt.
BLOCK_BYTES, ROWS, SALTS = 8 << 20, 256, 32
_BIAS = np.uint64(1 << 63)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows are scaled first, so that no square overflows or vanishes."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _at_least(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether the cosine of x and y is threshold or more, with sums that are rounded once (and powers of two taken out first)."""
    x, y = (np.ldexp(z, -np.frexp(np.abs(z).max())[1]) for z in (x, y))
    dot = math.fsum((x * y).tolist())
    return dot / math.sqrt(math.fsum((x * x).tolist()) * math.fsum((y * y).tolist())) >= threshold


def spherical_kmeans(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k unit centroids of unit vectors, starting from the first k of them; one without vectors stays."""
    centroids = sample[:k].copy()
    for _ in range(rounds):
        total = np.zeros_like(centroids)
        for at in range(0, len(sample), 4096):
            part = sample[at : at + 4096]
            np.add.at(total, (part @ centroids.T).argmax(1), part)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        centroids = np.where(size > 1e-9, total / np.maximum(size, 1e-9), centroids)
    return centroids


def named_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, key, node, v): key names the vector (null where it can have no link), node its id and key in an order of bytes like that of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            heads = (ids.view(np.uint64) ^ _BIAS).astype(">u8").tobytes()
            keys, nodes, vectors = [], [], []
            for k, v in enumerate(b.column("v")):
                x = np.array([], np.float64) if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                ok = len(x) and np.isfinite(x).all() and x.any()
                keys.append(hashlib.md5(x.tobytes()).digest() if ok else None)
                nodes.append(heads[8 * k : 8 * k + 8] + keys[-1] if ok else None)
                vectors.append(x.tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(keys, pa.binary()), pa.array(nodes, pa.binary()), pa.array(vectors, pa.binary())], ["id", "key", "node", "v"])

    picked = rows.select(F.coalesce(long_id(rows, id_col), F.lit(NULL_ID)).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return picked.mapInArrow(released(run), "id long, key binary, node binary, v binary")


def fit_cells(nodes: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Centroids by length of vector, from the vectors of the smallest keys: SAMPLE for each of up to MAX_CELLS centroids."""
    cells = max(1, min(MAX_CELLS, n // CELL))
    found: dict[int, list[bytes]] = {}
    for r in nodes.select("key", "v").orderBy("key").limit(SAMPLE * cells).collect():
        found.setdefault(len(r["v"]), []).append(bytes(r["v"]))
    most = sum(map(len, found.values()))
    out = {}
    for size, vectors in found.items():
        x = unit(np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)).astype(np.float32)
        out[size // 8] = spherical_kmeans(x, max(1, cells * len(vectors) // most))
    return out


def in_cells(nodes: DataFrame, centroids: dict[int, np.ndarray], margin: float) -> DataFrame:
    """(cell, dims, home, own, visits, node, copies, v): a row for each cell that a vector lies in or visits. A length that the sample lacks has one cell."""
    shared = nodes.sparkSession.sparkContext.broadcast(centroids)  # MAX_CELLS and a few at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array([len(x) // 8 for x in b.column("v").to_pylist()])
            for dims in np.unique(sizes).tolist():
                rows = pa.array(np.flatnonzero(sizes == dims))
                part = b.take(rows)
                x = unit(np.frombuffer(b"".join(part.column("v").to_pylist()), "<f8").reshape(-1, dims)).astype(np.float32)
                near = x @ shared.value[dims].T if dims in shared.value else np.zeros((len(x), 1), np.float32)
                own = near.argmax(1)
                on = near >= near.max(1, keepdims=True) - np.float32(margin)
                row, cell = np.nonzero(on)
                visits = [np.flatnonzero(o).tolist() for o in on]
                home = cell == own[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cell, pa.int64()),
                        pa.array(np.full(len(row), dims), pa.int32()),
                        pa.array(home),
                        pa.array(own[row], pa.int64()),
                        pa.array([visits[r] if h else None for r, h in zip(row.tolist(), home.tolist(), strict=True)], pa.list_(pa.int64())),
                        *[part.column(c).take(pa.array(row)) for c in ("node", "copies", "v")],
                    ],
                    ["cell", "dims", "home", "own", "visits", "node", "copies", "v"],
                )

    return nodes.select("node", "copies", "v").mapInArrow(released(run), "cell long, dims int, home boolean, own long, visits array<bigint>, node binary, copies long, v binary")


def _blocks(placed: DataFrame) -> DataFrame:
    """placed with (block, lo, hi): each pair of a cell's members meets in one pair of blocks."""
    sizes = placed.groupBy("dims", "cell").agg(F.ceil(F.count(F.lit(1)) * F.col("dims") * 8 / BLOCK_BYTES).alias("cut"))
    blocks = placed.join(sizes, ["dims", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), "cut"))
    many = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1)))
    return many.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("cut", "other")


class _Groups:
    """Which members are joined so far; a row joins all that it is linked to."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, one: int, others: np.ndarray) -> None:
        labels = np.unique(np.append(self.label[others], self.label[one]))
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]


def compare(t: pa.Table, threshold: float) -> pa.Table:
    """Degrees (b null) and links of a forest (n null) among the members of two blocks of a cell."""
    dims, cell, across = t.column("dims")[0].as_py(), t.column("cell")[0].as_py(), t.column("lo")[0].as_py() != t.column("hi")[0].as_py()
    raw = np.frombuffer(b"".join(t.column("v").to_pylist()), "<f8").reshape(-1, dims)
    x, home, own, copies = unit(raw), t.column("home").to_numpy(), t.column("own").to_numpy(), t.column("copies").to_numpy()
    block, lo = t.column("block").to_numpy(), t.column("lo")[0].as_py()
    visits = t.column("visits").to_pylist()
    first = np.flatnonzero(block == lo) if across else np.arange(len(x))
    second = np.flatnonzero(block != lo) if across else first
    degree, groups = np.zeros(len(x), np.int64), _Groups(len(x))
    # homes with all, then visitors with homes
    for left, right in ((first[home[first]], second), (first[~home[first]], second[home[second]])):
        if not len(left) or not len(right) or not across and not home[left[0]]:
            continue
        for at in range(0, len(left), ROWS):
            rows = left[at : at + ROWS]
            cos = x[rows] @ x[right].T
            link = cos >= threshold
            for i, j in zip(*np.nonzero(np.abs(cos - threshold) < 1e-12), strict=True):
                link[i, j] = _at_least(raw[rows[i]], raw[right[j]], threshold)
            if not across:  # each pair once: two homes in the order of rows, a home and a visitor from the home's side
                link &= np.where(home[right][None, :], home[rows][:, None] & (rows[:, None] < right[None, :]), True)
            for i in np.flatnonzero(link.any(1)).tolist():
                a, others = int(rows[i]), right[link[i]]
                # a home and a visitor that also meet in the visitor's own cell: there, if that has the smaller number
                if home[a]:
                    seen = ~home[others] & (own[others] < cell) & np.isin(own[others], visits[a])
                else:
                    seen = np.array([own[a] < cell and own[a] in visits[b] for b in others.tolist()], bool)
                others = others[~seen]
                degree[a] += copies[others].sum()
                degree[others] += copies[a]
                groups.join(a, others)
    node = np.array(t.column("node").to_pylist(), object)
    on, tied = np.flatnonzero(degree), np.flatnonzero(groups.label != np.arange(len(x)))
    return pa.table({
        "a": pa.array(node[on].tolist() + node[tied].tolist(), pa.binary()),
        "b": pa.array([None] * len(on) + node[groups.label[tied]].tolist(), pa.binary()),
        "n": pa.array(degree[on].tolist() + [None] * len(tied), pa.int64()),
    })


def _id_of(node: Column) -> Column:
    """The id at the head of a node."""
    return (F.conv(F.hex(F.substring(node, 1, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """(id, n_links, component_id, kept) of each row: vectors of one length with a cosine of threshold or more are linked.

    component_id is the smallest id that links reach, kept whether it is the row's own. A vector that is
    null, empty, zero or has null or non-finite components links with nothing. Equal vectors link
    (also rows of one id, which count as others of each other). Null ids take part as the smallest id.
    An empty table gives none.
    """
    members = settled(named_vectors(rows, id_col, vec_col), "vectors")
    nodes = settled(members.filter("key is not null").groupBy("key").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("copies"), F.max("v").alias("v")), "distinct")
    centroids = fit_cells(nodes, nodes.count())
    placed = settled(in_cells(nodes, centroids, margin), "cells")
    judged = settled(_blocks(placed).groupBy("dims", "cell", "lo", "hi").applyInArrow(lambda t: compare(t, threshold), "a binary, b binary, n long"), "links")
    labels = components(judged.filter("b is not null").select("a", "b"))
    degree = judged.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    of_node = nodes.select("key", "node", "copies").join(labels, "node", "left").join(degree, "node", "left")
    # the copies of a vector are dealt into SALTS parts; a vector without copies has one row, of a known part
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS))
    alone = F.array(part(_id_of(F.col("node"))))
    parts = F.when(F.col("copies") == 1, alone).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    known = of_node.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), _id_of(F.coalesce("label", "node")).alias("least"), F.explode(parts).alias("part"))
    found = members.select("id", "key", part(F.col("id")).alias("part")).join(known, ["key", "part"], "left")
    least = F.coalesce("least", "id")
    return found.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), least.alias("component_id"), (F.col("id") == least).alias("kept"))


def link_columns(found: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept); an id that was null is null again."""
    return found.select(real_id().alias("vec_id"), "n_links", real_id("component_id").alias("component_id"), "kept")


def dedup_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **more) -> DataFrame:
    """The row of the smallest id of each group, with all its columns; of repeated rows one stays."""
    kept = near_vectors(rows, id_col, vec_col, **more).filter("kept").select(F.col("id").alias("__id")).distinct()
    tagged = rows.withColumn("__id", F.coalesce(long_id(rows, id_col), F.lit(NULL_ID)))
    return tagged.join(kept, "__id", "left_semi").dropDuplicates(["__id", vec_col]).select(*rows.columns)


__all__ = ["near_vectors", "dedup_vectors", "link_columns"]
