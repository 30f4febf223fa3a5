"""Centroid clustering of whole-number vectors, with ball trees that stay where they were built.

A task cuts its vectors into trees of up to TREE vectors: every node holds the count,
the sum and the squares of its vectors and a radius around their mean. The trees are written once.
In each round the tasks walk them from the top, level by level: by the triangle inequality a
centroid that is farther from a node's mean than the nearest one by more than two radii is nearest to none of
its vectors; a node with one centroid left goes to it whole, by its count and sum, and the
others descend, at last to leaves whose distances are computed one by one.

Only counts and sums of the clusters leave a task, so a round moves (tasks x centroids) rows
however the vectors are spread, and all of them may lie in one cluster. Whole numbers throughout:
the result does not depend on how the vectors are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depscope.llm.arrow import long_id, released
from depscope.llm.store import settled

DIMS, SCALE, CLUSTERS, ROUNDS, SALT = 64, 256, 40, 5, "2"
#: Vectors of a tree and of a leaf; the size of a component up to which squared distances fit a long.
TREE, LEAF, LIMIT = 8192, 32, 1 << 27
TREES = "ids array<bigint>, points binary, depth int, sums binary, squares array<bigint>, radius array<bigint>"


def kept_vectors(rows: DataFrame, id_col: str, vec_col: str, dims: int) -> DataFrame:
    """(id, v): the rows whose vector has exactly dims components, all finite."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.select(long_id(rows, id_col).alias("id"), v.alias("v")).filter((F.size("v") == dims) & finite)


def whole(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as whole numbers."""
    x = np.floor(scale * values)
    if len(x) and np.abs(x).max() > LIMIT:
        raise ValueError(f"a component of {scale} times a vector is beyond {LIMIT}: distances would not fit a long")
    return x.astype(np.int64)


def distances(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of a and of c."""
    top = max(int(np.abs(a).max(initial=0)), int(np.abs(c).max(initial=0)), 1)
    if 4 * top * top * a.shape[1] < 1 << 53:  # whole numbers that doubles hold exactly
        x, y = a.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((a - one) ** 2).sum(1) for one in c], axis=1)


def bounds(n: int, level: int) -> np.ndarray:
    """The 2 ** level + 1 places that cut n vectors into the nodes of a level."""
    cuts = np.array([0, n], np.int64)
    for _ in range(level):
        mid = (cuts[:-1] + cuts[1:]) // 2
        cuts = np.insert(cuts, np.arange(1, len(cuts)), mid)
    return cuts


def _root_above(square: int) -> int:
    root = int(np.sqrt(np.float64(square)))
    while root * root < square:
        root += 1
    return root


class BallTree:
    """A perfect binary tree over whole-number vectors; node k of level l covers bounds(n, l)[k] to bounds(n, l)[k + 1]."""

    def __init__(self, points: np.ndarray, depth: int, sums: np.ndarray, squares: np.ndarray, radius: np.ndarray):
        self.points, self.depth, self.sums, self.squares, self.radius = points, depth, sums, squares, radius

    @classmethod
    def build(cls, points: np.ndarray) -> tuple[BallTree, np.ndarray]:
        """The tree, and the order in which it holds the points. A node is cut at the median along the line between two far points; ties go by place."""
        n, depth = len(points), 0
        while n > LEAF << depth:
            depth += 1
        order = np.arange(n)
        sums, squares, radius = [], [], []
        for level in range(depth + 1):
            cuts = bounds(n, level).tolist()
            for s, t in zip(cuts[:-1], cuts[1:], strict=True):
                p = points[order[s:t]]
                total = p.sum(0)
                away = p - total // (t - s)
                far = (away * away).sum(1)
                sums.append(total)
                squares.append(int((p * p).sum()))
                radius.append(_root_above(int(far.max())))
                if level < depth:
                    a = p[int(far.argmax())]
                    b = p[int(((p - a) ** 2).sum(1).argmax())]
                    order[s:t] = order[s:t][np.argsort(p.astype(np.float64) @ (b - a).astype(np.float64), kind="stable")]
        return cls(points[order], depth, np.stack(sums), np.array(squares, np.int64), np.array(radius, np.int64)), order

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Nearest centroid of each point (ties: the smaller number), and count, sum and squares of each cluster; how many points went by whole nodes."""
        n, k = len(self.points), len(centroids)
        owner = np.empty(n, np.int64)
        count, total, square = np.zeros(k, np.int64), np.zeros((k, self.points.shape[1]), np.int64), np.zeros(k, np.int64)
        nodes, open_, by_node = np.zeros(1, np.int64), np.ones((1, k), bool), 0
        for level in range(self.depth + 1):
            cuts, at = bounds(n, level), (1 << level) - 1 + nodes
            size = cuts[nodes + 1] - cuts[nodes]
            far = np.where(open_, np.sqrt(distances(self.sums[at] // size[:, None], centroids).astype(np.float64)), np.inf)
            # a thousandth is far more than what the roots are off
            open_ = open_ & (far <= far.min(1)[:, None] + 2.0 * self.radius[at][:, None] + 1e-3)
            one = open_.sum(1) == 1
            mine = open_[one].argmax(1)
            np.add.at(count, mine, size[one])
            np.add.at(total, mine, self.sums[at[one]])
            np.add.at(square, mine, self.squares[at[one]])
            for c, s, t in zip(mine.tolist(), cuts[nodes[one]].tolist(), cuts[nodes[one] + 1].tolist(), strict=True):
                owner[s:t] = c
                by_node += t - s
            nodes, open_ = nodes[~one], open_[~one]
            if level < self.depth:
                nodes, open_ = np.stack([2 * nodes, 2 * nodes + 1], axis=1).reshape(-1), np.repeat(open_, 2, axis=0)
        cuts = bounds(n, self.depth)
        size = cuts[nodes + 1] - cuts[nodes]
        rows = np.repeat(cuts[nodes] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        if len(rows):
            d = distances(self.points[rows], centroids)
            d[~np.repeat(open_, size, axis=0)] = np.iinfo(np.int64).max
            own = owner[rows] = d.argmin(1)
            for c in np.unique(own).tolist():
                p = self.points[rows[own == c]]
                count[c] += len(p)
                total[c] += p.sum(0)
                square[c] += (p * p).sum()
        return owner, count, total, square, by_node


def trees(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """A row a tree over vectors (id, v)."""

    def rows(ids: list, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        points = whole(np.concatenate(values), scale)
        tree, order = BallTree.build(points)
        row = (np.array(ids, object)[order].tolist(), tree.points.astype("<i4").tobytes(), tree.depth, tree.sums.astype("<i8").tobytes(), tree.squares.tolist(), tree.radius.tolist())
        kinds = (pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [f.split(" ")[0] for f in TREES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, n = [], [], 0
        for b in batches:
            for at in range(0, b.num_rows, TREE // 4):
                part = b.slice(at, TREE // 4)
                if n and n + part.num_rows > TREE:
                    yield from rows(ids, values)
                    ids, values, n = [], [], 0
                ids += part.column("id").to_pylist()
                values.append(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                n += part.num_rows
        if n:
            yield from rows(ids, values)

    return vectors.mapInArrow(released(run), TREES)


def _read(b: pa.RecordBatch, k: int, dims: int) -> BallTree:
    of = lambda name: b.column(name)[k].as_py()
    points = np.frombuffer(of("points"), "<i4").reshape(-1, dims).astype(np.int64)
    return BallTree(points, of("depth"), np.frombuffer(of("sums"), "<i8").reshape(-1, dims), np.array(of("squares"), np.int64), np.array(of("radius"), np.int64))


def cluster_sums(forest: DataFrame, centroids: np.ndarray, dims: int) -> dict[int, tuple[int, list[int], int]]:
    """Count, sum and squares of each cluster that has vectors: as many rows as there are centroids reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        count, total, square = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for t in range(b.num_rows):
                _, c, s, q, _ = _read(b, t, dims).assign(centroids)
                count, total, square = count + c, total + s, square + q
        on = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(on, pa.int32()), pa.array(count[on]), pa.array(square[on]), pa.array([total[c].tolist() for c in on], pa.list_(pa.int64()))], ["cluster", "n", "squares", "sums"]
        )

    parts = forest.select("points", "depth", "sums", "squares", "radius").mapInArrow(released(run), "cluster int, n long, squares long, sums array<bigint>")
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"), F.array(*[F.sum(F.col("sums")[d]) for d in range(dims)]).alias("sums"))
    return {r["cluster"]: (r["n"], r["sums"], r["squares"]) for r in sums.collect()}


def first_centroids(vectors: DataFrame, clusters: int, salt: str, scale: int) -> np.ndarray:
    """The vectors with the smallest sha256 of salt:id (ties: the lesser vector), one row each."""
    key: Column = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(key.alias("k"), "v").orderBy("k", "v").limit(clusters).collect()
    return whole(np.array([r["v"] for r in rows], np.float64), scale) if rows else np.zeros((0, 0), np.int64)


def cluster(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector with dims finite components; other rows are left out.

    Components are taken as floor(scale * x). Centroids start as the vectors of the smallest sha256 of
    salt:id (a null id counts as empty there) and are replaced, rounds times, by the floor of the exact mean of
    their vectors; a centroid without vectors stays. Ties go to the smaller number. Fewer vectors than
    clusters give as many centroids as there are vectors. Repeated rows count as often as they stand. An empty
    table gives none. A component beyond LIMIT / scale is an error, since distances would not fit a long.
    """
    vectors = kept_vectors(rows, id_col, vec_col, dims)
    centroids = first_centroids(vectors, clusters, salt, scale)
    out = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], out)
    forest = settled(trees(vectors, dims, scale), "trees")
    for _ in range(rounds):
        for c, (n, total, _) in cluster_sums(forest, centroids, dims).items():
            centroids[c] = [s // n for s in total]
    own = {}
    for c, (n, total, squares) in cluster_sums(forest, centroids, dims).items():
        x = [int(v) for v in centroids[c]]
        own[c] = squares - 2 * sum(a * b for a, b in zip(x, total, strict=True)) + n * sum(a * a for a in x)
    everything = sum(own.values())
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inertia, names = np.array([own.get(c, 0) for c in range(len(centroids))], np.int64), pa.array(sha, pa.string())
        for b in batches:
            for t in range(b.num_rows):
                tree = _read(b, t, dims)
                owner = tree.assign(centroids)[0]
                away = tree.points - centroids[owner]
                ids = pa.array(b.column("ids")[t].as_py(), pa.int64())
                cols = [ids, pa.array(owner, pa.int32()), pa.array((away * away).sum(1)), pa.array(inertia[owner]), pa.array(np.full(len(owner), everything, np.int64)), names.take(pa.array(owner))]
                yield pa.RecordBatch.from_arrays(cols, [f.split(" ")[0] for f in out.split(", ")])

    return forest.mapInArrow(released(run), out)


__all__ = ["BallTree", "cluster"]
