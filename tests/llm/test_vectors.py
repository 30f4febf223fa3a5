"""Clustering, near vectors and periodic runs against brute force, on tables with every awkward row."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from depscope.llm import balltree, runs, spherical
from depscope.llm.queries import QUERIES, with_planted_runs

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, id string, v string, key int, node int, cell int, label int"
NAN, INF = float("nan"), float("inf")


def awkward(spark, vectors):
    rows = [(k, v, "x", "y", 1, 2, 3, 4) for k, v in enumerate(vectors)]
    odd = [None, [], [0.0] * 64, [1.0, None] * 32, [NAN] + [1.0] * 63, [INF] + [1.0] * 63, [1.0] * 63]
    rows += [(1000 + k, v, None, None, None, None, None, None) for k, v in enumerate(odd)]
    return spark.createDataFrame([*rows, rows[0], (None, vectors[1], *[None] * 6)], SCHEMA)


def near_copies(n, r, of=64):
    base = r.normal(size=(n, of))
    out = [*base, *(base[: n // 3] + 0.05 * r.normal(size=(n // 3, of))), *(base[: n // 4] * 3), base[0], base[0]]
    return [[float(np.float32(x)) for x in v] for v in out]


def plain_kmeans(rows, clusters, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:clusters]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((dist(v, c), k) for k, c in enumerate(cents))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for k in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == k]
            if mine:
                cents[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [nearest(v) for _, v in kept]
    total = {k: sum(d for d, o in last if o == k) for k in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(str((i, k, d, total[k], sum(total.values()), sha[k])) for (i, _), (d, k) in zip(kept, last, strict=True))


def test_clusters_are_those_of_plain_kmeans(spark):
    table = awkward(spark, near_copies(60, np.random.default_rng(1)))
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got = [str(tuple(r)) for r in balltree.cluster(table, clusters=7, rounds=3).collect()]
    assert sorted(got) == plain_kmeans(rows, 7, 3)
    few = table.filter("vec_id < 3")
    assert sorted(str(tuple(r)) for r in balltree.cluster(few).collect()) == plain_kmeans([r for r in rows if r[0] is not None and r[0] < 3], 40, 5)
    assert balltree.cluster(table.filter("vec_id >= 1000")).count() == 1  # zeros are finite
    assert balltree.cluster(table.filter("vec_id > 1002")).count() == 0
    with pytest.raises(ValueError):
        balltree.whole(np.array([1e9]))


def test_op11_equals_plain_kmeans_on_the_smallest_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(str(tuple(r)) for r in QUERIES["op11_centroid_clustering"](spark, SF).collect()) == plain_kmeans(rows, 40, 5)


@given(st.integers(0, 2**32), st.integers(1, 400), st.sampled_from([1, 3, 1000, 1 << 27]))
@settings(max_examples=40, deadline=None)
def test_a_tree_assigns_as_all_distances_do(seed, n, size):
    r = np.random.default_rng(seed)
    heart = r.integers(-size, size + 1, (5, 6))
    points = np.clip(heart[r.integers(0, 5, n)] + r.integers(-2, 3, (n, 6)), -(1 << 27), 1 << 27)
    cents = np.concatenate([heart, heart[:1], r.integers(-size, size + 1, (4, 6))])
    tree, order = balltree.BallTree.build(points)
    owner, count, total, square, _ = tree.assign(cents)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(p, c, strict=True)), k) for k, c in enumerate(cents))[1] for p in tree.points]
    assert owner.tolist() == want and (points[order] == tree.points).all()
    for k in range(len(cents)):
        mine = tree.points[owner == k]
        assert (count[k], total[k].tolist(), square[k]) == (len(mine), mine.sum(0).tolist(), (mine * mine).sum())


def test_tight_groups_go_by_whole_nodes():
    r = np.random.default_rng(2)
    points = r.integers(-300, 300, (8, 64))[r.integers(0, 8, 4000)] + r.integers(-2, 3, (4000, 64))
    tree, _ = balltree.BallTree.build(points)
    assert tree.assign(points[:40])[4] >= 0  # centroids inside one group share it
    far = np.stack([points[0], points[0] + 5000])
    assert tree.assign(far)[4] == 4000


def plain_links(rows):
    ok = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    cos = lambda a, b: math.fsum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(x * x for x in b))
    n, root = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if ok(a) and ok(b) and len(a) == len(b) and cos(a, b) >= 0.9:
                n[i] += 1
                n[j] += 1
                root[top(i)] = top(j)
    ident = lambda i: -(2**63) if i is None else i
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), 2**63), ident(i))
    real = lambda i: None if i == -(2**63) else i
    return sorted(str((i, n[k], real(least[top(k)]), ident(i) == least[top(k)])) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("small", [False, True])
def test_links_are_all_links(spark, monkeypatch, small):
    """Chains of vectors, copies, multiples, a threshold met exactly; in one cell, and in many cells and blocks."""
    r = np.random.default_rng(4)
    chain = [r.normal(size=64)]
    for _ in range(20):
        chain.append(chain[-1] + 0.3 * r.normal(size=64))
    tie = [[9.0, math.sqrt(19), *[0.0] * 62], [1.0, *[0.0] * 63], [3.0, 4.0], [4.0, 3.0], [24.0, 7.0]]
    tie[0] = [9.0, 4.0, 1.0, 1.0, 1.0, *[0.0] * 59]  # 9 / sqrt(100)
    table = awkward(spark, [*near_copies(50, r), *[[float(np.float32(x)) for x in v] for v in chain], *tie])
    if small:
        monkeypatch.setattr(spherical, "CELL", 8)
        monkeypatch.setattr(spherical, "BLOCK_BYTES", 20 * 512)
    rows = [(x["vec_id"], x["embedding"]) for x in table.collect()]
    assert sorted(str(tuple(x)) for x in spherical.link_columns(spherical.near_vectors(table)).collect()) == plain_links(rows)
    kept = spherical.dedup_vectors(table)
    assert kept.columns == table.columns and kept.filter("vec_id = 1001").count() == 1
    assert spherical.near_vectors(table.limit(0)).count() == 0


def test_links_of_random_directions(spark, monkeypatch):
    """Partners at a cosine of 0.9 of vectors without any clusters: nearly all are found, and all of closer ones."""
    r = np.random.default_rng(6)
    x = spherical.unit(r.normal(size=(3000, 64)))
    side = r.normal(size=x.shape)
    side = spherical.unit(side - (side * x).sum(1, keepdims=True) * x)
    monkeypatch.setattr(spherical, "CELL", 64)
    for cosine, least in ((0.901, 0.985), (0.95, 0.9995)):
        y = cosine * x + math.sqrt(1 - cosine**2) * side
        table = spark.createDataFrame([(2 * k + j, v[k].tolist()) for j, v in enumerate((x, y)) for k in range(len(x))], "vec_id long, embedding array<double>")
        found = {row["id"]: row["n_links"] for row in spherical.near_vectors(table).collect()}
        assert sum(n == 1 for n in found.values()) >= least * len(found) and max(found.values()) == 1


def plain_runs(t, periods=3, least=24):
    out = []
    for q in range(1, len(t) // periods + 1):
        i = 0
        while i + q < len(t):
            j = i
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, periods * q) and all(q % d or any(t[k] != t[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def strings():
    r = random.Random(7)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]
    yield [bin(k).count("1") % 2 for k in range(256)]
    yield [0] * 200
    yield [0, 1] * 100 + [0]
    yield ([0] * 15 + [1]) * 12
    for _ in range(60):
        block = [r.randrange(3) for _ in range(r.randrange(1, 12))]
        yield [r.randrange(2) for _ in range(r.randrange(20))] + block * r.randrange(1, 12) + block[: r.randrange(len(block))] + [r.randrange(3) for _ in range(r.randrange(20))]


def test_runs_are_all_runs():
    for t in strings():
        for periods, words in ((3, 24), (3, 4), (2, 2)):
            assert runs.find_runs(np.array(t), periods, words) == plain_runs(t, periods, words), t


@given(st.lists(st.integers(0, 1), max_size=60))
@settings(max_examples=150, deadline=None)
def test_runs_of_any_text(t):
    assert runs.find_runs(np.array(t, np.int64), 2, 2) == plain_runs(t, 2, 2)
    nxt, agree, _ = runs.lyndon_edges(t)
    for i in range(len(t)):
        j = next((j for j in range(i + 1, len(t)) if t[j:] < t[i:]), len(t))
        assert nxt[i] == j


def test_runs_take_linear_time():
    """Symbols looked at for each symbol do not grow with the length."""
    r = random.Random(8)
    a, b = [0], [0, 1]
    while len(b) < 40000:
        a, b = b, b + a
    block = [r.randrange(50) for _ in range(300)]
    nested = ([0] * 9 + [1]) * 9 + [2]
    texts = [b, [0] * 40000, block * 130, [bin(k).count("1") % 2 for k in range(40000)], [r.randrange(2) for _ in range(40000)], nested * 400, [0] * 20000 + [1] + [0] * 20000]
    for t in texts:
        for order in (t, [-x for x in t]):
            assert runs.lyndon_edges(order)[2] <= 4 * len(t)


def test_periodic_runs_of_documents(spark):
    r = random.Random(9)
    prose = lambda n: [r.choice("the of and a to in is it you that".split()) + str(r.randrange(3)) for _ in range(n)]
    texts = [None, "", " \n ", " ".join(["a"] * 23), " ".join(["a"] * 24), "\t".join(prose(40) + ["é", "b", "c"] * 9 + prose(30)), " ".join(prose(3000)), " ".join(["x"] * 30 + ["y"] + ["x"] * 40), "\n".join((["p", "q"] * 5 + ["z"]) * 7)]
    docs = spark.createDataFrame([(k, t, "s", 1) for k, t in enumerate(texts)] + [(4, texts[4], "s", 1), (None, texts[4], None, None)], "doc_id long, text string, id string, runs int")
    got = runs.periodic_runs(docs).collect()
    assert len(got) == docs.count() and runs.periodic_runs(docs.limit(0)).count() == 0
    by = {x["id"]: x for x in got}
    for k, t in enumerate(texts):
        check_row(by[k], (t or "").split())
    assert [x["n_runs"] for x in runs.run_columns(runs.periodic_runs(docs)).filter("doc_id is null").collect()] == [1]


def check_row(row, words):
    want = plain_runs(words)
    assert [(x["start"], x["length"], x["period"]) for x in row["runs"]] == want and row["n_words"] == len(words)
    gone = {k for a, n, p in want for k in range(a + p, a + n)}
    assert row["kept"] == " ".join(w for k, w in enumerate(words) if k not in gone)
    best = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    assert (tuple(row["top"]) if row["top"] else None) == best


def planted(i, words):
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def test_op12_on_the_smallest_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").filter(F.length("text") < 4000)
    want = {}
    for r in table.collect():
        words = planted(r["doc_id"], [w for w in (r["text"] or "").replace("\x0b", " ").replace("\x0c", " ").encode().split()])
        found = plain_runs(words)
        gone = {k for a, n, p in found for k in range(a + p, a + n)}
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        lines = "".join(f"{a},{n},{p}\n" for a, n, p in found)
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        want[r["doc_id"]] = (r["doc_id"], len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: tuple(r) for r in runs.run_columns(runs.periodic_runs(with_planted_runs(table))).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 5
