"""Edges, cones and searches on small graphs worked out by hand or by a plain walk."""

import random

from pyspark.sql import functions as F

from depscope.operators import graph, measures, reports
from depscope.operators.matching import containing


def walk(edges, seed):
    """{node: steps} from seed."""
    found, step, k = {seed: 0}, [seed], 0
    while step:
        k += 1
        step = [d for s in step for a, d in edges if a == s and d not in found and not found.update({d: k})]
    return found


def test_cones_equal_a_plain_walk(spark):
    r = random.Random(3)
    edges = {(repo, f"d{r.randrange(3)}/n{r.randrange(60)}", f"d{r.randrange(3)}/n{r.randrange(60)}") for repo in "pq" for _ in range(170)} | {("p", "x", "x"), ("q", "y", "z")}
    df = spark.createDataFrame(sorted(edges), "repo string, src string, dst string")
    want = set()
    for repo in "pq":
        own = [(s, d) for p, s, d in edges if p == repo and s != d]
        for n in {x for e in own for x in e}:
            want |= {(repo, n, d, k) for d, k in walk(own, n).items()}
    assert {tuple(x) for x in graph.closure(df).collect()} == want
    assert {tuple(x) for x in graph.closure(df, max_depth=2).collect()} == {w for w in want if w[3] <= 2}
    seeds = spark.createDataFrame([("p", "d0/n1"), ("p", "d0/n1"), ("p", "lone"), ("q", "z")], "repo string, file string")
    some = {tuple(x) for x in graph.closure(df, seeds).collect()}
    assert some == {w for w in want if w[:2] in {("p", "d0/n1"), ("q", "z")}} | {("p", "lone", "lone", 0)}
    assert graph.closure(df.limit(0)).count() == 0
    files = spark.createDataFrame([(repo, n, "a b c" if n < "d1" else "a") for repo, n in sorted({(w[0], w[1]) for w in want})], "repo string, path string, content string")
    sizes = {(x["repo"], x["origin"]): (x["cone_files"], x["cone_tokens"], x["origin_tokens"]) for x in graph.cone_sizes(files, df).collect()}
    tokens = lambda n: 3 if n < "d1" else 1
    for repo, n in sizes:
        cone = [w[2] for w in want if w[:2] == (repo, n)]
        assert sizes[repo, n] == (len(cone), sum(map(tokens, cone)), tokens(n))
    assert len(sizes) == len({w[:2] for w in want})


def test_methods_of_winning_records(spark):
    symbols = spark.createDataFrame([("r", "T.m", f, "method", 1) for f in ("a.ts", "b.ts", "c.ts")] + [("r", "U.m", "b.ts", "interface_method", 2), ("r", "f", "a.ts", "function", 3)], "repo string, name string, file string, kind string, pos long")
    calls = spark.createDataFrame([("r", "x.ts", "m"), ("r", "x.ts", "m"), ("r", "c.ts", "m"), ("r", "a.ts", "f"), ("r", "y.ts", "none")], "repo string, caller_file string, called_name string")
    got = sorted(tuple(e) for e in graph.call_file_edges(calls, symbols).collect())
    assert got == [("r", "c.ts", "b.ts"), ("r", "x.ts", "b.ts"), ("r", "x.ts", "c.ts")]


def test_substring_join(spark, monkeypatch):
    texts = spark.createDataFrame([("r", "abcabc"), ("r", "é [id] (x)"), ("q", "abc"), ("r", None), ("r", "")], "repo string, text string")
    patterns = spark.createDataFrame([("r", "abc"), ("r", "b"), ("r", "[id]"), ("r", "zzz"), ("q", ""), ("r", None), ("r", "é")], "repo string, p string")
    want = [("q", "abc", ""), ("r", "abcabc", "abc"), ("r", "abcabc", "b"), ("r", "é [id] (x)", "[id]"), ("r", "é [id] (x)", "é")]
    assert sorted(tuple(r) for r in containing(texts, "text", patterns, "p", ("repo",)).collect()) == want
    monkeypatch.setattr("depscope.operators.matching.BLOCK_BYTES", 30)
    assert sorted(tuple(r) for r in containing(texts, "text", patterns, "p", ("repo",)).collect()) == want
    assert containing(texts, "text", patterns.limit(0), "p", ("repo",)).count() == 0


def test_changes_with_any_path(spark):
    paths = ["app/[id]/page.tsx", "app/(shop)/x.ts", "a b/c.ts", "src/é.ts", "b/c.ts", "ok.ts"]
    lines = ["app/[id]/page.tsx(3,1): error TS1: x", "ERROR in app/(shop)/x.ts", "a b/c.ts: Error", "a b/c.ts: Error", "xsrc/é.tsx error", "ok.ts fine", None]
    changes = spark.createDataFrame([(p,) for p in paths], "file string")
    log = spark.createDataFrame([(t,) for t in lines], "line_text string")
    got = {r["file"]: (r["errors"], r["valid"]) for r in reports.validate_changes(changes, log).collect()}
    assert got == {"app/[id]/page.tsx": (1, False), "app/(shop)/x.ts": (1, False), "a b/c.ts": (2, False), "src/é.ts": (1, False), "b/c.ts": (2, False), "ok.ts": (0, True)}


def test_importers_of_changes_without_callers(spark):
    changed = spark.createDataFrame([("r", "1", "src/index.ts"), ("r", "2", "lib/index.ts"), ("r", "3", "x.ts"), ("q", "1", "src/index.ts")], "repo string, change_id string, file string")
    callers = spark.createDataFrame([("r", "3")], "repo string, change_id string")
    imports = spark.createDataFrame([("r", "a.ts", "src/index.ts"), ("r", "b.ts", "old/src/index.tsx"), ("r", "c.ts", None), ("r", "d.ts", "x.ts")], "repo string, importer_file string, imported_file string")
    assert sorted(tuple(r) for r in measures.import_callers(changed, callers, imports).collect()) == [("r", "1", "a.ts"), ("r", "1", "b.ts")]


def test_savings_of_a_large_session(spark):
    """A million queries on a repository of hundreds of millions of tokens: their product, in thousandths of a percent, is beyond a long."""
    measured = spark.range(1000000).selectExpr("'r' as repo", "id % 1000 as cone_tokens")
    total = spark.createDataFrame([("r", 400000000)], "repo string, total_tokens long")
    got = measures.session_stats(measured, total).first()
    assert (got["queries"], got["total_tokens"], got["tokens_saved"], got["reduction_pct"]) == (1000000, 4 * 10**14, 4 * 10**14 - 499500000, 99.999)
    cuts = spark.createDataFrame([(1, 3), (0, 5), (2, 3), (5, 0)], "a long, b long").select(measures.percent(F.col("a"), F.col("b"))).collect()
    assert [c[0] for c in cuts] == [33.333, 0.0, 66.666, None]


def test_a_round_writes_new_bits_only(spark, tmp_path, monkeypatch):
    """What a closure of n steps leaves on disk is its bits and its input, not the state of each round."""
    from depscope.operators import graph as g

    written = []
    monkeypatch.setattr(g, "settled", lambda df, name: written.append(name) or df.localCheckpoint())
    edges = spark.createDataFrame([("r", f"n{k}", f"n{k + 1}") for k in range(4)], "repo string, src string, dst string")
    assert graph.closure(edges).count() == 15
    assert "reached" not in written and len(written) == 3
