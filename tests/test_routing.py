"""Routing, deliveries and coverage against plain loops, and what the plans send."""

import random

import pytest
from pyspark.sql import functions as F

from depscope.operators import activity, reports

WINDOWS = [(64, 50), (2, 7), (2, 0)]


def tables(spark, seed):
    r = random.Random(seed)
    reads = [(r.choice("rrrq"), f"a{r.randrange(6)}", f"s{r.randrange(5)}", r.randrange(300)) for _ in range(400)]
    deltas = [("r", k, f"a{r.randrange(6)}", y, t) for k in range(60) for t in [r.randrange(320)] for y in r.sample([f"s{i}" for i in range(6)], r.randrange(1, 5))]
    emitter = {d[1]: d[2] for d in reversed(deltas)}
    deltas = [(p, k, emitter[k], y, t) for p, k, _, y, t in deltas]
    flushes = [("r", f"a{r.randrange(5)}", 1000 + k, r.randrange(250)) for k in range(30)]
    shapes = ("repo string, agent_id string, symbol string, t long", "repo string, delta_id long, emitting_agent string, symbol string, t long", "repo string, agent_id string, flush_id long, t long")
    frames = [spark.createDataFrame(rows, s).withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")).drop("t") for rows, s in zip((reads, deltas, flushes), shapes, strict=True)]
    return reads, deltas, flushes, *frames


def plain(reads, deltas, window):
    want = {}
    for repo, k, e, y, t in deltas:
        for p, a, s, at in reads:
            if p == repo and s == y and a != e and t - window <= at <= t:
                want.setdefault((k, a), set()).add(y)
    return {k: ",".join(sorted(v)) for k, v in want.items()}


@pytest.mark.parametrize("listed,window", WINDOWS)
def test_deliveries_with_short_and_long_lists(spark, monkeypatch, listed, window):
    monkeypatch.setattr(activity, "LISTED", listed)
    reads, deltas, flushes, r, d, f = tables(spark, 4)
    want, at = plain(reads, deltas, window), {x[1]: x[4] for x in deltas}
    by = {k: min(((t, i) for _, a, i, t in flushes if a == k[1] and t >= at[k[0]]), default=(0, None))[1] for k in want}
    got = activity.route_deltas(d, r, window).collect()
    assert len(got) == len(want) and {(x["delta_id"], x["agent_id"]): x["changed_symbols"] for x in got} == want
    got = activity.deliver(d, r, f, window).collect()
    assert len(got) == len(want) and {(x["delta_id"], x["agent_id"]): (x["changed_symbols"], x["delivered_by"]) for x in got} == {k: (v, by[k]) for k, v in want.items()}
    waiting = activity.deliver(d, r, f, window, pending=True).collect()
    assert sorted((x["delta_id"], x["agent_id"], x["changed_symbols"]) for x in waiting) == sorted((*k, v) for k, v in want.items() if by[k] is None)


def test_two_emitters_of_one_delta(spark):
    d = spark.createDataFrame([("r", 1, "a", "x"), ("r", 1, "b", "y"), ("r", 1, "b", "x")], "repo string, delta_id long, emitting_agent string, symbol string").withColumn("ts", F.timestamp_seconds(F.lit(100)))
    r = spark.createDataFrame([("r", "a", "x"), ("r", "b", "y"), ("r", "c", "x")], "repo string, agent_id string, symbol string").withColumn("ts", F.timestamp_seconds(F.lit(90)))
    assert sorted((x["agent_id"], x["changed_symbols"]) for x in activity.route_deltas(d, r, 50).collect()) == [("a", "x"), ("c", "x")]


def test_pairs_leave_the_join_unsorted(spark):
    """Nothing is sent or grouped between the join of deltas and reads and the result."""
    _, _, _, r, d, f = tables(spark, 5)
    for out in (activity.route_deltas(d, r, 50), activity.deliver(d, r, f, 50)):
        lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
        first = lambda word: next(k for k, line in enumerate(lines) if word in line)
        assert first("Join") < min(first("Exchange"), first("Aggregate") if any("Aggregate" in x for x in lines) else len(lines))


@pytest.mark.parametrize("listed,window", WINDOWS)
def test_coverage_without_the_pairs(spark, monkeypatch, listed, window):
    monkeypatch.setattr(activity, "LISTED", listed)
    reads, deltas, _, r, d, _ = tables(spark, 6)
    files = {"s0": ["f0"], "s1": ["f1", "g1"], "s2": [], "s3": ["f0"], "s4": ["f4"], "s5": ["h"]}
    calls = [("r", f, f"a{k}") for f, who in {"f0": (0, 1, 9), "f1": (1, 2), "g1": (3,), "f4": (5, 9), "h": ()}.items() for k in who]
    named = spark.createDataFrame([(s, f) for s, fs in files.items() for f in fs], "symbol string, file string")
    dependents = spark.createDataFrame(calls, "repo string, file string, agent_id string")
    should = {(k, a) for _, k, e, y, _ in deltas for f in files[y] for _, g, a in calls if g == f and a != e}
    told = set(plain(reads, deltas, window))
    args = d.join(named, "symbol", "left"), dependents, r, window
    assert sorted((x["delta_id"], x["agent_id"]) for x in reports.missed_of_deltas(*args).collect()) == sorted(should - told)
    want = {k: (len(own), len(own & told)) for k in {s[0] for s in should} for own in [{s for s in should if s[0] == k}]}
    assert {x["delta_id"]: (x["callers"], x["notified"]) for x in reports.coverage_of_deltas(*args).collect()} == want
