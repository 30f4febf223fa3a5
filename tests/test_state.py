"""Queues, streams in several batches, snapshots and graphs that are updated."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from depscope.operators import activity, graph, incremental, reports
from depscope.streaming import routing

EVENT = "agent_id string, ts timestamp, turn int, id long"


def test_an_agent_may_lie_in_many_parts(spark):
    r = random.Random(5)
    n = [("r", r.choice("ab"), r.randrange(60), k) for k in range(200)]
    f = [("r", r.choice("aab"), r.randrange(50), 1000 + k) for k in range(25)]
    notes = spark.createDataFrame(n, "repo string, agent_id string, t long, delta_id long").withColumn("ts", F.timestamp_seconds("t"))
    flushes = spark.createDataFrame(f, "repo string, agent_id string, t long, flush_id long").withColumn("ts", F.timestamp_seconds("t"))
    got = {(x["agent_id"], x["delta_id"]): x["delivered_by"] for x in activity.pending_after_flush(notes, flushes).collect()}
    for _, a, t, k in n:
        assert got[a, k] == min(((u, i) for _, b, u, i in f if b == a and u >= t), default=(0, None))[1]
    assert activity.pending_after_flush(notes.limit(0), flushes).count() == 0


def queue(spark, base, batches, delay):
    """Deliveries of events that come in batches, each a run of its own; how many rows were dropped as late."""
    late = 0
    for rows in batches:
        events = spark.createDataFrame(rows, "agent_id string, t double, turn int, id long").withColumn("ts", F.timestamp_seconds("t"))
        events.select("agent_id", "ts", "turn", "id").coalesce(1).write.mode("append").parquet(f"{base}/events")
        late += routing.run_to_table(routing.pending_queue(spark.readStream.schema(EVENT).parquet(f"{base}/events"), delay), f"{base}/out", f"{base}/checkpoint")
    return sorted(tuple(x) for x in spark.read.schema("agent_id string, delta_id long, delivered_by long").parquet(f"{base}/out").collect()), late


def test_late_and_split_events_count_by_their_time(spark, tmp_path):
    batches = [
        [("a", 10.0, 1, 100), ("b", 3.0, 0, 7)],
        [("a", 5.0, 0, 1), ("a", 12.0, 0, 2), ("a", 20.0, 1, 101), ("b", 3.0, 1, 102)],  # 1 comes after the flush that delivers it
        [("a", 20.0, 0, 3), ("a", 20.5, 0, 4), ("b", 90.0, 1, 103), ("b", 90.0, 1, 104)],
        [("a", 1.0, 0, 5), ("", 10000.0, 1, -1)],  # 5 is too late
    ]
    got, late = queue(spark, tmp_path, batches, 30)
    assert got == [("a", 1, 100), ("a", 2, 101), ("a", 3, 101), ("b", 7, 102)] and late == 1


def test_a_hit_is_told_once_over_all_batches(spark, tmp_path):
    delta = "repo string, delta_id long, emitting_agent string, symbol string, t double"
    read = "repo string, agent_id string, symbol string, t double"
    deltas = [[("r", 1, "a", "s", 100.0)], [("r", 2, "a", "s", 130.0)], [("r", 9, "z", "s", 9000.0)]]
    reads = [[("r", "b", "s", 90.0), ("r", "b", "s", 95.0), ("r", "a", "s", 99.0)], [("r", "b", "s", 99.0), ("r", "c", "s", 120.0)], [("r", "y", "s", 9000.0)]]
    for d, r in zip(deltas, reads, strict=True):
        spark.createDataFrame(d, delta).withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(f"{tmp_path}/d")
        spark.createDataFrame(r, read).withColumn("read_ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(f"{tmp_path}/r")
        streams = [spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{x}").schema).parquet(f"{tmp_path}/{x}") for x in "dr"]
        routing.run_to_table(routing.route_stream(*streams, window_s=50), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = [tuple(x)[1:4] for x in spark.read.schema("repo string, delta_id long, agent_id string, symbol string, ts timestamp").parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == [(1, "b", "s"), (2, "b", "s"), (2, "c", "s"), (9, "y", "s")]


def test_a_save_counts_as_a_whole(spark, tmp_path):
    shape = {"a": "repo string, x long", "b": "repo string, y long"}
    table = lambda rows, name: spark.createDataFrame(rows, shape[name])
    read = lambda: {n: sorted(map(tuple, df.collect()), key=str) for n, df in reports.load_tables(spark, str(tmp_path), shape).items()}
    assert read() == {"a": [], "b": []}
    reports.save_tables({"a": table([("p", 1), ("p", 1), ("q", 2)], "a"), "b": table([("p", 3), ("q", 4), (None, 5)], "b")}, str(tmp_path))
    first = {"a": [("p", 1), ("q", 2)], "b": [("-", 5), ("p", 3), ("q", 4)]}
    assert read() == first
    broken = table([("p", 9)], "b").withColumn("y", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        reports.save_tables({"a": table([("p", 8)], "a"), "b": broken}, str(tmp_path))
    assert read() == first
    loaded = reports.load_tables(spark, str(tmp_path), shape)
    reports.save_tables({"a": loaded["a"].filter("repo = 'p'"), "b": loaded["b"].limit(0)}, str(tmp_path))  # what was loaded is saved over itself
    assert read() == {"a": [("p", 1), ("q", 2)], "b": [("-", 5), ("q", 4)]}
    reports.save_tables({"a": table([], "a"), "b": table([], "b")}, str(tmp_path), repos=spark.createDataFrame([("q",)], "repo string"))
    assert read() == {"a": [("p", 1)], "b": [("-", 5)]}


def random_tree(r, files):
    """Symbols, calls and imports of a tree in which names are defined several times, and some by methods."""
    names = [f"f{k}" for k in range(12)] + [f"T{k}.m{k % 3}" for k in range(6)]
    out = {"files": [], "symbols": [], "calls": [], "imports": []}
    for path in files:
        out["files"].append(("r", path))
        for k, name in enumerate(r.sample(names, 3)):
            out["symbols"].append(("r", name, path, "method" if "." in name else "function", k))
        out["calls"] += [("r", path, n) for n in r.sample([f"f{k}" for k in range(14)] + ["m0", "m1", "m2", "m3"], 4)]
        out["imports"] += [("r", path, k, f"./{r.randrange(16)}") for k in range(2)]
    return out


SHAPES = {"files": "repo string, path string", "symbols": "repo string, name string, file string, kind string, pos long", "calls": "repo string, caller_file string, called_name string", "imports": "repo string, importer_file string, pos long, import_path string"}


def test_an_update_equals_a_graph_built_anew(spark):
    r = random.Random(int(uuid.UUID("00000000-0000-0000-0000-00000000000b")))
    old = random_tree(r, [f"{k}{s}" for k in range(12) for s in (".ts", ".tsx")[: 1 + k % 2]])
    later = random_tree(r, [f"{k}.ts" for k in range(3, 15)])
    touched = {"1.ts", "1.tsx", "3.ts", "4.ts", "12.ts", "13.ts", "14.ts"}  # 1 goes, 3 and 4 change, others come
    own = {"files": 1, "symbols": 2, "calls": 1, "imports": 1}
    frame = lambda rows, name: spark.createDataFrame(rows, SHAPES[name])
    fresh = {n: frame([x for x in rows if x[own[n]] in touched], n) for n, rows in later.items()}
    new = {n: frame([x for x in old[n] if x[own[n]] not in touched] + [x for x in later[n] if x[own[n]] in touched], n) for n in old}
    before = {n: frame(rows, n) for n, rows in old.items()}
    before |= {"edges": incremental.edge_counts(before["calls"], before["symbols"]), "resolved": graph.resolve_imports(before["imports"], before["files"])}
    after = incremental.update_graph(before, fresh, spark.createDataFrame([("r", f) for f in sorted(touched)], "repo string, file string"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(after["edges"].select("repo", "caller_file", "callee_file", "n")) == rows(incremental.edge_counts(new["calls"], new["symbols"]).select("repo", "caller_file", "callee_file", "n"))
    want = graph.resolve_imports(new["imports"], new["files"])
    assert rows(after["resolved"].select(*want.columns)) == rows(want)
    assert 0 < after["changed_edges"].count() < after["edges"].count()
    same = incremental.update_graph(before, {n: df.limit(0) for n, df in fresh.items()}, spark.createDataFrame([], "repo string, file string"))
    assert same["changed_edges"].count() == same["changed_imports"].count() == 0 and rows(same["edges"].select(*before["edges"].columns)) == rows(before["edges"])


def test_a_tree_is_listed_in_tasks(spark, tmp_path):
    from depscope.sources.trees import scan_source_files

    root = tmp_path / "tree"
    for name, content in {"a.ts": b"x", "deep/er/still/__init__.py": b"y = 1", "deep/B.TSX": b"\xff", "deep/.hidden.go": b"", "z.rs": b"a\0b", "deep/no.md": b"m"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    (root / "gone.png").symlink_to("/nowhere/at/all")  # would fail if it were opened
    (root / "deep/up").symlink_to(root)
    (root / "empty").mkdir()
    got = {r["path"]: (r["lang"], r["content"], r["n_bytes"], r["parse_ok"]) for r in scan_source_files(spark, str(root)).collect()}
    assert got == {
        "a.ts": ("typescript", "x", 1, True), "deep/er/still/__init__.py": ("python", "y = 1", 5, True), "deep/B.TSX": ("typescript", "�", 1, True),
        "deep/.hidden.go": ("go", "", 0, True), "z.rs": ("rust", "a\0b", 3, False),
    }
    assert scan_source_files(spark, str(root / "empty")).count() == 0


def test_a_run_summary_lists_the_failures(spark):
    """A row for each failure; runs without any, runs without a name, tests without a result or a suite and repeated ones count too."""
    rows = [("a", "s", "t1", False), ("a", "s", "t1", False), ("a", "z", "t2", None), ("a", "z", "t3", True), ("b", "s", "t1", True), (None, None, "t9", False), (None, "s", "t1", True)]
    results = spark.createDataFrame(rows, "run_id string, suite string, name string, passed boolean")
    got = sorted((tuple(r) for r in reports.validation_run_summary(results).collect()), key=str)
    a, none = ("a", 2, 4, 1, 3, False), (None, 1, 2, 1, 1, False)
    assert got == sorted([(*a, "s", "t1"), (*a, "s", "t1"), (*a, "z", "t2"), ("b", 1, 1, 1, 0, True, None, None), (*none, None, "t9")], key=str)
    assert reports.validation_run_summary(results.limit(0)).count() == 0
