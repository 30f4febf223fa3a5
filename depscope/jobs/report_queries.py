"""Queries on the ledger, diagnostics, validation and the streams, and what DuckDB should find."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depscope.jobs import registry as base
from depscope.operators import activity, graph, reports
from depscope.sources.derived import duck, source
from depscope.sources.shared import shared_dir
from depscope.streaming import routing


def _attempts(s: SparkSession, d: str) -> DataFrame:
    return source(s, d, "fx_tokens").withColumn("attempt", F.col("record_id") % 5 + 1)


def _commits(s: SparkSession, d: str) -> DataFrame:
    """The changed names of each file as deltas: a file is changed by the agent of its number, at the time of the delta of its number; the i-th symbol that is read stands for names that end in i."""
    diff = activity.symbol_diff(source(s, d, "fx_old"), source(s, d, "fx_new"))
    number = F.expr("cast(substring(file, 2) as bigint)")
    times = source(s, d, "fx_deltas").groupBy((F.col("delta_id") % 50).alias("n")).agg(F.max("ts").alias("ts"))
    named = diff.select("repo", "file", F.concat(F.lit("sym_"), F.expr("right(name, 1)")).alias("symbol"), number.alias("n")).distinct()
    return named.join(times, "n").select("repo", F.col("n").alias("delta_id"), "file", F.concat(F.lit("agent_"), "n").alias("emitting_agent"), "symbol", "ts")


def _commit_deltas(s: SparkSession, d: str) -> DataFrame:
    """Counts of each changed file, and the notifications that its delta was routed to."""
    commits = _commits(s, d)
    routed = activity.route_deltas(commits.drop("file"), source(s, d, "fx_reads"), base.WINDOW_S)
    sent = routed.join(commits.select("delta_id", "file").distinct(), "delta_id")
    return activity.commit_deltas(activity.symbol_diff(source(s, d, "fx_old"), source(s, d, "fx_new")), sent)


def _dependents(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Deltas with the files that their symbols stand for, the agents of the files that call into a file or import it, each the agent of its package's number, and the reads."""
    deltas = source(s, d, "fx_deltas").withColumn("name", F.concat(F.lit("fn"), F.regexp_extract("symbol", "([0-9]+)", 1).cast("long") + 1))
    files = graph.unique_symbols(source(s, d, "fx_tree_symbols")).select("repo", "name", "file")
    deps = base._edges(s, d).select("repo", F.col("dst").alias("file"), F.concat(F.lit("agent_"), F.regexp_extract("src", "^pkg([0-9]+)", 1)).alias("agent_id")).distinct()
    return deltas.join(files, ["repo", "name"], "left").drop("name"), deps, source(s, d, "fx_reads"), base.WINDOW_S


def _events(s: SparkSession, d: str) -> DataFrame:
    table = s.read.parquet(f"{d}/events.parquet")
    return s.readStream.schema(table.schema).option("maxFilesPerTrigger", 64).parquet(f"{d}/events*.parquet")


def _stream_route(s: SparkSession, d: str) -> DataFrame:
    source(s, d, "events")  # sends the package
    path = f"{shared_dir(s)}/routed-{uuid.uuid4().hex}"
    symbol = lambda n: F.concat(F.lit("sym_"), ((F.regexp_extract("props", "([0-9]+)", 1).cast("long") + n) % 10).cast("string"))
    agent = F.concat(F.lit("agent_"), F.col("user_id").cast("string"))
    ts = F.col("ts").cast("timestamp")
    deltas = _events(s, d).filter("event_type = 'purchase'").select(F.lit("main").alias("repo"), F.col("event_id").alias("delta_id"), agent.alias("emitting_agent"), F.explode(F.array(symbol(0), symbol(3))).alias("symbol"), ts.alias("ts"))
    reads = _events(s, d).filter("event_type in ('view', 'click')").select(F.lit("main").alias("repo"), agent.alias("agent_id"), symbol(0).alias("symbol"), ts.alias("read_ts"))
    routing.run_to_table(routing.route_stream(deltas, reads, base.WINDOW_S), f"{path}/hits", f"{path}/checkpoint")
    hits = s.read.schema("repo string, delta_id long, agent_id string, symbol string, ts timestamp").parquet(f"{path}/hits")
    return hits.groupBy("delta_id", "agent_id").agg(F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("changed_symbols"))


def _queue_events(s: SparkSession, d: str) -> DataFrame:
    n = base._routed(s, d).select("agent_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(0).alias("turn"), F.col("delta_id").alias("id"))
    f = source(s, d, "fx_flushes").select("agent_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(1).alias("turn"), F.col("flush_id").alias("id"))
    return n.unionByName(f)


#: A flush of no agent, long after all events: the watermark passes them.
_END = "SELECT '' AS agent_id, timestamp'2200-01-01' AS ts, 1 AS turn, -1L AS id"


def _queue_stream(s: SparkSession, d: str, path: str) -> DataFrame:
    _queue_events(s, d).unionByName(s.sql(_END)).write.parquet(f"{path}/events")
    return routing.pending_queue(s.readStream.schema("agent_id string, ts timestamp, turn int, id long").parquet(f"{path}/events"))


def _stream_queue(s: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(s)}/queue-{uuid.uuid4().hex}"
    routing.run_to_table(_queue_stream(s, d, path), f"{path}/delivered", f"{path}/checkpoint")
    return s.read.schema("agent_id string, delta_id long, delivered_by long").parquet(f"{path}/delivered")


def _stream_notify(s: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(s)}/notify-{uuid.uuid4().hex}"

    def write(rows: DataFrame, batch: int) -> None:
        rows.groupBy("agent_id").agg(F.count(F.lit(1)).alias("delivered")).write.mode("overwrite").parquet(f"{path}/batches/batch={batch}")

    routing.notify(_queue_stream(s, d, path), write, f"{path}/checkpoint").awaitTermination()
    return s.read.schema("agent_id string, delivered long").parquet(f"{path}/batches/*").groupBy("agent_id").agg(F.sum("delivered").alias("delivered"))


def _saved(s: SparkSession, d: str) -> DataFrame:
    """Sums over each table and repository after two repositories were saved, one of them twice, the other at last without reads, and loaded again."""
    path = f"{shared_dir(s)}/graph-{uuid.uuid4().hex}"
    tables = {"symbols": source(s, d, "fx_symbols"), "calls": source(s, d, "fx_calls"), "imports": base._import_edges(s, d), "reads": source(s, d, "fx_reads").withColumn("ts", F.col("ts").cast("string"))}
    other = {name: df.withColumn("repo", F.lit("other")) for name, df in tables.items()}
    keys = {"symbols": ["repo", "name", "file"], "calls": ["repo", "caller_file", "called_name"], "imports": ["repo", "src", "dst"]}
    for saved in (tables, other, tables, other | {"reads": other["reads"].limit(0)}):
        reports.save_tables(saved, path, keys)
    back = reports.load_tables(s, path, {"symbols": "name string, repo string", "calls": "called_name string, repo string", "imports": "src string, repo string", "reads": "read_id long, repo string"})
    out = None
    for name, df in back.items():
        first = F.col(df.columns[0]).cast("string")
        one = df.groupBy("repo").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.sum(F.length(first)).alias("letters"), F.min(first).alias("least"))
        out = one if out is None else out.unionByName(one)
    return out


def _state(s: SparkSession, d: str) -> DataFrame:
    """Reads and pending notifications of each agent after they were saved (over an earlier state) and loaded."""
    path = f"{shared_dir(s)}/state-{uuid.uuid4().hex}"
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0)
    reads = source(s, d, "fx_reads").select("agent_id", "symbol", seconds.alias("ts"))
    routed = base.delivered(s, d, pending=True)
    pending = routed.select("agent_id", F.lit("a \"b\".ts").alias("changed_file"), F.split("changed_symbols", ",").alias("changed_symbols"), F.lit("line\n").alias("new_src"), seconds.alias("timestamp"))
    reports.save_state(reads.limit(5), pending.limit(0), path)
    reports.save_state(reads, pending, path)
    r, p = reports.load_state(s, path)
    r = r.groupBy("agent_id").agg(F.count(F.lit(1)).alias("reads"), F.max("ts").alias("last_read"))
    p = p.filter((F.col("changed_file") == 'a "b".ts') & (F.col("new_src") == "line\n")).groupBy("agent_id").agg(F.sum(F.size("changed_symbols")).alias("symbols"), F.max("timestamp").alias("last_pending"))
    return r.join(p, "agent_id", "full_outer")


def _trace(s: SparkSession, d: str) -> DataFrame:
    """Events of each run and kind from JSON lines with data of two shapes, blank and broken lines."""
    path = f"{shared_dir(s)}/trace-{uuid.uuid4().hex}"
    t = source(s, d, "fx_tokens")
    data = F.when(F.col("passed"), F.to_json(F.struct(F.col("prompt_tokens").alias("metric"), "passed"))).otherwise(F.to_json(F.struct(F.struct(F.col("prompt_tokens").alias("metric")).alias("inner"))))
    stamp = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    line = F.concat(F.lit('{"trace_id":"'), "run_id", F.lit('","timestamp":"'), stamp, F.lit('","event":"'), "task_id", F.lit('","data":'), data, F.lit(',"duration_ms":'), F.when(F.col("record_id") % 3 == 0, F.lit("null")).otherwise(F.col("record_id").cast("string")), F.lit("}"))
    lines = t.select(F.explode(F.array(line, F.when(F.col("record_id") % 50 == 0, F.lit('{"trace_id":')), F.when(F.col("record_id") % 70 == 0, F.lit("")))).alias("value")).filter("value is not null")
    lines.write.text(path)
    metric = F.coalesce(F.get_json_object("data", "$.metric"), F.get_json_object("data", "$.inner.metric")).cast("long")
    return reports.read_trace_log(s, path).groupBy("trace_id", "event").agg(F.count(F.lit(1)).alias("events"), F.count("duration_ms").alias("timed"), F.sum(metric).alias("metric"), F.unix_seconds(F.max("ts")).alias("last"))


def _recovered(s: SparkSession, d: str) -> DataFrame:
    """Deliveries of a queue that was stopped with notifications in it, and started again from its checkpoint."""
    path = f"{shared_dir(s)}/recovery-{uuid.uuid4().hex}"
    events = _queue_events(s, d)
    cut = events.agg(F.expr("timestamp_micros(cast((min(unix_micros(ts)) + max(unix_micros(ts))) / 2 as bigint))").alias("cut"))
    halves = events.crossJoin(F.broadcast(cut))  # one row
    for rows in (halves.filter("ts < cut").drop("cut"), halves.filter("ts >= cut").drop("cut").unionByName(s.sql(_END))):
        rows.write.mode("append").parquet(f"{path}/events")
        stream = routing.pending_queue(s.readStream.schema("agent_id string, ts timestamp, turn int, id long").parquet(f"{path}/events"))
        routing.run_to_table(stream, f"{path}/delivered", f"{path}/checkpoint")
    return s.read.schema("agent_id string, delta_id long, delivered_by long").parquet(f"{path}/delivered")


def _appended(s: SparkSession, d: str) -> DataFrame:
    """The first half of the records is saved, then all are appended: each is there once."""
    path, records = f"{shared_dir(s)}/ledger-{uuid.uuid4().hex}", base._records(s, d).select("record_id", "run_id", "cost_usd")
    records.filter("record_id % 2 = 0").write.parquet(path)
    reports.append_ledger(records, s.read.parquet(path), path)
    return s.read.schema(records.schema).parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("records"))


QUERIES = {
    "cost_rate_lookup": lambda s, d: reports.with_rates(source(s, d, "fx_tokens")).select("record_id", "model", "rate_in", "rate_out"),
    "token_records": lambda s, d: base._records(s, d).select("record_id", "run_id", "agent_id", "task_id", "prompt_tokens", "completion_tokens", "model", "passed", "cost_usd"),
    "load_run": lambda s, d: reports.load_run(base._records(s, d), "run_7").select("record_id", "agent_id", "cost_usd"),
    "runs_total": lambda s, d: reports.runs_total(base._records(s, d)),
    "aggregate_summary": lambda s, d: reports.aggregate_summary(base._records(s, d)),
    "format_cost_tokens": lambda s, d: base._records(s, d).select("record_id", reports.format_cost(F.col("cost_usd")).alias("cost"), F.format_number("prompt_tokens", 0).alias("tokens")),
    "append_ledger": _appended,
    "save_load_subscription_state": _state,
    "read_trace_log": _trace,
    "stream_recovery": _recovered,
    "export_ledger_json": lambda s, d: reports.ledger_json(base._records(s, d).drop("ts", "passed", "cost_usd")),
    "save_load_graph": _saved,
    "cone_diagnostics": lambda s, d: reports.cone_diagnostics(base._new_diags(s, d), base.changed_files(s, d)),
    "definition_first": lambda s, d: reports.definition_first(base._new_diags(s, d), base.changed_files(s, d)),
    "split_definition_caller": lambda s, d: reports.split_definition_caller(base._new_diags(s, d), base.changed_files(s, d)),
    "format_diagnostics": lambda s, d: reports.format_diagnostics(activity.dedup_diagnostics(base._new_diags(s, d), base.changed_files(s, d))),
    "attempt_summary": lambda s, d: reports.attempt_summary(_attempts(s, d)),
    "attempt_routing": lambda s, d: _attempts(s, d).select("record_id", "attempt", reports.attempt_routing(F.col("attempt")).alias("task")),
    "validate_changes": lambda s, d: reports.validate_changes(source(s, d, "fx_changed_paths"), source(s, d, "fx_diag_log")),
    "suite_pass_rate": lambda s, d: reports.suite_pass_rate(source(s, d, "fx_results")),
    "validation_run_summary": lambda s, d: reports.validation_run_summary(source(s, d, "fx_results")),
    "bus_state": lambda s, d: reports.bus_state(source(s, d, "fx_reads"), base.delivered(s, d, pending=True)),
    "delta_coverage": lambda s, d: reports.coverage_of_deltas(*_dependents(s, d)).drop("repo"),
    "delta_missed": lambda s, d: reports.missed_of_deltas(*_dependents(s, d)).drop("repo"),
    "validation_failures": lambda s, d: reports.validation_failures(source(s, d, "fx_results")),
    "commit_deltas": _commit_deltas,
    "stream_route_deltas": _stream_route,
    "stream_pending_queue": _stream_queue,
    "stream_notify_callback": _stream_notify,
}

_F = {k: f"({duck(k)})" for k in ("fx_files", "fx_symbols", "fx_calls", "fx_reads", "fx_deltas", "fx_tokens", "fx_diag_log", "fx_results", "fx_flushes", "fx_old", "fx_new", "fx_changed_paths")}
_O = base.ORACLES
_CHANGED = base._CHANGED
_NEW = f"({base._NEW})"
_OWN = f"SELECT n.*, c.file IS NOT NULL AS own FROM {_NEW} n LEFT JOIN {_CHANGED} c ON c.run_id = n.run_id AND c.file = n.file"
_TEXT = "printf('$%.{0}f', floor(cost_usd * 1{1} + 0.5) / 1{1})"
_COST = f"CASE WHEN cost_usd < 0.01 THEN {_TEXT.format(6, '000000')} WHEN cost_usd < 1 THEN {_TEXT.format(4, '0000')} ELSE {_TEXT.format(2, '00')} END"
_DONE = f"SELECT * FROM ({base._DELIVERED}) WHERE delivered_by IS NOT NULL"

#: Agents that should hear of a delta, and whether they did.
_SHOULD = f"""SELECT x.delta_id, x.agent_id, hit FROM (SELECT DISTINCT d.delta_id, 'agent_' || regexp_extract(e.src, '^pkg([0-9]+)', 1) AS agent_id, emitting_agent FROM {_F['fx_deltas']} d
JOIN ({base._WINNERS}) w ON w.name = 'fn' || (CAST(regexp_extract(d.symbol, '([0-9]+)', 1) AS BIGINT) + 1) JOIN ({base._TREE_EDGES}) e ON e.dst = w.file) x
LEFT JOIN (SELECT delta_id AS i, agent_id AS a, 1 AS hit FROM ({base._ROUTED})) ON i = delta_id AND a = agent_id WHERE x.agent_id <> emitting_agent"""

ORACLES = {
    "cost_rate_lookup": f"SELECT record_id, model, CASE WHEN lower(model) LIKE '%haiku%' THEN 25 ELSE 300 END::BIGINT AS rate_in, CASE WHEN lower(model) LIKE '%haiku%' THEN 125 ELSE 1500 END::BIGINT AS rate_out FROM {_F['fx_tokens']}",
    "token_records": f"SELECT * EXCLUDE (ts) FROM ({base._COSTED})",
    "load_run": f"SELECT record_id, agent_id, cost_usd FROM ({base._COSTED}) WHERE run_id = 'run_7' ORDER BY ts, record_id",
    "runs_total": f"""SELECT CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
CAST(sum(passed) AS BIGINT) AS passed, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(CAST(round(cost_usd * 100000000) AS BIGINT)) AS DOUBLE) / 100000000 AS cost_usd FROM ({_O['list_runs']})""",
    "aggregate_summary": f"""SELECT runs, calls, tokens, CAST(u AS DOUBLE) / 100000000 AS cost, floor(CAST(p * 100000 AS DOUBLE) / j) / 1000 AS pass_rate, floor(CAST(u * 10 AS DOUBLE) / tokens) / 1000000 AS cost_per_1k FROM (
SELECT count(DISTINCT run_id) AS runs, count(*) AS calls, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, CAST(sum(units) AS BIGINT) AS u, count(*) FILTER (passed) AS p, count(passed) AS j FROM ({base._UNITS}))""",
    "format_cost_tokens": f"SELECT record_id, {_COST} AS cost, format('{{:,}}', prompt_tokens) AS tokens FROM ({base._COSTED})",
    "append_ledger": f"SELECT run_id, count(*) AS records FROM {_F['fx_tokens']} GROUP BY run_id",
    "export_ledger_json": f"""SELECT run_id, record_id AS line, '{{"agent_id":"' || agent_id || '","completion_tokens":' || completion_tokens || ',"model":"' || model || '","prompt_tokens":' || prompt_tokens || ',"record_id":' || record_id || ',"task_id":"' || task_id || '"}}' AS json FROM {_F['fx_tokens']}
UNION ALL SELECT run_id, -row_number() OVER (PARTITION BY run_id ORDER BY CASE level WHEN 'run' THEN 1 WHEN 'agent' THEN 2 WHEN 'task' THEN 3 ELSE 4 END, key), '{{"level":"' || level || '",' || CASE level WHEN 'run' THEN '' ELSE '"key":"' || key || '",' END
|| '"prompt_tokens":' || prompt_tokens || ',"completion_tokens":' || completion_tokens || ',"cost_usd":"' || printf('%.8f', cost_usd) || '"' || ',"calls":' || calls || '}}' FROM ({_O['ledger_summary']})""",
    "save_load_graph": f"""SELECT r.repo, t.name, count(*) AS rows, CAST(sum(length(v)) AS BIGINT) AS letters, min(v) AS least FROM (SELECT 'symbols' AS name, name AS v FROM (SELECT DISTINCT name, file FROM {_F['fx_symbols']})
UNION ALL SELECT 'calls', called_name FROM {_F['fx_calls']} UNION ALL SELECT 'imports', src FROM ({base._IMPORT_EDGES}) UNION ALL SELECT 'reads', CAST(read_id AS VARCHAR) FROM {_F['fx_reads']}) t,
(SELECT 'main' AS repo UNION ALL SELECT 'other') r WHERE NOT (r.repo = 'other' AND t.name = 'reads') GROUP BY r.repo, t.name""",
    "cone_diagnostics": f"SELECT n.* FROM {_NEW} n WHERE EXISTS (SELECT 1 FROM {_CHANGED} c WHERE c.run_id = n.run_id AND (ends_with(n.file, c.file) OR ends_with(c.file, n.file)))",
    "definition_first": f"SELECT * EXCLUDE (own, has_own) FROM (SELECT *, bool_or(own) OVER (PARTITION BY run_id, attempt) AS has_own FROM ({_OWN})) WHERE own OR NOT has_own",
    "split_definition_caller": f"""SELECT *, CASE WHEN NOT definition_clean THEN 'fail' WHEN caller_errors > 0 THEN 'pass with a note' ELSE 'pass' END AS verdict FROM (
SELECT run_id, attempt, count(*) FILTER (own) AS definition_errors, count(*) FILTER (NOT own) AS caller_errors, count(*) FILTER (own) = 0 AS definition_clean FROM ({_OWN}) GROUP BY run_id, attempt)""",
    "format_diagnostics": f"SELECT run_id, attempt, string_agg('  ' || file || ':' || line || ':' || col || ' ' || code || ': ' || message, chr(10) ORDER BY rank) AS text FROM ({_O['dedup_diagnostics']}) GROUP BY run_id, attempt",
    "attempt_summary": f"""SELECT run_id, count(*) AS attempts, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, min(record_id % 5 + 1) FILTER (passed) AS first_pass, arg_min(model, (record_id % 5 + 1, model)) FILTER (passed) AS passed_by, coalesce(bool_or(passed), false) AS passed,
CAST(coalesce(sum(prompt_tokens + completion_tokens) FILTER (lower(model) LIKE '%haiku%'), 0) AS BIGINT) AS haiku_tokens, CAST(coalesce(sum(prompt_tokens + completion_tokens) FILTER (lower(model) LIKE '%sonnet%'), 0) AS BIGINT) AS sonnet_tokens
FROM {_F['fx_tokens']} GROUP BY run_id""",
    "attempt_routing": f"SELECT record_id, record_id % 5 + 1 AS attempt, CASE WHEN record_id % 5 = 0 THEN 'write' WHEN record_id % 5 < 3 THEN 'retry_' || (record_id % 5 + 1) ELSE 'escalation' END AS task FROM {_F['fx_tokens']}",
    "validate_changes": f"""SELECT p.file, count(line_text) AS errors, count(line_text) = 0 AS valid FROM {_F['fx_changed_paths']} p
LEFT JOIN {_F['fx_diag_log']} ON contains(lower(line_text), 'error') AND contains(line_text, p.file) GROUP BY p.file""",
    "suite_pass_rate": f"SELECT run_id, suite, count(*) AS total, count(*) FILTER (passed) AS passed, avg(CAST(coalesce(passed, false) AS INT)) AS pass_rate FROM {_F['fx_results']} GROUP BY run_id, suite",
    "validation_run_summary": f"""SELECT s.*, f.suite AS failed_suite, f.name AS failed_test FROM (
SELECT run_id, count(DISTINCT suite) AS suites, count(*) AS tests, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT coalesce(passed, false)) AS failed,
count(*) FILTER (NOT coalesce(passed, false)) = 0 AS ready FROM {_F['fx_results']} GROUP BY run_id) s
LEFT JOIN (SELECT * FROM {_F['fx_results']} WHERE NOT coalesce(passed, false)) f ON f.run_id IS NOT DISTINCT FROM s.run_id""",
    "bus_state": f"""SELECT coalesce(r.agent_id, p.agent_id) AS agent_id, reads, pending FROM (SELECT agent_id, count(*) AS reads FROM {_F['fx_reads']} GROUP BY agent_id) r
FULL JOIN ({_O['pending_counts']}) p ON p.agent_id = r.agent_id""",
    "delta_coverage": f"""SELECT delta_id, count(*) AS callers, count(hit) AS notified, count(*) - count(hit) AS missed, CAST(count(hit) * 100 AS DOUBLE) / count(*) AS coverage_pct
FROM ({_SHOULD}) GROUP BY delta_id""",
    "delta_missed": f"SELECT delta_id, agent_id FROM ({_SHOULD}) WHERE hit IS NULL",
    "validation_failures": f"SELECT run_id, suite, name FROM {_F['fx_results']} WHERE NOT coalesce(passed, false)",
    "commit_deltas": f"""SELECT d.*, coalesce(n, 0) AS notifications FROM (SELECT repo, file, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'removed') AS removed, count(*) AS all_changed
FROM ({_O['symbol_diff']}) GROUP BY repo, file) d LEFT JOIN (SELECT c.file, count(DISTINCT agent_id) AS n FROM (
  SELECT DISTINCT file, 'sym_' || right(name, 1) AS symbol, 'agent_' || substr(file, 2) AS emitter, ts FROM ({_O['symbol_diff']})
  JOIN (SELECT delta_id % 50 AS m, max(ts) AS ts FROM {_F['fx_deltas']} GROUP BY 1) ON m = CAST(substr(file, 2) AS BIGINT)) c
  JOIN {_F['fx_reads']} r ON r.symbol = c.symbol AND r.ts <= c.ts AND r.ts >= c.ts - INTERVAL {base.WINDOW_S} SECOND AND agent_id <> emitter GROUP BY c.file) x ON x.file = d.file""",
    "stream_route_deltas": _O["route_deltas"],
    "stream_pending_queue": f"SELECT agent_id, delta_id, delivered_by FROM ({_DONE})",
    "stream_notify_callback": f"SELECT agent_id, count(*) AS delivered FROM ({_DONE}) GROUP BY agent_id",
    "stream_recovery": f"SELECT agent_id, delta_id, delivered_by FROM ({_DONE})",
    "save_load_subscription_state": f"""SELECT coalesce(r.agent_id, p.agent_id) AS agent_id, reads, last_read, symbols, last_pending FROM (SELECT agent_id, count(*) AS reads, max(epoch_us(ts) / 1000000.0) AS last_read FROM {_F['fx_reads']} GROUP BY agent_id) r
FULL JOIN (SELECT q.agent_id, CAST(sum(len(string_split(changed_symbols, ','))) AS BIGINT) AS symbols, max(epoch_us(q.ts) / 1000000.0) AS last_pending FROM ({base._ROUTED}) q
JOIN ({base._DELIVERED}) d ON d.delta_id = q.delta_id AND d.agent_id = q.agent_id AND delivered_by IS NULL GROUP BY q.agent_id) p ON p.agent_id = r.agent_id""",
    "read_trace_log": f"""SELECT run_id AS trace_id, task_id AS event, count(*) AS events, count(*) FILTER (record_id % 3 <> 0) AS timed, CAST(sum(prompt_tokens) AS BIGINT) AS metric, CAST(max(epoch_us(date_trunc('second', ts))) / 1000000 AS BIGINT) AS last
FROM {_F['fx_tokens']} GROUP BY run_id, task_id""",
}
