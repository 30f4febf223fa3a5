"""Registered queries over the given tables, and what DuckDB should find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depscope.operators import activity as act
from depscope.operators import graph, measures
from depscope.sources.derived import duck, source

WINDOW_S = 3600


def _roots(s: SparkSession, d: str) -> DataFrame:
    """Each package is a root of its own."""
    return source(s, d, "fx_sources").select("repo", F.regexp_replace("path", "/[^/]*$", "").alias("root")).distinct()


def _imports(s: SparkSession, d: str) -> DataFrame:
    """Imports of all languages."""
    files = source(s, d, "fx_sources").select("repo", "path", "content").unionByName(source(s, d, "fx_modules").select("repo", "path", "content"))
    return graph.extract_imports(files)


def _resolved(s: SparkSession, d: str, view: str) -> DataFrame:
    files = source(s, d, view)
    aliases = graph.path_aliases(source(s, d, "fx_configs"), _roots(s, d)) if view == "fx_sources" else None
    return graph.resolve_imports(graph.extract_imports(files).filter("lang = 'typescript'"), files, aliases)


def _import_edges(s: SparkSession, d: str) -> DataFrame:
    found = _resolved(s, d, "fx_files").filter("imported_file is not null")
    return found.select("repo", F.col("importer_file").alias("src"), F.col("imported_file").alias("dst")).distinct()


def _edges(s: SparkSession, d: str) -> DataFrame:
    """Call and import edges of the tree with hubs."""
    symbols = source(s, d, "fx_tree_symbols")
    return graph.dependency_edges(graph.call_file_edges(source(s, d, "fx_tree_calls"), symbols), _resolved(s, d, "fx_files"), symbols)


def _cones(s: SparkSession, d: str) -> DataFrame:
    return graph.measure_cones(source(s, d, "fx_files"), source(s, d, "fx_tree_symbols"), _edges(s, d))


def _changed_symbols(s: SparkSession, d: str) -> DataFrame:
    """The changed names of each file, as the functions that the calls name."""
    diff = act.symbol_diff(source(s, d, "fx_old"), source(s, d, "fx_new"))
    return diff.select("repo", F.col("file").alias("change_id"), F.regexp_replace("name", "^s", "fn").alias("symbol"))


def _callers(s: SparkSession, d: str) -> DataFrame:
    return measures.find_callers(_changed_symbols(s, d), source(s, d, "fx_calls"))


def _records(s: SparkSession, d: str) -> DataFrame:
    return source(s, d, "fx_tokens").withColumn("cost_usd", act.estimate_cost(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens")))


def _routed(s: SparkSession, d: str) -> DataFrame:
    return act.route_deltas(source(s, d, "fx_deltas"), source(s, d, "fx_reads"), WINDOW_S)


def delivered(s: SparkSession, d: str, pending: bool = False) -> DataFrame:
    return act.deliver(source(s, d, "fx_deltas"), source(s, d, "fx_reads"), source(s, d, "fx_flushes"), WINDOW_S, pending)


def _new_diags(s: SparkSession, d: str) -> DataFrame:
    found = act.parse_diagnostics(source(s, d, "fx_diag_log"))
    return act.new_diagnostics(found.filter("attempt > 1"), found.filter("attempt = 1"))


def changed_files(s: SparkSession, d: str) -> DataFrame:
    """Changed files of each run: those its first attempt names at line 1 to 10."""
    return act.parse_diagnostics(source(s, d, "fx_diag_log")).filter("attempt = 1 and line <= 10").select("run_id", "file").distinct()


QUERIES = {
    "detect_language": lambda s, d: source(s, d, "fx_sources").select("path").unionByName(source(s, d, "fx_changes").select("path")).select("path", graph.detect_language(F.col("path")).alias("lang")),
    "count_tokens": lambda s, d: source(s, d, "documents").select("doc_id", graph.count_tokens(F.col("text")).alias("tokens")),
    "extract_calls": lambda s, d: graph.extract_calls(source(s, d, "fx_sources").select("repo", "path", "content").unionByName(source(s, d, "fx_files"))),
    "extract_imports": lambda s, d: _imports(s, d).withColumn("pos", F.col("pos").cast("long")),
    "load_path_aliases": lambda s, d: graph.path_aliases(source(s, d, "fx_configs"), _roots(s, d)),
    "resolve_imports_ts": lambda s, d: _resolved(s, d, "fx_sources").select("importer_file", F.col("pos").cast("long").alias("pos"), "import_path", "imported_file"),
    "unresolved_imports": lambda s, d: graph.unresolved_imports(_resolved(s, d, "fx_sources")),
    "unique_symbols": lambda s, d: graph.unique_symbols(source(s, d, "fx_symbols")),
    "call_file_edges": lambda s, d: graph.call_file_edges(source(s, d, "fx_calls"), source(s, d, "fx_symbols")),
    "find_callers": lambda s, d: _callers(s, d).drop("repo"),
    "top_caller": lambda s, d: measures.top_caller(_callers(s, d)).drop("repo"),
    "import_callers_fallback": lambda s, d: measures.import_callers(
        source(s, d, "fx_files").select("repo", F.col("path").alias("change_id"), F.col("path").alias("file")),
        source(s, d, "fx_calls").filter("called_name like 'fn%' and right(called_name, 1) not in ('3', '5')").select("repo", F.concat(F.lit("pkg"), F.floor(F.substring("called_name", 3, 9).cast("long") / 40.0), F.lit("/mod"), F.substring("called_name", 3, 9), F.lit(".ts")).alias("change_id")),
        _resolved(s, d, "fx_files"),
    ).drop("repo"),
    "reverse_dependents": lambda s, d: _edges(s, d).select(F.col("dst").alias("file"), F.col("src").alias("dependent")),
    "measure_cones": _cones,
    "cone_summary": lambda s, d: measures.cone_summary(_cones(s, d)),
    "symbol_diff": lambda s, d: act.symbol_diff(source(s, d, "fx_old"), source(s, d, "fx_new")),
    "symbol_fingerprint": lambda s, d: act.symbol_fingerprint(source(s, d, "fx_new")),
    "route_deltas": lambda s, d: _routed(s, d).select("delta_id", "agent_id", "changed_symbols"),
    "pending_after_flush": lambda s, d: delivered(s, d).select("delta_id", "agent_id", "delivered_by"),
    "pending_counts": lambda s, d: delivered(s, d, pending=True).groupBy("agent_id").agg(F.count(F.lit(1)).alias("pending")),
    "estimate_cost": lambda s, d: _records(s, d).select("record_id", "cost_usd"),
    "ledger_summary": lambda s, d: act.ledger_summary(_records(s, d)),
    "list_runs": lambda s, d: act.list_runs(_records(s, d)),
    "parse_diagnostics": lambda s, d: act.parse_diagnostics(source(s, d, "fx_diag_log")),
    "new_diagnostics": _new_diags,
    "dedup_diagnostics": lambda s, d: act.dedup_diagnostics(_new_diags(s, d), changed_files(s, d)),
}

_F = {k: f"({duck(k)})" for k in ("fx_files", "fx_symbols", "fx_calls", "fx_edges", "fx_reads", "fx_deltas", "fx_flushes", "fx_tokens", "fx_diag_log", "fx_old", "fx_new", "fx_tree_symbols", "fx_tree_calls", "fx_sources", "fx_changes", "fx_modules")}
_IMPORTS = f"SELECT repo, path AS importer_file, unnest(regexp_extract_all(content, 'from ''([^''\\n]+)''', 1)) AS import_path, generate_subscripts(regexp_extract_all(content, 'from ''([^''\\n]+)''', 1), 1) - 1 AS pos FROM {_F['fx_files']}"
_RESOLVED = f"""SELECT i.*, coalesce(a.path, b.path) AS imported_file FROM (SELECT *, regexp_replace(importer_file, '[^/]+$', '') || regexp_replace(import_path, '^\\./', '') AS p FROM ({_IMPORTS})) i
LEFT JOIN {_F['fx_files']} a ON a.path = i.p LEFT JOIN {_F['fx_files']} b ON b.path = i.p || '.ts'"""
_IMPORT_EDGES = f"SELECT DISTINCT repo, importer_file AS src, imported_file AS dst FROM ({_RESOLVED}) WHERE imported_file IS NOT NULL"
_TOKENS = "CAST(len(regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\n]')) AS BIGINT)"
_UNIQUE = f"SELECT repo, name, arg_max(file, file) AS file, arg_max(kind, file) AS kind FROM {_F['fx_symbols']} GROUP BY repo, name"


def _call_edges(calls: str, symbols: str) -> str:
    unique = f"SELECT name, arg_max(file, file) AS file FROM {symbols} GROUP BY name"
    return f"""SELECT DISTINCT c.repo, caller_file, callee_file FROM (
  SELECT c.repo, c.caller_file, coalesce(u.file, m.file) AS callee_file FROM {calls} c LEFT JOIN ({unique}) u ON u.name = c.called_name
  LEFT JOIN (SELECT DISTINCT split_part(name, '.', 2) AS m, file FROM (SELECT name, arg_max(file, file) AS file, arg_max(kind, file) AS kind FROM {symbols} GROUP BY name)
    WHERE kind IN ('method', 'interface_method')) m ON u.name IS NULL AND m.m = c.called_name) c
WHERE callee_file IS NOT NULL AND callee_file <> caller_file"""


_CALLS = _call_edges(_F["fx_calls"], _F["fx_symbols"])
_TREE = _F["fx_tree_symbols"]
_WINNERS = f"SELECT name, arg_max(file, file) AS file, arg_max(kind, file) AS kind FROM {_TREE} GROUP BY name"
#: Call edges, and import edges to files with symbols, of the tree with hubs.
_TREE_CALLS = _call_edges(_F["fx_tree_calls"], _TREE)
_TREE_EDGES = f"SELECT 'main' AS repo, caller_file AS src, callee_file AS dst FROM ({_TREE_CALLS}) UNION SELECT repo, src, dst FROM ({_IMPORT_EDGES}) WHERE dst IN (SELECT file FROM {_TREE})"


def _pairs(seeds: str) -> str:
    """Head of a query over c(seed, node), the closure of those edges from the seeds."""
    return f"WITH RECURSIVE e AS ({_TREE_EDGES}), c(seed, node) AS (SELECT DISTINCT n, n FROM ({seeds}) UNION SELECT c.seed, e.dst FROM c JOIN e ON e.src = c.node)"


_ENDS = "SELECT src AS n FROM e UNION SELECT dst FROM e"
_SIZES = f"""{_pairs("SELECT file AS n FROM (" + _WINNERS + ") UNION " + _ENDS)}, t AS (SELECT path, {_TOKENS.format('content')} AS tokens FROM {_F['fx_files']})
SELECT seed AS origin, count(*) AS cone_files, CAST(sum(tokens) AS BIGINT) AS cone_tokens, CAST(sum(tokens) FILTER (seed = node) AS BIGINT) AS origin_tokens, (SELECT CAST(sum(tokens) AS BIGINT) FROM t) AS total_tokens FROM c JOIN t ON path = node GROUP BY seed"""
_CONES = f"""SELECT 'main' AS repo, name, kind, origin, cone_files, cone_tokens, origin_tokens, floor(CAST(cone_tokens * 2000 + total_tokens AS DOUBLE) / (total_tokens * 2)) / 10 AS cone_ratio
FROM ({_WINNERS}) JOIN ({_SIZES}) ON origin = file"""
_LAST = {k: f"(SELECT repo, file, name, arg_max(body, start) AS body FROM {_F[k]} GROUP BY repo, file, name)" for k in ("fx_old", "fx_new")}
_DIFF = f"""SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.file, n.file) AS file, coalesce(o.name, n.name) AS name, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM {_LAST['fx_old']} o FULL JOIN {_LAST['fx_new']} n ON o.file = n.file AND o.name = n.name WHERE o.body IS DISTINCT FROM n.body"""
_HITS = f"""SELECT d.file AS change_id, caller_file AS file, string_agg(DISTINCT called_name, ',' ORDER BY called_name) AS hits, count(DISTINCT called_name) AS n_hits
FROM ({_DIFF}) d JOIN {_F['fx_calls']} c ON c.called_name = replace(d.name, 's', 'fn') GROUP BY ALL"""
_TS = f"(SELECT path, k, CAST(floor(k / 40.0) AS BIGINT) AS p FROM {_F['fx_sources']} WHERE path LIKE '%.ts')"
#: What each generated source imports, and the file that is.
_SOURCE_IMPORTS = " UNION ALL ".join(
    f"SELECT path AS importer_file, CAST({pos} AS BIGINT) AS pos, {imp} AS import_path, {to} AS want FROM {_TS}"
    for pos, imp, to in (
        (0, "'../pkg' || (p + 1) || '/mod' || (k + 40)", "'app/pkg' || (p + 1) || '/mod' || (k + 40) || '.ts'"),
        (1, "'./style.css'", "'-'"),
        (2, "'~/pkg' || p || '/mod' || (k + 4)", "CASE WHEN p % 5 IN (1, 2) THEN '-' ELSE 'app/pkg' || p || '/mod' || (k + 4) || '.ts' END"),  # some packages have a configuration of their own
        (3, "'./mod' || (k + 8)", "'app/pkg' || p || '/mod' || (k + 8) || '.ts'"),
        (4, "'~lib/x'", "'-'"),
    )
)
_SOURCE_RESOLVED = f"SELECT importer_file, pos, import_path, f.path AS imported_file FROM ({_SOURCE_IMPORTS}) LEFT JOIN {_F['fx_sources']} f ON f.path = want"
_ROUTED = f"""SELECT delta_id, agent_id, d.ts, string_agg(DISTINCT d.symbol, ',' ORDER BY d.symbol) AS changed_symbols FROM {_F['fx_deltas']} d JOIN {_F['fx_reads']} r
ON r.symbol = d.symbol AND r.ts <= d.ts AND r.ts >= d.ts - INTERVAL {WINDOW_S} SECOND AND agent_id <> emitting_agent GROUP BY delta_id, agent_id, d.ts"""
_DELIVERED = f"""SELECT n.delta_id, n.agent_id, (SELECT arg_min(flush_id, (f.ts, flush_id)) FROM {_F['fx_flushes']} f WHERE f.agent_id = n.agent_id AND f.ts >= n.ts) AS delivered_by FROM ({_ROUTED}) n"""
_RATE = """CASE WHEN lower(model) LIKE '%haiku%' THEN {h} ELSE {s} END"""
_COSTED = f"SELECT *, CAST((prompt_tokens * {_RATE.format(h=25, s=300)} + completion_tokens * {_RATE.format(h=125, s=1500)}) AS DOUBLE) / 100000000 AS cost_usd FROM {_F['fx_tokens']}"
_PATTERN = "'^(.+?)\\(([0-9]+),([0-9]+)\\): +error +(TS[0-9]+): +(.+)$'"
_DIAGS = f"""SELECT run_id, attempt, m.file AS file, CAST(m.line AS BIGINT) AS line, CAST(m.col AS BIGINT) AS col, m.code AS code, m.message AS message
FROM (SELECT run_id, attempt, regexp_extract(line_text, {_PATTERN}, ['file', 'line', 'col', 'code', 'message']) AS m FROM {_F['fx_diag_log']} WHERE regexp_matches(line_text, {_PATTERN}))"""
_NEW = f"WITH g AS ({_DIAGS}) SELECT * FROM g WHERE attempt > 1 AND NOT EXISTS (SELECT 1 FROM g b WHERE b.attempt = 1 AND b.run_id = g.run_id AND b.file = g.file AND b.code = g.code AND b.message = g.message)"

_UNITS = f"SELECT *, prompt_tokens * {_RATE.format(h=25, s=300)} + completion_tokens * {_RATE.format(h=125, s=1500)} AS units FROM {_F['fx_tokens']}"
_CHANGED = f"(SELECT DISTINCT run_id, file FROM ({_DIAGS}) WHERE attempt = 1 AND line <= 10)"

#: Sources with literals and comments blanked, then without what stands before a parenthesis and is no call, by regular expressions on the text itself.
_MASKED = rf"""SELECT repo, path, regexp_extract(path, '[.]([a-z]+)$', 1) AS ext,
regexp_replace(content, '"[^"\n]*"|''[^''\n]*''|`[^`]*`|//[^\n]*|/\*(?s:.*?)\*/' || CASE WHEN path LIKE '%.py' THEN '|#[^\n]*' ELSE '' END, ' ', 'g') AS t
FROM (SELECT repo, path, content FROM {_F['fx_sources']} UNION ALL SELECT repo, path, content FROM {_F['fx_files']})"""
_HEADLESS = rf"""SELECT repo, path, regexp_replace(t, CASE ext WHEN 'ts' THEN 'interface [A-Za-z0-9]+ \{{[^{{}}]*\}}|(?:function|new) [A-Za-z0-9]+|[A-Za-z0-9]+\([^()]*\): [a-z]+ \{{'
WHEN 'py' THEN '(?:def|class) [A-Za-z0-9]+' WHEN 'go' THEN 'func (?:\([^()]*\) )?[A-Za-z0-9]+' ELSE '(?:fn|struct) [A-Za-z0-9]+|[a-z]+!\([^()]*\)' END, ';', 'g') AS t FROM ({_MASKED})"""
_CALLED = rf"SELECT repo, path, unnest(regexp_extract_all(t, '([A-Za-z_][A-Za-z0-9_]*)(?:<[a-z]+>)? *\(', 1)) AS called_name FROM ({_HEADLESS})"
_IMPORTED = {
    "typescript": r"""list_filter(regexp_extract_all(regexp_replace(content, '//[^\n]*|/\*(?s:.*?)\*/', ' ', 'g'), 'import (?:[A-Za-z{} ,]+ from )?["'']([^"'']+)["'']', 1), lambda x: starts_with(x, '.') OR contains(x, '/'))""",
    "python": r"regexp_extract_all(content, '(?m)^(?:import|from) ([A-Za-z0-9_.]+)', 1)",
    "go": r"""regexp_extract_all(content, '(?m)^"([^"]+)"$', 1)""",
    "rust": r"list_filter(regexp_extract_all(content, '(?m)^(?:use|mod) ([a-z0-9]+)', 1), lambda x: x <> 'crate')",
}
_FOUND_IMPORTS = " UNION ALL ".join(
    f"SELECT repo, path, '{lang}' AS lang, {found} AS found FROM (SELECT repo, path, content FROM {_F['fx_sources']} UNION ALL SELECT repo, path, content FROM {_F['fx_modules']}) WHERE path LIKE '%.{ext}'"
    for (lang, found), ext in zip(_IMPORTED.items(), ("ts", "py", "go", "rs"), strict=True)
)

ORACLES = {
    "detect_language": f"""SELECT path, CASE regexp_extract(path, '[.]([^./]+)$', 1) WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' END AS lang
FROM (SELECT path FROM {_F['fx_sources']} UNION ALL SELECT path FROM {_F['fx_changes']})""",
    "count_tokens": f"SELECT doc_id, {_TOKENS.format('text')} AS tokens FROM documents",
    "extract_calls": f"SELECT DISTINCT repo, path AS caller_file, called_name FROM ({_CALLED}) WHERE called_name NOT IN ('if', 'while', 'for', 'return', 'in')",
    "extract_imports": f"SELECT repo, path AS importer_file, lang, unnest(range(len(found))) AS pos, unnest(found) AS import_path FROM ({_FOUND_IMPORTS})",
    "resolve_imports_ts": _SOURCE_RESOLVED,
    "unresolved_imports": f"SELECT 'main' AS repo, count(*) AS imports, count(*) FILTER (imported_file IS NULL) AS unresolved, count(*) FILTER (imported_file IS NULL) = 0 AS passed FROM ({_SOURCE_RESOLVED}) WHERE import_path NOT LIKE '%.css'",
    "unique_symbols": _UNIQUE,
    "call_file_edges": _CALLS,
    "find_callers": _HITS,
    "reverse_dependents": f"SELECT DISTINCT dst AS file, src AS dependent FROM ({_TREE_EDGES})",
    "measure_cones": _CONES,
    "cone_summary": f"""SELECT repo, n AS cones, CAST(t AS DOUBLE) / n / 10 AS avg_ratio, CAST(f AS DOUBLE) / n AS avg_files, 100 - CAST(t AS DOUBLE) / n / 10 AS avg_reduction FROM (
SELECT repo, count(*) AS n, CAST(sum(CAST(round(cone_ratio * 10) AS BIGINT)) AS BIGINT) AS t, CAST(sum(cone_files) AS BIGINT) AS f FROM ({_CONES}) GROUP BY repo)""",
    "symbol_diff": _DIFF,
    "symbol_fingerprint": f"SELECT repo, file, count(DISTINCT name) AS n_symbols, md5(string_agg(DISTINCT name, ',' ORDER BY name)) AS fingerprint FROM {_F['fx_new']} GROUP BY repo, file",
    "route_deltas": f"SELECT delta_id, agent_id, changed_symbols FROM ({_ROUTED})",
    "pending_after_flush": _DELIVERED,
    "pending_counts": f"SELECT agent_id, count(*) AS pending FROM ({_DELIVERED}) WHERE delivered_by IS NULL GROUP BY agent_id",
    "estimate_cost": f"SELECT record_id, cost_usd FROM ({_COSTED})",
    "ledger_summary": f"""SELECT run_id, level, key, prompt_tokens, completion_tokens, CAST(u AS DOUBLE) / 100000000 AS cost_usd, calls FROM (SELECT run_id, CASE WHEN grouping(agent_id) = 0 THEN 'agent' WHEN grouping(task_id) = 0 THEN 'task' WHEN grouping(model) = 0 THEN 'model' ELSE 'run' END AS level,
coalesce(agent_id, task_id, model, '') AS key, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(units) AS BIGINT) AS u, count(*) AS calls
FROM ({_UNITS}) GROUP BY GROUPING SETS ((run_id), (run_id, agent_id), (run_id, task_id), (run_id, model)))""",
    "list_runs": f"""SELECT run_id, CAST(min(ts) AS VARCHAR) AS first_ts, CAST(max(ts) AS VARCHAR) AS last_ts, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens, CAST(sum(units) AS DOUBLE) / 100000000 AS cost_usd, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM ({_UNITS}) GROUP BY run_id ORDER BY min(ts) DESC, run_id LIMIT 20""",
    "parse_diagnostics": _DIAGS,
    "new_diagnostics": _NEW,
    "dedup_diagnostics": f"""SELECT * FROM (SELECT run_id, attempt, file, code, line, col, message, row_number() OVER (PARTITION BY run_id, attempt ORDER BY other, line, file, code) AS rank FROM (
SELECT n.*, CASE WHEN c.file IS NULL THEN 1 ELSE 0 END AS other, row_number() OVER (PARTITION BY n.run_id, attempt, n.file, code ORDER BY line, col, message) AS k FROM ({_NEW}) n LEFT JOIN {_CHANGED} c ON c.run_id = n.run_id AND c.file = n.file) WHERE k = 1) WHERE rank <= 3""",
    "top_caller": f"SELECT change_id, arg_min(file, (-n_hits, file)) AS file, max(n_hits) AS n_hits FROM ({_HITS}) GROUP BY change_id",
    "load_path_aliases": f"""SELECT DISTINCT 'main' AS repo, root, CASE WHEN p % 5 = 1 THEN '@' ELSE prefix END AS prefix, CASE WHEN p % 5 = 1 THEN root || '/src' ELSE target END AS target
FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS root, CAST(floor(k / 40.0) AS BIGINT) AS p FROM {_F['fx_sources']}), (SELECT '~' AS prefix, 'app' AS target UNION ALL SELECT '~lib', 'lib') WHERE p % 5 <> 2""",
    "import_callers_fallback": f"""SELECT DISTINCT f.path AS change_id, i.src AS file FROM {_F['fx_files']} f JOIN ({_IMPORT_EDGES}) i ON contains(i.dst, replace(f.path, '.ts', ''))
WHERE 'fn' || regexp_extract(f.path, 'mod([0-9]+)', 1) NOT IN (SELECT called_name FROM {_F['fx_calls']} WHERE right(called_name, 1) NOT IN ('3', '5'))""",
}
