"""Queries on symbols, modules, cones and measures, and what DuckDB should find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depscope.jobs import registry as base
from depscope.operators import activity, graph, incremental, measures, symbols
from depscope.sources import trees
from depscope.sources.derived import duck, source
from depscope.sources.shared import settled


def _measured(s: SparkSession, d: str) -> DataFrame:
    return base.QUERIES["measure_cones"](s, d)


def _total(s: SparkSession, d: str) -> DataFrame:
    return measures.repo_tokens(source(s, d, "fx_files"))


def _called(s: SparkSession, d: str) -> DataFrame:
    return source(s, d, "fx_tree_calls").select("repo", F.col("called_name").alias("name"))


def _modules(s: SparkSession, d: str, lang: str) -> DataFrame:
    return source(s, d, "fx_modules").filter(F.col("lang") == lang)


def _extracted(s: SparkSession, d: str, lang: str) -> DataFrame:
    return symbols.extract_symbols(_modules(s, d, lang), lang).select("name", "file", "kind", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


def _resolved(resolve, lang: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        files = _modules(s, d, lang)
        return resolve(graph.extract_imports(files), files).select("importer_file", "import_path", "imported_file")

    return query


def _by_half(s: SparkSession, d: str) -> DataFrame:
    """Statistics of two repositories: the packages of even and of odd number."""
    half = lambda c: F.when(F.regexp_extract(c, r"^pkg([0-9]+)/", 1).cast("long") % 2 == 0, "even").otherwise("odd")
    return measures.graph_summary(
        source(s, d, "fx_files").withColumn("repo", half("path")),
        source(s, d, "fx_tree_symbols").withColumn("repo", half("file")),
        source(s, d, "fx_tree_calls").withColumn("repo", half("caller_file")),
        _call_edges(s, d).withColumn("repo", half("caller_file")),
    )


def _call_edges(s: SparkSession, d: str) -> DataFrame:
    return graph.call_file_edges(source(s, d, "fx_tree_calls"), source(s, d, "fx_tree_symbols"))


def _asked(s: SparkSession, d: str) -> DataFrame:
    """Files whose context is asked for: a query set of every part whose number is divisible by 50."""
    return source(s, d, "fx_tree_symbols").filter("pos % 50 = 0").select("repo", "file").distinct()


def _summary(s: SparkSession, d: str) -> DataFrame:
    return measures.graph_summary(source(s, d, "fx_files"), source(s, d, "fx_tree_symbols"), source(s, d, "fx_tree_calls"), _call_edges(s, d))


def _timings(s: SparkSession, d: str) -> DataFrame:
    return source(s, d, "fx_tokens").groupBy("run_id").agg((F.count(F.lit(1)) / F.lit(100.0)).alias("elapsed_s"), F.countDistinct("agent_id").alias("file_count"))


def _diff(s: SparkSession, d: str) -> DataFrame:
    return activity.symbol_diff(source(s, d, "fx_old"), source(s, d, "fx_new"))


def _file_status(s: SparkSession, d: str) -> DataFrame:
    """Files that came or went, with each of their names."""
    old, new = (source(s, d, v).select("repo", "file").distinct().withColumn(n, F.lit(1)) for v, n in (("fx_old", "o"), ("fx_new", "n")))
    status = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "deleted")
    files = old.join(new, ["repo", "file"], "full_outer").select("repo", "file", status.alias("status")).filter("status is not null")
    return _diff(s, d).join(files, ["repo", "file"]).select("file", "status", "name", "change")


def _versions(s: SparkSession, d: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Files, symbols, calls and imports of two versions of the tree; the later one lacks some files, and others call, define and import other names."""
    symbols, calls = source(s, d, "fx_tree_symbols"), source(s, d, "fx_tree_calls")
    files = source(s, d, "fx_files").select("repo", "path")
    imports = graph.extract_imports(source(s, d, "fx_files")).select("repo", "importer_file", "pos", "import_path")
    old = {"files": files, "symbols": symbols, "calls": calls, "imports": imports}
    moved = F.when(F.col("pos") % 9 == 2, F.concat(F.col("name"), F.lit("x"))).otherwise(F.col("name"))
    gone = symbols.filter("pos % 11 = 5").select("repo", "file").distinct()
    new = {
        "files": files.join(gone.withColumnRenamed("file", "path"), ["repo", "path"], "left_anti"),
        "symbols": symbols.withColumn("name", moved).join(gone, ["repo", "file"], "left_anti"),
        "calls": calls.join(gone.withColumnRenamed("file", "caller_file"), ["repo", "caller_file"], "left_anti").filter("not (called_name like 'fn%7')"),
        "imports": imports.join(gone.withColumnRenamed("file", "importer_file"), ["repo", "importer_file"], "left_anti").filter("not (import_path like '%9')"),
    }
    return old, new


def _incremental(s: SparkSession, d: str) -> DataFrame:
    """Call and import edges after an update of the files that differ."""
    old, new = ({name: settled(df, name) for name, df in version.items()} for version in _versions(s, d))
    touched = (
        old["symbols"].filter("pos % 9 = 2 or pos % 11 = 5").select("repo", "file")
        .unionByName(old["calls"].filter("called_name like 'fn%7'").select("repo", F.col("caller_file").alias("file")))
        .unionByName(old["imports"].filter("import_path like '%9'").select("repo", F.col("importer_file").alias("file")))
        .distinct()
    )
    before = old | {"edges": settled(incremental.edge_counts(old["calls"], old["symbols"]), "edges"), "resolved": settled(graph.resolve_imports(old["imports"], old["files"]), "resolved")}
    after = incremental.update_graph(before, new, touched)
    calls = after["edges"].select("repo", F.lit("call").alias("kind"), F.col("caller_file").alias("src"), F.col("callee_file").alias("dst"))
    imports = after["resolved"].filter("imported_file is not null").select("repo", F.lit("import").alias("kind"), F.col("importer_file").alias("src"), F.col("imported_file").alias("dst")).distinct()
    return calls.unionByName(imports)


def _scanned(s: SparkSession, d: str) -> DataFrame:
    return trees.scan_source_files(s, source(s, d, "fx_tree_files"))


QUERIES = {
    "extract_symbols_ts": lambda s, d: symbols.extract_symbols(source(s, d, "fx_files"), "typescript").select("name", "file", "kind", F.col("start").alias("start_at"), F.col("end").alias("end_at")),
    "extract_symbols_py": lambda s, d: _extracted(s, d, "python"),
    "extract_symbols_go": lambda s, d: _extracted(s, d, "go"),
    "extract_symbols_rust": lambda s, d: _extracted(s, d, "rust"),
    "symbols_by_file": lambda s, d: symbols.symbols_by_file(source(s, d, "fx_symbols")),
    "resolve_imports_py": _resolved(symbols.resolve_imports_py, "python"),
    "resolve_imports_go": _resolved(symbols.resolve_imports_go, "go"),
    "resolve_imports_rust": _resolved(symbols.resolve_imports_rust, "rust"),
    "type_hierarchy": lambda s, d: symbols.type_edges(source(s, d, "fx_classes")),
    "type_members": lambda s, d: symbols.type_members(source(s, d, "fx_members")),
    "type_lineage": lambda s, d: symbols.type_lineage(symbols.type_edges(source(s, d, "fx_classes"))),
    "dependency_edges": base._edges,
    "all_cones": lambda s, d: measures.all_cones(base._edges(s, d)),
    "symbol_cone": lambda s, d: measures.symbol_cones(_called(s, d), source(s, d, "fx_tree_symbols"), base._edges(s, d)),
    "file_context": lambda s, d: measures.file_context(source(s, d, "fx_tree_symbols"), base._edges(s, d)),
    "cone_context": lambda s, d: measures.cone_context(measures.all_cones(base._edges(s, d), _asked(s, d)), source(s, d, "fx_files")),
    "connected_symbols_sample": lambda s, d: measures.connected_symbols(source(s, d, "fx_tree_symbols"), base._edges(s, d)),
    "cone_reduction": lambda s, d: measures.cone_reduction(_measured(s, d)),
    "session_stats": lambda s, d: measures.session_stats(_measured(s, d), _total(s, d)),
    "handoff_savings": lambda s, d: measures.handoff_savings(base._edges(s, d), graph.cone_sizes(source(s, d, "fx_files"), base._edges(s, d))),
    "token_savings_check": lambda s, d: measures.token_savings_check(_measured(s, d)),
    "graph_summary": _summary,
    "compare_corpora": lambda s, d: measures.compare_corpora(_by_half(s, d), "even", "odd"),
    "build_time_check": lambda s, d: measures.build_time_check(_timings(s, d)),
    "parse_success": lambda s, d: measures.parse_success(_scanned(s, d)),
    "scan_source_files": lambda s, d: _scanned(s, d).select("repo", "path", "lang", "n_bytes", "parse_ok", F.md5(F.col("content").cast("binary")).alias("content_md5")),
    "list_symbols": lambda s, d: measures.list_symbols(source(s, d, "fx_symbols"), kind="method", query="t1"),
    "suggest_symbols": lambda s, d: measures.suggest_symbols(source(s, d, "fx_symbols"), "N1"),
    "changed_source_files": lambda s, d: measures.changed_source_files(source(s, d, "fx_changes"), "app/"),
    "strip_code_fences": lambda s, d: source(s, d, "documents").select("doc_id", F.md5(measures.strip_code_fences(F.col("text")).cast("binary")).alias("text_md5")),
    "assemble_stream_replies": lambda s, d: measures.assemble_replies(source(s, d, "fx_replies")),
    "file_add_remove_diff": _file_status,
    "incremental_update": _incremental,
}

_F = {k: f"({duck(k)})" for k in ("fx_files", "fx_symbols", "fx_calls", "fx_classes", "fx_members", "fx_modules", "fx_replies", "fx_changes", "fx_tokens", "fx_old", "fx_new", "fx_tree_symbols", "fx_tree_calls", "fx_tree_files")}
_O = base.ORACLES
_E = f"({base._TREE_CALLS})"
_TOTAL = f"(SELECT CAST(sum({base._TOKENS.format('content')}) AS BIGINT) FROM {_F['fx_files']})"
_ORIGINS = f"SELECT file AS n FROM ({base._WINNERS})"
_ENDS, _pairs, _TREE = base._ENDS, base._pairs, base._TREE


def _spans(lang: str, *defs: tuple[str, str, str, str]) -> str:
    """Expected definitions: (name, kind, text it starts with, its length or end) as SQL expressions."""
    return " UNION ALL ".join(
        f"SELECT {name} AS name, path AS file, '{kind}' AS kind, strpos(content, {start}) - 1 AS start_at, {end} AS end_at FROM {_F['fx_modules']} WHERE lang = '{lang}'" for name, kind, start, end in defs
    )


def _after(text: str) -> str:
    return f"strpos(content, {text}) - 1 + length({text})"


def _module_imports(lang: str, *paths: str) -> str:
    return " UNION ALL ".join(f"SELECT path AS importer_file, {p} AS import_path, CAST(floor(k / 40.0) AS BIGINT) AS p, k FROM {_F['fx_modules']} WHERE lang = '{lang}'" for p in paths)


_HALF = "CASE WHEN CAST(regexp_extract({0}, '^pkg([0-9]+)/', 1) AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END"

def _stats(files: str, symbols: str, calls: str, edges: str) -> str:
    """Statistics of the graph; the arguments name the repository in each of the four inputs."""
    return f"""SELECT {files} AS repo, 'files' AS metric, count(DISTINCT path) AS value FROM {_F['fx_files']} GROUP BY 1
UNION ALL SELECT {symbols}, 'symbols', count(DISTINCT name) FROM {_TREE} GROUP BY 1
UNION ALL SELECT {calls}, 'files_with_calls', count(DISTINCT caller_file) FROM {_F['fx_tree_calls']} GROUP BY 1
UNION ALL SELECT {edges}, 'edges', count(*) FROM {_E} GROUP BY 1"""


ORACLES = {
    "extract_symbols_ts": f"SELECT 'fn' || regexp_extract(path, 'mod([0-9]+)', 1) AS name, path AS file, 'function' AS kind, strpos(content, 'function fn') - 1 AS start_at, length(content) - 1 AS end_at FROM {_F['fx_files']}",
    "extract_symbols_py": _spans(
        "python",
        ("'LIMIT' || k", "constant", "'LIMIT'", _after("'LIMIT' || k || ' = 3'")),
        ("'T' || k", "class", "'class T'", _after("'return f(1)'")),
        ("'T' || k || '.m'", "function", "'def m'", _after("'return f(1)'")),
        ("'fn' || k", "function", "'def fn'", "length(content) - 1"),
    ),
    "extract_symbols_go": _spans(
        "go",
        ("'T' || k", "struct", "'type T'", _after("'{ n int }'")),
        ("'T' || k || '.M'", "method", "'func (t'", _after("' M(a int) int { return a }'")),
        ("'Fn' || k", "function", "'func Fn'", "length(content) - 1"),
    ),
    "extract_symbols_rust": _spans(
        "rust",
        ("'mod' || (k + 3)", "module", "'mod mod'", "strpos(content, ';')"),
        ("'T' || k", "struct", "'struct T'", _after("'{ n: i32 }'")),
        ("'T' || k || '.m'", "function", "'fn m'", _after("'i32 { 1 }'")),
        ("'fn' || k", "function", "'fn fn'", "length(content) - 1"),
    ),
    "symbols_by_file": f"SELECT repo, file, string_agg(name, ',' ORDER BY name) AS names FROM {_F['fx_symbols']} GROUP BY repo, file",
    "resolve_imports_py": f"""SELECT importer_file, import_path, f.path AS imported_file FROM ({_module_imports('python', "'pkg' || CAST(floor(k / 40.0) AS BIGINT) || '.mod' || (k + 6)", "'.mod' || (k + 3)")}) i
LEFT JOIN {_F['fx_modules']} f ON f.lang = 'python' AND f.path = 'pkg' || p || '/' || regexp_extract(import_path, 'mod[0-9]+') || '.py'""",
    "resolve_imports_go": f"""SELECT importer_file, import_path, g.hit AS imported_file FROM ({_module_imports('go', "'fmt'", "'example.com/app/src/pkg' || (CAST(floor(k / 40.0) AS BIGINT) + 1)")}) i
LEFT JOIN (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, min(path) AS hit FROM {_F['fx_modules']} WHERE lang = 'go' GROUP BY 1) g ON import_path = 'example.com/app/' || folder""",
    "resolve_imports_rust": f"""SELECT importer_file, import_path, f.path AS imported_file FROM ({_module_imports('rust', "'serde'", "'mod' || (k + 3)")}) i
LEFT JOIN {_F['fx_modules']} f ON f.lang = 'rust' AND f.path = 'pkg' || p || '/' || import_path || '.rs'""",
    "type_hierarchy": f"SELECT DISTINCT repo, unnest(list_concat(extends, implements)) AS type_name, name AS implementor FROM {_F['fx_classes']}",
    "type_members": f"SELECT DISTINCT repo, parent_type, split_part(name, '.', 2) AS method_name FROM {_F['fx_members']} WHERE kind = 'method'",
    "type_lineage": f"""WITH RECURSIVE e AS (SELECT DISTINCT unnest(list_concat(extends, implements)) AS src, name AS dst FROM {_F['fx_classes']}),
c(seed, node) AS (SELECT DISTINCT n, n FROM ({_ENDS}) UNION SELECT c.seed, e.dst FROM c JOIN e ON e.src = c.node) SELECT 'main' AS repo, seed AS type_name, node AS member FROM c""",
    "dependency_edges": base._TREE_EDGES,
    "all_cones": f"""WITH RECURSIVE e AS ({base._TREE_EDGES}), c(seed, node, depth) USING KEY (seed, node) AS (SELECT DISTINCT n, n, 0 FROM ({_ENDS})
UNION SELECT c.seed, e.dst, c.depth + 1 FROM c JOIN e ON e.src = c.node LEFT JOIN recurring.c k ON k.seed = c.seed AND k.node = e.dst WHERE k.seed IS NULL)
SELECT 'main' AS repo, seed AS seed_file, node AS file, depth FROM c""",
    "symbol_cone": f"""{_pairs(_ORIGINS)} SELECT 'main' AS repo, name, node AS file FROM ({base._WINNERS}) u JOIN c ON seed = u.file WHERE name IN (SELECT called_name FROM {_F['fx_tree_calls']})""",
    "file_context": f"""{_pairs(_ORIGINS)} SELECT DISTINCT 'main' AS repo, s.file AS file, node AS cone_file FROM {_TREE} s JOIN ({base._WINNERS}) u ON u.name = s.name JOIN c ON seed = u.file""",
    "cone_context": f"""{_pairs(f"SELECT file AS n FROM {_TREE} WHERE pos % 50 = 0")} SELECT 'main' AS repo, seed AS seed_file, row_number() OVER (PARTITION BY seed ORDER BY node) AS ord, '// ── FILE: ' || node || ' ──' || chr(10) || content AS piece FROM c JOIN {_F['fx_files']} ON path = node""",
    "connected_symbols_sample": f"SELECT name, file FROM ({base._WINNERS}) WHERE file IN (SELECT src FROM ({base._TREE_EDGES})) ORDER BY name LIMIT 20",
    "cone_reduction": f"SELECT repo, name, 100 - cone_ratio AS reduction_pct FROM ({_O['measure_cones']})",
    "session_stats": f"""SELECT *, floor(CAST(tokens_saved * 100000 AS DOUBLE) / total_tokens) / 1000 AS reduction_pct, CAST(tokens_saved * 3 AS DOUBLE) / 1000000 AS cost_saved FROM (
SELECT repo, count(*) AS queries, CAST(sum(cone_tokens) AS BIGINT) AS cone_tokens, count(*) * {_TOTAL} AS total_tokens, count(*) * {_TOTAL} - CAST(sum(cone_tokens) AS BIGINT) AS tokens_saved FROM ({_O['measure_cones']}) GROUP BY repo)""",
    "handoff_savings": f"""WITH m AS ({base._SIZES}) SELECT e.repo, src, dst, floor(CAST((2 * a.total_tokens - a.cone_tokens - b.cone_tokens) * 100000 AS DOUBLE) / (2 * a.total_tokens)) / 1000 AS savings_pct
FROM ({base._TREE_EDGES}) e JOIN m a ON a.origin = src JOIN m b ON b.origin = dst""",
    "token_savings_check": f"""SELECT repo, count(*) FILTER (cone_files <= 2) AS leaves, max(100 - cone_ratio) FILTER (cone_files <= 2) AS best_leaf_savings, min(100 - cone_ratio) AS hub_savings,
100 - CAST(sum(CAST(round(cone_ratio * 10) AS BIGINT)) AS DOUBLE) / count(*) / 10 AS avg_savings,
coalesce(max(100 - cone_ratio) FILTER (cone_files <= 2) >= 80, false) AS passed FROM ({_O['measure_cones']}) GROUP BY repo""",
    "graph_summary": _stats(*["repo"] * 4),
    "compare_corpora": f"""SELECT metric, value_a, value_b, floor(CAST(value_b * 1000 AS DOUBLE) / value_a) / 1000 AS ratio FROM (
SELECT metric, max(value) FILTER (repo = 'even') AS value_a, max(value) FILTER (repo = 'odd') AS value_b FROM ({_stats(*map(_HALF.format, ('path', 'file', 'caller_file', 'caller_file')))}) GROUP BY metric)""",
    "build_time_check": f"""SELECT *, greatest(CAST(file_count AS DOUBLE) / 500 * 5, 1.0) AS target_s, elapsed_s < greatest(CAST(file_count AS DOUBLE) / 500 * 5, 1.0) AS passed
FROM (SELECT run_id, CAST(count(*) AS DOUBLE) / 100 AS elapsed_s, count(DISTINCT agent_id) AS file_count FROM {_F['fx_tokens']} GROUP BY run_id)""",
    "parse_success": f"""SELECT repo, count(*) AS total, count(*) - count(content) AS failed, floor(CAST(count(content) * 100000 AS DOUBLE) / count(*)) / 1000 AS success_rate, count(content) * 100 >= count(*) * 99 AS passed
FROM {_F['fx_tree_files']} WHERE path NOT LIKE '%.md' GROUP BY repo""",
    "scan_source_files": f"""SELECT repo, path, CASE lower(regexp_extract(path, '[.]([^./]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' ELSE 'typescript' END AS lang,
CAST(octet_length(CAST(content AS BLOB)) AS BIGINT) AS n_bytes, content IS NOT NULL AS parse_ok, md5(content) AS content_md5 FROM {_F['fx_tree_files']} WHERE path NOT LIKE '%.md'""",
    "list_symbols": f"SELECT name, kind, file FROM ({base._UNIQUE}) WHERE kind = 'method' AND contains(lower(name), 't1') ORDER BY name LIMIT 100",
    "suggest_symbols": f"SELECT name FROM ({base._UNIQUE}) WHERE contains(lower(name), 'n1') AND NOT EXISTS (SELECT 1 FROM {_F['fx_symbols']} WHERE name = 'N1') ORDER BY name LIMIT 10",
    "changed_source_files": f"SELECT commit, substr(path, 5) AS file FROM {_F['fx_changes']} WHERE starts_with(path, 'app/') AND (path LIKE '%.ts' OR path LIKE '%.tsx')",
    "strip_code_fences": "SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(x, '```')), chr(10))) AS text_md5 FROM documents",
    "assemble_stream_replies": f"""SELECT conv_id, reply, prompt_tokens, coalesce(used, CAST(len(regexp_extract_all(reply, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\n]')) AS BIGINT)) AS completion_tokens FROM (
SELECT conv_id, string_agg(coalesce(json_extract_string(j, '$.choices[0].delta.content'), ''), '' ORDER BY line_no) AS reply, max(CAST(json_extract_string(j, '$.usage.completion_tokens') AS BIGINT)) AS used, max(CAST(json_extract_string(j, '$.usage.prompt_tokens') AS BIGINT)) AS prompt_tokens
FROM (SELECT *, trim(substr(line, 6)) AS j FROM {_F['fx_replies']} WHERE line NOT IN ('data: [DONE]', 'data:', 'data: {{"broken')) GROUP BY conv_id)""",
    "file_add_remove_diff": f"""SELECT d.file AS file, CASE WHEN change = 'added' THEN 'new' ELSE 'deleted' END AS status, name, change FROM ({_O['symbol_diff']}) d
WHERE (d.file NOT IN (SELECT file FROM {_F['fx_old']})) OR (d.file NOT IN (SELECT file FROM {_F['fx_new']}))""",
    "incremental_update": f"""WITH gone AS (SELECT file FROM {_TREE} WHERE pos % 11 = 5)
SELECT repo, 'call' AS kind, caller_file AS src, callee_file AS dst FROM ({base._call_edges(
        f"(SELECT c.* FROM {_F['fx_tree_calls']} c WHERE caller_file NOT IN (SELECT file FROM gone) AND called_name NOT LIKE 'fn%7')",
        f"(SELECT repo, CASE WHEN pos % 9 = 2 THEN name || 'x' ELSE name END AS name, file, kind, pos FROM {_TREE} WHERE pos % 11 <> 5)",
    )})
UNION ALL SELECT DISTINCT repo, 'import', importer_file, imported_file FROM ({base._RESOLVED}) WHERE imported_file IS NOT NULL AND import_path NOT LIKE '%9' AND importer_file NOT IN (SELECT file FROM gone) AND imported_file NOT IN (SELECT file FROM gone)""",
}
