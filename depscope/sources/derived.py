"""Inputs derived from the given tables, as SQL that Spark and DuckDB both run.

AGG(x, sep, key) stands for the ordered string aggregate, which the engines spell differently.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from depscope.session import ship

PKG = "CAST(floor({k} / 40.0) AS BIGINT)"


def _path(k: str) -> str:
    return f"concat('pkg', {PKG.format(k=k)}, '/mod', {k}, '.ts')"


def _odd(k: str) -> str:
    """A path with brackets, blanks and other letters."""
    return f"concat('app/[id]/(shop) x/é', {k}, '.tsx')"


#: name: (tables and views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    # every row of lineitem is one call: inside a package (returned items), or across packages by name or by method (the others, below)
    "fx_edges": (
        ("lineitem",),
        f"""SELECT DISTINCT l_partkey AS src, {PKG.format(k="l_partkey")} * 40 + l_suppkey % (l_partkey % 40 + 1) + CASE WHEN l_partkey % 10 = 3 THEN 1 ELSE 0 END AS dst
        FROM {{lineitem}} WHERE l_returnflag = 'R'""",
    ),
    "fx_files": (
        ("part", "fx_edges"),
        f"""SELECT 'main' AS repo, {_path("p_partkey")} AS path,
        concat(coalesce(heads, ''), 'export function fn', p_partkey, '(a) {{{{', chr(10), '  return ', coalesce(sums, 'a'), ';', chr(10), '}}}}', chr(10)) AS content
        FROM {{part}} LEFT JOIN (
          SELECT src, AGG(concat('import {{{{ fn', dst, ' }}}} from ''./mod', dst, ''';', chr(10)), '', dst) AS heads,
                 AGG(concat('fn', dst, '(a)'), ' + ', dst) AS sums
          FROM {{fx_edges}} WHERE src <> dst GROUP BY src
        ) e ON src = p_partkey""",
    ),
    "fx_symbols": (
        ("part",),
        f"""SELECT 'main' AS repo, concat('fn', p_partkey) AS name, {_path("p_partkey")} AS file, 'function' AS kind, p_partkey AS pos FROM {{part}}
        UNION ALL SELECT 'main', concat('T', p_size % 5, '.m', p_partkey % 70), {_path("p_partkey")}, 'method', p_partkey FROM {{part}}""",
    ),
    "fx_calls": (
        ("lineitem", "fx_edges"),
        f"""SELECT DISTINCT 'main' AS repo, {_path("src")} AS caller_file, concat('fn', dst) AS called_name FROM {{fx_edges}}
        UNION SELECT DISTINCT 'main', {_path("l_partkey")}, concat('m', l_suppkey % 90) FROM {{lineitem}} WHERE l_returnflag <> 'R'""",
    ),
    # a tree with hubs: files call into the first ones across packages, some by the names of interface methods
    "fx_tree_symbols": (
        ("part",),
        f"""SELECT 'main' AS repo, concat('fn', p_partkey) AS name, {_path("p_partkey")} AS file, 'function' AS kind, p_partkey AS pos FROM {{part}}
        UNION ALL SELECT 'main', concat('I', p_partkey, '.q', p_partkey % 60), {_path("p_partkey")}, 'interface_method', p_partkey FROM {{part}} WHERE p_partkey <= 100""",
    ),
    "fx_tree_calls": (
        ("lineitem", "fx_edges"),
        f"""SELECT DISTINCT 'main' AS repo, {_path("src")} AS caller_file, concat('fn', dst) AS called_name FROM {{fx_edges}}
        UNION SELECT DISTINCT 'main', {_path("l_partkey")}, concat('fn', l_suppkey % 50 + 1) FROM {{lineitem}} WHERE l_returnflag = 'A'
        UNION SELECT DISTINCT 'main', {_path("l_partkey")}, concat('q', l_suppkey % 70) FROM {{lineitem}} WHERE l_returnflag NOT IN ('A', 'R')""",
    ),
    # sources with comments, literals, keywords, declarations and member calls; nested folders, aliases, assets and bare packages
    "fx_sources": (
        ("part",),
        """SELECT 'main' AS repo, p_partkey AS k, concat('app/pkg', @P, '/mod', p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.go' ELSE '.rs' END) AS path,
        CASE p_partkey % 4
          WHEN 0 THEN concat('// calls ghost(1); import "./ghost" /* no */', chr(10), 'import {{ a }} from ''../pkg', @P + 1, '/mod', p_partkey + 40, chr(39), ';', chr(10), 'import "./style.css"', chr(10),
            'import b from "~/pkg', @P, '/mod', p_partkey + 4, '"', chr(10), 'import ''./mod', p_partkey + 8, chr(39), chr(10), 'import c from "~lib/x"; import React from ', chr(39), 'react', chr(39), chr(10), '/* not(1) ', chr(10), ' nor(2) */', chr(10),
            'export class C', p_partkey, ' extends B', p_partkey % 7, ' {{', chr(10), '  area(x: number): number {{ if (x > 1) {{ return helper', p_partkey % 50, '(x, "no(1)", ''nope(2)'') }} return this.size<number> (x) }}', chr(10), '}}', chr(10),
            'interface I', p_partkey, ' {{ m', p_partkey % 60, '(x: number): void }}', chr(10), 'function fn', p_partkey, '(a) {{ while (a) {{ a = fn', p_partkey + 4, ' (a) }} return new C', p_partkey, '(a) }}', chr(10))
          WHEN 1 THEN concat('# ghost(1)', chr(10), 'class T', p_partkey, '(Base):', chr(10), '    def m(self):', chr(10), '        return self.run(helper', p_partkey % 50, ' ("no(1)"))', chr(10), 'def fn', p_partkey, '(a):', chr(10),
            '    if (a): print(a)', chr(10), '    return [fn', p_partkey + 4, '(x) for x in (a)]', chr(10))
          WHEN 2 THEN concat('// ghost(1)', chr(10), 'func (t *T', p_partkey, ') M(a int) int {{ return pkg.Do', p_partkey % 50, '(a) }}', chr(10), 'func Fn', p_partkey, '(a int) int {{ for (a > 0) {{ a = Fn', p_partkey + 4, '(a) }}; s := `no(1)`; return len(s) }}', chr(10))
          ELSE concat('// ghost(1)', chr(10), 'fn fn', p_partkey, '(a: i32) -> i32 {{ if (a > 1) {{ println!("no(1)"); }} let b = T', p_partkey, '::new(a); b.run(); fn', p_partkey + 4, '(a) }}', chr(10), 'struct P', p_partkey, '(i32);', chr(10)) END AS content
        FROM {part}""".replace("@P", PKG.format(k="p_partkey")),
    ),
    # readable, broken and empty configurations of packages, and one at the top
    "fx_configs": (
        ("part", "region"),
        """SELECT DISTINCT 'main' AS repo, concat('app/pkg', @P) AS dir, CASE @P % 5 WHEN 0 THEN '{{"compilerOptions": ' WHEN 1 THEN '{{"compilerOptions":{{"paths":{{"@/*":["./src/*", "./other/*"]}}}}}}' ELSE '{{"compilerOptions":{{"baseUrl":"x"}}}}' END AS json
        FROM {part} WHERE @P % 5 < 3 UNION ALL SELECT 'main', '', '{{"compilerOptions":{{"baseUrl":".","paths":{{"~/*":["app/*"],"~lib/*":["lib/*"]}}}}}}' FROM {region} WHERE r_regionkey = 0""".replace("@P", PKG.format(k="p_partkey")),
    ),
    "fx_reads": (
        ("events",),
        """SELECT 'main' AS repo, event_id AS read_id, concat('agent_', user_id) AS agent_id, concat('sym_', CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 10) AS symbol, ts
        FROM {events} WHERE event_type IN ('view', 'click')""",
    ),
    "fx_deltas": (
        ("events",),
        """SELECT 'main' AS repo, event_id AS delta_id, concat('agent_', user_id) AS emitting_agent, concat('sym_', (CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) + s) % 10) AS symbol, ts
        FROM {events} CROSS JOIN (SELECT 0 AS s UNION ALL SELECT 3) x WHERE event_type = 'purchase'""",
    ),
    "fx_flushes": (("events",), "SELECT 'main' AS repo, event_id AS flush_id, concat('agent_', user_id) AS agent_id, ts FROM {events} WHERE event_type = 'signup'"),
    "fx_tokens": (
        ("events",),
        """SELECT event_id AS record_id, concat('run_', date_part('day', ts)) AS run_id, concat('agent_', user_id) AS agent_id, event_type AS task_id,
        CAST(floor(value * 100) AS BIGINT) AS prompt_tokens, CAST(floor(value * 30) AS BIGINT) AS completion_tokens,
        CASE event_id % 6 WHEN 0 THEN 'claude-haiku-4.5' WHEN 1 THEN 'kr/claude-sonnet-4.6' WHEN 2 THEN 'vendor/Haiku-next' WHEN 3 THEN 'my-sonnet' ELSE 'other-model' END AS model,
        CASE event_type WHEN 'error' THEN false WHEN 'purchase' THEN true END AS passed, ts
        FROM {events}""",
    ),
    "fx_diag_log": (
        ("lineitem", "orders"),
        f"""SELECT CAST(l_orderkey % 50 AS BIGINT) AS run_id, CAST(l_linenumber AS BIGINT) AS attempt,
        concat(CASE WHEN l_suppkey % 10 = 4 THEN {_odd("l_partkey")} ELSE {_path("l_partkey")} END, CASE WHEN l_suppkey % 10 = 3 THEN ': note ' ELSE concat('(', CAST(l_quantity AS BIGINT), ',', CAST(round(l_discount * 100) AS BIGINT), '): error TS') END,
               2300 + l_suppkey % 12, ': bad ', l_returnflag, o_orderstatus) AS line_text
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    ),
    # a 17th of the names is defined twice in a file
    "fx_old": (
        ("part",),
        """SELECT 'main' AS repo, concat('f', p_partkey % 50) AS file, concat('s', p_partkey) AS name, concat('b', p_size) AS body, p_partkey * 10 AS start FROM {part} WHERE p_partkey % 11 <> 0 AND p_partkey % 50 <> 7
        UNION ALL SELECT 'main', concat('f', p_partkey % 50), concat('s', p_partkey), concat('d', p_size), p_partkey * 10 - 5 FROM {part} WHERE p_partkey % 17 = 0 AND p_partkey % 11 <> 0 AND p_partkey % 50 <> 7""",
    ),
    "fx_new": (
        ("part",),
        """SELECT 'main' AS repo, concat('f', p_partkey % 50) AS file, concat('s', p_partkey) AS name, concat(CASE WHEN p_size % 5 = 0 THEN 'c' ELSE 'b' END, p_size) AS body, p_partkey * 10 AS start FROM {part} WHERE p_partkey % 13 <> 0 AND p_partkey % 50 <> 8
        UNION ALL SELECT 'main', concat('f', p_partkey % 50), concat('s', p_partkey), concat('e', p_size), p_partkey * 10 - 5 FROM {part} WHERE p_partkey % 17 = 0 AND p_partkey % 13 <> 0 AND p_partkey % 50 <> 8""",
    ),
    "fx_members": (
        ("part",),
        f"""SELECT 'main' AS repo, concat('T', p_size, '.m', p_partkey % 7) AS name, {_path("p_partkey")} AS file, 'method' AS kind, concat('T', p_size) AS parent_type FROM {{part}}
        UNION ALL SELECT 'main', concat('fn', p_partkey), {_path("p_partkey")}, 'function', CAST(NULL AS VARCHAR(9)) FROM {{part}}""",
    ),
    "fx_classes": (
        ("part",),
        f"""SELECT 'main' AS repo, concat('C', p_partkey) AS name, {_path("p_partkey")} AS file, 'class' AS kind,
        split(concat('C', CAST(floor(p_partkey / 3.0) AS BIGINT)), ',') AS extends, split(concat('I', p_size, ',I', p_size + 1), ',') AS implements FROM {{part}}""",
    ),
    "fx_modules": (
        ("part",),
        f"""SELECT 'main' AS repo, p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'go' ELSE 'rust' END AS lang,
        CASE p_partkey % 3 WHEN 0 THEN concat('pkg', {PKG.format(k="p_partkey")}, '/mod', p_partkey, '.py')
          WHEN 1 THEN concat('src/pkg', {PKG.format(k="p_partkey")}, '/mod', p_partkey, '.go') ELSE concat('pkg', {PKG.format(k="p_partkey")}, '/mod', p_partkey, '.rs') END AS path,
        CASE p_partkey % 3
          WHEN 0 THEN concat('import pkg', {PKG.format(k="p_partkey")}, '.mod', p_partkey + 6, chr(10), 'from .mod', p_partkey + 3, ' import f', chr(10), 'LIMIT', p_partkey, ' = 3', chr(10),
            'class T', p_partkey, ':', chr(10), '    def m(self):', chr(10), '        return f(1)', chr(10), 'def fn', p_partkey, '(a):', chr(10), '    return a', chr(10))
          WHEN 1 THEN concat('package p', chr(10), 'import (', chr(10), '"fmt"', chr(10), '"example.com/app/src/pkg', {PKG.format(k="p_partkey")} + 1, '"', chr(10), ')', chr(10),
            'type T', p_partkey, ' struct {{{{ n int }}}}', chr(10), 'func (t *T', p_partkey, ') M(a int) int {{{{ return a }}}}', chr(10), 'func Fn', p_partkey, '(a int) int {{{{ return a }}}}', chr(10))
          ELSE concat('mod mod', p_partkey + 3, ';', chr(10), 'use crate::x;', chr(10), 'use serde::y;', chr(10), 'struct T', p_partkey, ' {{{{ n: i32 }}}}', chr(10),
            'impl T', p_partkey, ' {{{{ fn m(&self) -> i32 {{{{ 1 }}}} }}}}', chr(10), 'fn fn', p_partkey, '(a: i32) -> i32 {{{{ a }}}}', chr(10)) END AS content
        FROM {{part}}""",
    ),
    "fx_replies": (
        ("conversations",),
        """SELECT conv_id, turn AS line_no, concat('data: {{"choices":[{{"delta":{{"content":"', translate(coalesce(text, ''), concat('"', chr(92), chr(10), chr(13), chr(9)), '     '), '"}}}}]}}') AS line FROM {conversations}
        UNION ALL SELECT DISTINCT conv_id, CAST(1000000 AS BIGINT), 'data: [DONE]' FROM {conversations}
        UNION ALL SELECT DISTINCT conv_id, CAST(1000001 AS BIGINT), 'data:' FROM {conversations}
        UNION ALL SELECT DISTINCT conv_id, CAST(1000002 AS BIGINT), 'data: {{"broken' FROM {conversations}
        UNION ALL SELECT DISTINCT conv_id, CAST(1000003 AS BIGINT), concat('data:{{"usage":{{"completion_tokens":', conv_id % 7, ',"prompt_tokens":', conv_id % 11, '}}}}') FROM {conversations} WHERE turn = 1""",
    ),
    "fx_changes": (("part",), f"""SELECT CAST(p_size AS BIGINT) AS commit, concat(CASE WHEN p_partkey % 4 = 0 THEN 'docs/' ELSE 'app/' END, {_path("p_partkey")}, CASE WHEN p_partkey % 5 = 0 THEN 'x' WHEN p_partkey % 7 = 0 THEN '.md' ELSE '' END) AS path FROM {{part}}"""),
    # files of a tree, some without content, some not of a known language
    "fx_tree_files": (
        ("fx_sources", "part"),
        """SELECT repo, path, CASE WHEN k % 23 = 0 THEN NULL ELSE content END AS content FROM {fx_sources}
        UNION ALL SELECT concat('docs', p_partkey % 3), concat('docs/', p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '.md' ELSE '.TSX' END), p_name FROM {part}""",
    ),
    "fx_changed_paths": (("part", "fx_files"), f"""SELECT path AS file FROM {{fx_files}} UNION ALL SELECT {_odd("p_partkey")} FROM {{part}}"""),
    "fx_results": (
        ("events",),
        """SELECT concat('run_', date_part('day', ts)) AS run_id, concat('suite_', user_id % 5) AS suite, concat('test_', event_id) AS name, value > 5 AS passed FROM {events}""",
    ),
}

_AGG = re.compile(r"AGG\((.*), ('[^']*'), (\w+)\)( AS)")


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a derived view."""
    if name not in VIEWS:
        ship(spark)
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, sql = VIEWS[name]
    sql = _AGG.sub(r"listagg(\1, \2) WITHIN GROUP (ORDER BY \3)\4", sql)
    return spark.sql(sql, **{t: source(spark, sf_dir, t) for t in needs})


@cache
def duck(name: str) -> str:
    """The view's SQL for DuckDB, with what it reads inside."""
    needs, sql = VIEWS[name]
    sql = _AGG.sub(r"string_agg(\1, \2 ORDER BY \3)\4", sql)
    return sql.format(**{t: f"({duck(t)})" if t in VIEWS else t for t in needs})
