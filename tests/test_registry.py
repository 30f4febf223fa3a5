"""Every registered query against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from depscope.jobs.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region part lineitem orders events documents conversations".split()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_duckdb(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) or name in ("pending_counts", "new_diagnostics")
    if name not in ORACLES:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)

    def plain(v):
        if pd.isna(v):
            return None
        return v if isinstance(v, str) else round(float(v), 6)

    def rows(df):
        return sorted(str([plain(v) for v in r]) for r in df[cols].astype(object).itertuples(index=False))

    assert rows(got) == rows(want)


def test_closure_with_a_cycle(spark):
    from depscope.operators.graph import closure

    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("q", "a", "z")], "repo string, src string, dst string")
    found = {tuple(r) for r in closure(edges).drop("depth").collect()}
    assert found == {("r", x, y) for x in "abc" for y in "abc"} | {("q", "a", "a"), ("q", "a", "z"), ("q", "z", "z")}


def test_cost_of_a_run(spark):
    from pyspark.sql import functions as F

    from depscope.operators.activity import estimate_cost

    rows = [("claude-haiku-4.5", 5000, 1500), ("claude-haiku-4.5", 6000, 1800), ("kr/claude-sonnet-4.6", 15000, 3000)]
    df = spark.createDataFrame(rows, "model string, p long, c long")
    assert [round(r[0], 6) for r in df.select(estimate_cost(F.col("model"), F.col("p"), F.col("c"))).collect()] == [0.003125, 0.00375, 0.09]


def test_imports_of_either_quote_and_folder(spark):
    from depscope.operators.graph import extract_imports, resolve_imports

    text = "import { a } from '../lib/a'\nimport \"./side\"\nimport b from \"./x/../b\"\nimport '../../../out'\n"
    files = spark.createDataFrame([("r", "src/app/m.ts", text), ("r", "src/lib/a.ts", ""), ("r", "src/app/side.tsx", ""), ("r", "src/app/b.ts", "")], "repo string, path string, content string")
    found = {r["pos"]: (r["import_path"], r["imported_file"]) for r in resolve_imports(extract_imports(files), files).collect()}
    assert found == {0: ("../lib/a", "src/lib/a.ts"), 1: ("./side", "src/app/side.tsx"), 2: ("./x/../b", "src/app/b.ts"), 3: ("../../../out", None)}
