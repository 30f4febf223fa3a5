"""All registered queries of the library and their SQL."""

from __future__ import annotations

from depscope.jobs import code_queries, registry, report_queries

PARTS = (registry, code_queries, report_queries)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
