"""Registered queries against their checking SQL on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries

duckdb = pytest.importorskip("duckdb")
from tools.check import TABLES, rows_of  # noqa: E402

FAST = [
    "skip_filter_structure", "count_files_lines", "detect_changes", "latest_progress", "extract_routes", "extract_endpoints",
    "extract_model_fields", "detect_features", "extract_functions", "extract_calls", "dependency_edges", "circular_dependencies",
    "chunk_lines_small", "hash_sums", "topk_search", "hybrid_retrieve", "session_list", "status_rejects", "stream_sessions",
]
NAMES = list(queries()) if os.environ.get("ALL_QUERIES") else FAST


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, con, name):
    df = queries()[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    if name in oracle_sql():
        cur = con.execute(oracle_sql()[name])
        assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["query_id", "text", "context", "sources"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
