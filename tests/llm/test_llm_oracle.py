"""Registered text queries against their SQL, over whole tables."""

import os

import duckdb
import pytest

from helixtally.llm.queries import ORACLE, QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    got, want = QUERIES[name](spark, FOLDER), con.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    rows = sorted(tuple(plain(r[c]) for c in want.columns) for r in got.collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want.fetchall())
    assert rows
