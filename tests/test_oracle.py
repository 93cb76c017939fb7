"""Every catalogue query against its SQL, over the whole smallest tables."""

import os

import duckdb
import pytest

from helixtally.plans.catalogue import CATALOGUE
from helixtally.plans.oracle import ORACLE

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{FOLDER}/documents.parquet')")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_query_matches_sql(spark, duck, name):
    got = CATALOGUE[name](spark, FOLDER)
    want = duck.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    kinds = {f.name: f.dataType.simpleString() for f in got.schema.fields}
    known = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
    assert kinds == {c: known[str(t)] for c, t in zip(want.columns, want.types)}
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    order = [want.columns.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    assert len(rows) == len(expected)
    assert rows == expected
    assert rows
