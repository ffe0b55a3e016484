"""The driver's contract: every query with SQL gives the rows that DuckDB gives, at the smallest scale."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sessionlake.queries import ORACLE, QUERIES
from sessionlake.session import TABLES

DATA = os.environ.get("SESSIONLAKE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    expected = duck.sql(ORACLE[name])
    assert sorted(expected.columns) == columns
    place = [expected.columns.index(c) for c in columns]
    want = sorted(str([plain(r[i]) for i in place]) for r in expected.fetchall())
    assert sorted(str([plain(r[c]) for c in columns]) for r in frame.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
