"""Queries against their SQL on rows that only larger tables have."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sessionlake.functions import text as T


def same_as_sql(spark, folder, name, table):
    db = duckdb.connect()
    db.execute(f"SET TimeZone = 'UTC'; CREATE VIEW {table} AS FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    want = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = [tuple(r[n] for n in names) for r in entry.queries()[name](spark, str(folder)).collect()]
    rows = sorted(map(str, want.fetchall()))
    assert sorted(map(str, got)) == rows and rows
    return got


def test_citations_of_hashes_that_begin_with_digits(spark, tmp_path):
    """The md5 of 118228 and 1466575 begins with 28 and 30 digits, and so do those of 446310 and 778299, which are cited whole."""
    ids = [118228, 1466575, 446310, 778299, 1, 2, 3]
    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(str(tmp_path / "documents.parquet"))
    got = dict(same_as_sql(spark, tmp_path, "citation_sanitise", "documents"))
    assert got[118228] == "see [0389905733927737301864366717f117] end [note]"


def events(spark, folder):
    """Three users' events; from 81005 on their attachments have 10^9 bytes and more."""
    ids = [7, 14, 77, 84, 8400, 81_004, 81_011, 81_018, 99_995, 100_002, 100_009, 2_000_033, 5_999_994]
    rows = [(i, i % 3, ("view", "click", "purchase")[i % 3], dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)) for n, i in enumerate(ids)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz").write.parquet(str(folder / "events.parquet"))


def test_raw_slices_of_large_attachments(spark, tmp_path):
    events(spark, tmp_path)
    same_as_sql(spark, tmp_path, "phone_raw_slices", "events")


def test_sizes_end_at_the_largest_unit(spark):
    rows = spark.createDataFrame([(999,), (2_100_000,), (1_500_000_000,), (74_074_012_345,), (None,)], "n long")
    got = rows.select(T.human_size(F.col("n")), T.human_size(F.col("n"), "MB")).collect()
    assert [tuple(r) for r in got] == [("999 B", "999 B"), ("2.1 MB", "2.1 MB"), ("1.5 GB", "1500.0 MB"), ("74.1 GB", "74074.0 MB"), (None, None)]


def test_phone_sessions_of_large_attachments(spark, tmp_path):
    events(spark, tmp_path)
    same_as_sql(spark, tmp_path, "phone_sessions", "events")
