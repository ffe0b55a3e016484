"""The queries of whole sweeps against their SQL, on texts in which the rule of low signal sees nothing, and on negative ids."""

import duckdb

import __spark_entry__ as entry
from sessionlake import queries_sweep as Q
from sessionlake.operators import sweep_run
from sessionlake.sources import markdown


def test_sweeps_equal_their_sql_on_letterless_texts_and_negative_ids(spark, tmp_path):
    odd = {3: "é.", 6: "", 9: None, 15: "Ñ\nó", 30: "È, é.", 33: "é", -3: "minus", -4: "é.", -5: "minus five"}
    docs = str(tmp_path / "documents.parquet")
    rows = [(i, odd.get(i, f"text {i}"), f"src{i % 2}") for i in range(-8, 40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(docs)
    archive, counters = Q.swept_twice(spark, str(tmp_path))
    index = sweep_run.index_of(spark, archive).select("id", "project", "provider", "title", "date", "archive_path", "transcript_hash")
    files = markdown.read(spark, archive).selectExpr("archive_path", "md5(body) AS body_md5")
    db = duckdb.connect()
    db.execute(f"SET TimeZone = 'UTC'; CREATE VIEW documents AS FROM read_parquet('{docs}/*.parquet')")
    for name, got in (("counters", counters.drop("flagged")), ("index", index), ("files", files)):
        want = db.execute(entry.oracle_sql()[f"sweep_twice_{name}"])
        names = [c[0] for c in want.description]
        assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, want.fetchall())), name
