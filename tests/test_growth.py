"""Steps whose cost for a task or a row must not grow with the table."""

from pyspark.sql import functions as F

from sessionlake.operators import distill
from sessionlake.queries_units import fact_answers


def test_warnings_join_labels_once(spark, tmp_path):
    spark.range(4).select(F.col("id").alias("doc_id")).write.parquet(str(tmp_path / "documents.parquet"))
    out = distill.fact_warnings(*fact_answers(spark, str(tmp_path)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Generate posexplode") == 1
    assert out.count() == 4 * 17


def test_ranges_of_prefixes_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(distill, "RANGE_ROWS", 20, raising=False)
    made, settled = [], distill.settled
    monkeypatch.setattr(distill, "settled", lambda frame: made.append(settled(frame)) or made[-1])
    ids = [f"{k * 7919 % 1000:04d}aaaa{k % 7}{k}" for k in range(300)]
    asked = sorted({i[: 6 + k % 6] for k, i in enumerate(ids)})
    got = distill.resolved_prefixes(spark.createDataFrame([(a,) for a in asked], "candidate string"), spark.createDataFrame([(i,) for i in ids], "id string"))
    want = {a: hits[0] for a in asked if a in ids or len(a) >= 8 for hits in [[i for i in ids if i == a] or [i for i in ids if i.startswith(a)]] if len(hits) == 1}
    assert {r["candidate"]: r["id"] for r in got.collect()} == want
    assert made[-1].rdd.getNumPartitions() >= (len(set(ids)) + len(asked)) // 20
