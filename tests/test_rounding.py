"""Decimals as SQL engines and the archive's format print them."""

import math

from pyspark.sql import functions as F

from sessionlake.functions import text as T
from sessionlake.queries import QUERIES


def test_a_component_that_rounds_to_zero_keeps_its_sign(spark, tmp_path):
    rows = spark.createDataFrame([(1, [-1e-9, 1.0, 1e-9, -0.5]), (2, [0.0, -0.0])], "vec_id long, embedding array<float>")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: r["v"] for r in QUERIES["l2_normalize"](spark, str(tmp_path)).collect()}
    assert [math.copysign(1, x) for x in got[1][:3]] == [-1, 1, 1] and got[1][0] == 0 and got[1][3] == -0.447214
    assert [math.copysign(1, x) for x in got[2]] == [1, -1]


def test_sizes_at_halves_go_by_the_double(spark):
    sizes = [50_000 + 100_000 * k for k in range(10, 9_990, 3)] + [10**9 + 5 * 10**7 + 10**8 * k for k in range(400)]
    sizes += [1_000_000, 1_049_999, 1_050_001, 999_950_000, 999_999_999, 864_150_000, 10**15 + 1]
    got = spark.createDataFrame([(s,) for s in sizes], "n long").select("n", T.human_size(F.col("n")).alias("t")).collect()
    want = lambda n: f"{n / 1e6:.1f} MB" if n < 10**9 else f"{n / 1e9:.1f} GB"
    assert [(r["n"], r["t"]) for r in got if r["t"] != want(r["n"])] == []
