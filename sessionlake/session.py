"""SparkSession factory and the small helpers that every module shares."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def create_session(app: str = "sessionlake", cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the library assumes: AQE, ANSI SQL, UTC and Arrow."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus if str(cpus).isdigit() else 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SESSIONLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that go to a Python worker at once where the session keeps Spark's default: texts are some kilobytes each.
ARROW_ROWS, SPARK_ARROW_ROWS = "2000", "10000"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one is set only where none is named and Spark runs on one machine.

    Operators that need it also send rows to Python in smaller batches from here on, as both sides of an exchange hold
    whole batches and Spark's side keeps the memory; a session that names another number than Spark's default keeps it.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == SPARK_ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sessionlake-"))
    return context.getCheckpointDir()


@contextmanager
def without_shuffles(spark: SparkSession, **more: str) -> Iterator[None]:
    """Of frames that are made and run inside, Spark removes the shuffle files when they are done. more: other settings."""
    conf, wanted = spark.conf, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", **more}
    before = {key: conf.get(key, "false") for key in wanted}
    try:
        for key, value in wanted.items():
            conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            conf.set(key, value)


def settled(frame: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """frame.checkpoint(), after which Spark removes the shuffle files it took: nothing reads them again.

    batch_rows: how many rows go to a Python worker at once, where rows are large.
    """
    more = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows)} if batch_rows else {}
    with without_shuffles(frame.sparkSession, **more):
        return frame.select("*").checkpoint()  # the settings hold for frames that are made under them


def shards(docs: DataFrame, text_col: str, each: int) -> int:
    """How many buckets of about `each` bytes of text docs makes, at least as many as Spark's shuffles have."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each))
