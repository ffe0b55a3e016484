"""A sweep as one batch that can be broken off anywhere and started again.

    scan of each source -> worklist -> answers -> written -> files -> index -> vectors

Each step's result is a table below `<archive>/_runs/<run>/<step>`; a step whose table and counters are complete is not
done again. A step is a function of the tables before it, so doing it twice is doing it once. The model is asked in one
step only, whose table keeps its answers. Sources are read one by one: a source that fails is recorded with its error and
leaves the others whole. Counters are observed while a step's rows are written, not in another pass.

A transcript is stored once, in its source's scan, and only if the session is to be processed. A step's table is removed
as soon as no later step reads it, and so are its shuffle files; its counters stay. Of a complete run nothing else is left.

The index is a folder for each run, and the newest complete one counts; until a run's index is complete, readers see the
one before.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from sessionlake.operators import archive as A
from sessionlake.operators import semantic, sweep
from sessionlake.schema import EMBEDDING, SESSION, TOMBSTONE
from sessionlake.session import without_shuffles
from sessionlake.sources import markdown

#: What a source gives for each session.
SCANNED = (
    "id string, project string, source_jsonl string, source_size_bytes long, session_timestamp timestamp, last_modified timestamp, transcript string, transcript_hash string, updated_at string, "
    "units array<string>, n_messages long, n_owner long, tool string, fill_pct double, fill_estimated boolean, output_tokens long, tokens_estimated boolean, raw_path string, provider string"
)
#: What the model answers for a session.
ANSWER = ["title", "summary", "session_type", "error_tags", "topic_tags", "highlights"]
COUNTERS = ["processed", "skipped", "low_signal_skipped", "business_filtered", "flagged", "errors", "business_errors"]


def markdown_body(title: Column, swept_at: Column, model: str) -> Column:
    """The file of a session; its lines are a fixed format. Times are in the session's time zone."""
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm xxx")
    line = lambda name, value: F.concat(F.lit(f"**{name}:** "), value, F.lit("  \n"))
    fill = F.concat(F.when(F.col("fill_estimated"), "~").otherwise(""), F.format_string("%.1f%%", F.col("fill_pct")))
    marked = F.array_join(F.transform("highlights", lambda h: F.trim(h)), "\n\n")
    return F.concat(
        F.lit("# "), title, F.lit("\n\n"),
        line("Tool", F.col("tool")), line("Provider", F.col("provider")), line("Date created", at(F.col("session_timestamp"))),
        F.when(F.col("last_modified").isNotNull(), line("Last modified", at(F.col("last_modified")))).otherwise(""),
        line("Archived", at(swept_at)), line("Fill at compact", fill), line("Source", F.col("source_jsonl")),
        F.lit("\n---\n\n"), F.col("summary"), F.lit("\n\n"),
        F.when(F.size("highlights") > 0, F.concat(F.lit("## Highlights\n\n"), marked, F.lit("\n\n"))).otherwise(""),
        F.lit(f"---\n*Archived by {model}*\n"),
    )


class Run:
    """One sweep of an archive. `after` is called with each step's name when the step is complete."""

    def __init__(self, spark: SparkSession, archive: str, run: str, after: Callable[[str], None] = lambda step: None):
        self.spark, self.archive, self.run, self.after = spark, archive.rstrip("/"), run, after
        self.fs, self.root = markdown.opened(archive)
        self.counters: dict[str, dict] = {}

    def exists(self, path: str) -> bool:
        from pyarrow.fs import FileType

        return self.fs.get_file_info(f"{self.root}/{path}").type != FileType.NotFound

    def put(self, path: str, value: dict) -> None:
        """A small file, in place at once."""
        self.fs.create_dir(f"{self.root}/{path.rpartition('/')[0]}", recursive=True)
        with self.fs.open_output_stream(f"{self.root}/{path}.new") as out:
            out.write(json.dumps(value).encode())
        self.fs.move(f"{self.root}/{path}.new", f"{self.root}/{path}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.archive}/_runs/{self.run}/{name}")

    def step(self, name: str, made: Callable[[], DataFrame], metrics: dict[str, Column] | None = None, table: str | None = None) -> None:
        """Writes the table of a step, with its observed counters, unless an earlier start of this run has done so."""
        table, mark = table or f"_runs/{self.run}/{name}", f"_runs/{self.run}/{name}.done"
        if not self.exists(mark):
            seen = Observation(name)
            with without_shuffles(self.spark):
                frame = made()
                frame = frame.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in (metrics or {}).items()])
                frame.write.mode("overwrite").parquet(f"{self.archive}/{table}")
            self.put(mark, seen.get)
            self.after(name)
        with self.fs.open_input_stream(f"{self.root}/{mark}") as f:
            self.counters[name] = json.loads(f.read())

    def drop(self, *names: str) -> None:
        """Removes the tables of steps that no later step reads; that the steps are done stays."""
        from pyarrow.fs import FileType

        for path in (f"{self.root}/_runs/{self.run}/{name}" for name in names):
            if self.fs.get_file_info(path).type == FileType.Directory:
                self.fs.delete_dir(path)

    def effect(self, name: str, done: Callable[[], None]) -> None:
        """A step without a table, which may be repeated."""
        if not self.exists(f"_runs/{self.run}/{name}.done"):
            done()
            self.put(f"_runs/{self.run}/{name}.done", {})
            self.after(name)

    def newest(self, table: str, schema: ST.StructType) -> DataFrame:
        """The table of the last run before this one that completed it; empty if there is none."""
        from pyarrow.fs import FileSelector

        runs = sorted(i.base_name for i in self.fs.get_file_info(FileSelector(f"{self.root}/{table}", allow_not_found=True)))
        whole = [r for r in runs if r < self.run and self.exists(f"{table}/{r}/_SUCCESS") and self.exists(f"_runs/{r}/{table}.done")]
        return self.spark.read.schema(schema).parquet(f"{self.archive}/{table}/{whole[-1]}") if whole else self.spark.createDataFrame([], schema)


def index_of(spark: SparkSession, archive: str) -> DataFrame:
    """The index of the newest complete run."""
    return Run(spark, archive, "￿").newest("index", SESSION)


def vectors_of(spark: SparkSession, archive: str) -> DataFrame:
    return Run(spark, archive, "￿").newest("vectors", EMBEDDING)


def run_sweep(
    spark: SparkSession,
    archive: str,
    sources: dict[str, Callable[[], DataFrame]],
    summarise: Callable[[DataFrame], DataFrame],
    run: str,
    swept_at: str,
    embedder: Callable[[list[str]], list[list[float]]] | None = None,
    model: str = "model",
    tombstones: DataFrame | None = None,
    redactions: DataFrame | None = None,
    after: Callable[[str], None] = lambda step: None,
) -> DataFrame:
    """Sweeps the sources into an archive; one row of COUNTERS. Runs are named so that later ones sort later.

    sources: by provider, what reads its sessions (columns of SCANNED, missing ones are null). summarise: sessions to id
    and ANSWER; a session that it leaves out is an error of that session. Started again with the same run after it broke,
    it goes on where it was.
    """
    state = Run(spark, archive, run, after)
    schema = spark.createDataFrame([], SCANNED).schema
    blank = {f.name: F.lit(None).cast(f.dataType) for f in schema}

    def read(provider: str) -> DataFrame:
        found = sources[provider]()
        return found.withColumn("provider", F.lit(provider)).select(*[F.col(n).cast(schema[n].dataType).alias(n) if n in found.columns or n == "provider" else c.alias(n) for n, c in blank.items()])

    index = state.newest("index", SESSION)
    marks = tombstones if tombstones is not None else spark.createDataFrame([], TOMBSTONE)
    todo = F.col("status").isin("new", "changed")

    def judged(provider: str) -> DataFrame:
        rows = sweep.swept(read(provider), index, marks).drop("units")
        return rows.withColumn("transcript", F.when(todo, F.col("transcript")))

    scans, failed = [], {}
    for known in (index.select("id", "transcript_hash", "updated_at", "source_size_bytes"), marks.select("id", "source_path")):
        known.write.format("noop").mode("overwrite").save()  # what cannot be read here is no source's failure
    for provider in sources:
        if state.exists(f"_runs/{run}/scan-{provider}.failed"):
            failed[provider] = ""
            continue
        try:
            state.step(f"scan-{provider}", lambda provider=provider: judged(provider))
            scans.append(f"scan-{provider}")
        except (PySparkException, OSError, ValueError) as e:
            state.put(f"_runs/{run}/scan-{provider}.failed", {"error": str(e)[:2000]})
            failed[provider] = str(e)

    def sessions() -> DataFrame:
        return reduce(DataFrame.unionByName, map(state.table, scans)) if scans else spark.createDataFrame([], f"{SCANNED}, status string")

    n = lambda *s: F.count_if(F.col("status").isin(*s))
    seen = {"skipped": n("same", "deleted", "low_signal", "business_filtered"), "low_signal_skipped": n("low_signal"), "business_filtered": n("business_filtered")}
    state.step("worklist", lambda: sessions().drop("transcript"), seen)
    state.step("answers", lambda: summarise(sessions().filter(todo).select("id", "provider", "transcript")).select("id", *ANSWER))
    state.drop(*scans)
    at, business = F.lit(swept_at).cast("timestamp"), F.col("provider").isin(sweep.PHONE_SOURCES)

    def written() -> DataFrame:
        done = state.table("worklist").filter(todo).join(state.table("answers").withColumn("_answered", F.lit(True)), "id", "left")
        old = index.select("id", F.col("archive_path").alias("replaces"))
        done = done.join(old, "id", "left").withColumn("title", sweep.session_title(F.col("title"), F.col("project"), F.col("session_timestamp")))
        done = done.withColumn("archive_path", sweep.archive_path(F.col("project"), at, F.col("tool"), F.col("id")))
        done = done.withColumn("body", markdown_body(F.col("title"), at, model))
        if redactions is not None:
            done = A.redacted(done, redactions)
        done = done.withColumns({"secret_flags": A.secret_flags(F.col("body")), "date": F.date_format("session_timestamp", "yyyy-MM-dd"), "_answered": F.coalesce("_answered", F.lit(False))})
        return done.select(*SESSION.names, "body", "replaces", "_answered")

    flagged = {"processed": F.count_if("_answered"), "flagged": F.count_if(F.col("_answered") & (F.size("secret_flags") > 0)), "errors": F.count_if(~F.col("_answered")), "business_errors": F.count_if(~F.col("_answered") & business)}
    state.step("written", written, flagged)
    state.drop("worklist", "answers")
    rows = lambda: state.table("written").filter("_answered")
    state.effect("files", lambda: markdown.write(rows().select("archive_path", "body", "replaces"), archive, run))

    def indexed() -> DataFrame:
        entry = rows().withColumn("session_timestamp", F.date_format("session_timestamp", "yyyy-MM-dd'T'HH:mm:ssXXX"))
        return A.upsert(index, entry.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SESSION], F.lit(0).alias("_pos")))

    state.step("index", indexed, table=f"index/{run}")
    if embedder is not None:

        def vectors() -> DataFrame:
            inputs = rows().select(F.col("id").alias("session_id"), semantic.embedding_input(F.col("title"), F.col("body")).alias("text"))
            inputs = inputs.withColumns({"summary_hash": F.sha2("text", 256), "model_name": F.lit(model)})
            new = semantic.embed(inputs, embedder).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EMBEDDING])
            live = spark.read.schema(SESSION).parquet(f"{state.archive}/index/{run}").select("id")
            return semantic.refreshed_store(state.newest("vectors", EMBEDDING), new, live)

        state.step("vectors", vectors, table=f"vectors/{run}")
    state.drop("written")
    counted = {**state.counters["worklist"], **state.counters["written"]}
    counted["errors"] += len(failed)
    counted["business_errors"] += sum(p in sweep.PHONE_SOURCES for p in failed)
    return spark.createDataFrame([tuple(int(counted[k]) for k in COUNTERS)], ", ".join(f"{k} long" for k in COUNTERS))
