"""The refresh of a profile as a chain whose answers are kept: select, map, reduce, cite, render, write.

The model is asked batch by batch, in waves; each wave's answers are a table below `<store>/_runs/pending` before the next
wave begins. A refresh that broke off asks the model only for sessions without a stored answer, whatever stopped it. The
reduce begins when all waves are stored and is itself a stored step. When the profile is written, the pending answers go,
unless a batch was not answered: then they stay, the watermark does not move, and the next refresh asks for the rest.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.operators import distill
from sessionlake.operators.sweep_run import Run
from sessionlake.session import ensure_checkpoint_dir, settled

#: The headings of a profile's sections, in order.
HEADINGS = {
    "identity": "Identity & Context", "projects": "Active Projects", "conventions": "Conventions & Preferences", "recurring_problems": "Recurring Problems",
    "communication_style": "Communication Style", "timeline": "Timeline Highlights", "personal_context": "Interests & Life Context",
}
#: Batches that are asked for and stored together.
WAVE = 256
ANSWERS = "batch long, ids array<string>, newest string, answer string"


@dataclass
class Refreshed:
    """What a refresh did: sessions covered, facts, batches asked for now, batches without an answer, warnings, and the watermark."""

    sessions: int
    facts: int
    asked: int
    failed_batches: int
    warnings: list[str]
    watermark: str


class Store:
    """The files of a profile: its text, its meta data and the pending answers."""

    def __init__(self, spark: SparkSession, path: str):
        self.run = Run(spark, path, "pending")
        self.spark, self.path, self.fs, self.root = spark, path.rstrip("/"), self.run.fs, self.run.root

    def text(self, name: str) -> str | None:
        if not self.run.exists(name):
            return None
        with self.fs.open_input_stream(f"{self.root}/{name}") as f:
            return f.read().decode()

    def put(self, name: str, text: str) -> None:
        self.fs.create_dir(self.root, recursive=True)
        with self.fs.open_output_stream(f"{self.root}/{name}.new") as out:
            out.write(text.encode())
        self.fs.move(f"{self.root}/{name}.new", f"{self.root}/{name}")

    def waves(self) -> list[str]:
        """The complete waves of a refresh that did not end."""
        from pyarrow.fs import FileSelector

        names = [i.base_name for i in self.fs.get_file_info(FileSelector(f"{self.root}/_runs/pending", allow_not_found=True))]
        return sorted(n.removesuffix(".done") for n in names if n.startswith("answers-") and n.endswith(".done"))

    def answers(self) -> DataFrame:
        """Stored answers; a batch's number is unique in its wave, so the wave goes before it."""
        tables = [self.spark.read.schema(ANSWERS).parquet(f"{self.path}/_runs/pending/{w}").withColumn("batch", F.concat(F.lit(f"{w}-"), F.col("batch").cast("string"))) for w in self.waves()]
        return reduce(DataFrame.unionByName, tables) if tables else self.spark.createDataFrame([], ANSWERS.replace("batch long", "batch string"))

    def clear(self) -> None:
        if self.run.exists("_runs/pending"):
            self.fs.delete_dir(f"{self.root}/_runs/pending")

    def meta(self) -> dict:
        return json.loads(self.text("meta.json") or "{}")


def labelled(answers: DataFrame) -> DataFrame:
    """(batch, label, id): the labels that a batch's sessions had when the model was asked."""
    return answers.select("batch", F.posexplode("ids").alias("k", "id")).select("batch", F.concat(F.lit("S"), (F.col("k") + 1).cast("string")).alias("label"), "id")


def run_refresh(
    sessions: DataFrame,
    store: str,
    model: Callable[[str], str],
    merge: Callable[[str, str, str], str],
    known_ids: DataFrame | None = None,
    full: bool = False,
    title: str = "Profile",
    trailer: str = "",
    wave: int = WAVE,
    batch: int = distill.BATCH,
    after: Callable[[str], None] = lambda step: None,
) -> Refreshed:
    """Folds the sessions later than the store's watermark (all if full) into its profile.

    sessions: id, title, date, session_timestamp, body. model: an evidence block to facts; merge: (section, old text,
    facts) to a text. known_ids (id): what citations may name, by default all sessions.
    """
    spark = sessions.sparkSession
    ensure_checkpoint_dir(spark)
    kept = Store(spark, store)
    meta = kept.meta()
    at = F.coalesce(F.nullif("session_timestamp", F.lit("")), "date")
    mark = "" if full else meta.get("watermark", "")
    selected = sessions.withColumn("_at", at).filter(F.col("_at") > mark)
    stored = kept.answers().filter("answer IS NOT NULL")
    rest = selected.join(stored.select(F.explode("ids").alias("id")), "id", "left_anti")
    rest = distill.batches(rest, [F.desc("_at"), F.col("id")], batch)
    blocks = rest.withColumn("entry", distill.evidence_entry(F.col("label"), F.col("title"), F.col("date"), F.col("body")))
    newest = rest.groupBy("batch").agg(F.max("_at").alias("newest"))
    blocks = settled(distill.evidence_blocks(blocks).join(newest, "batch"))
    n = blocks.count()
    first = int(kept.waves()[-1].split("-")[1]) + 1 if kept.waves() else 0
    for k in range(0, n, wave):
        part = blocks.filter((F.col("batch") >= k) & (F.col("batch") < k + wave))
        named = part.select("batch", "ids", "newest")
        name = f"answers-{first + k // wave:06d}"
        kept.run.step(name, lambda part=part, named=named: named.join(distill.map_batches(part.select("batch", "block"), model), "batch").select("batch", "ids", "newest", "answer"))
        after(name)
    answers = kept.answers()
    told = answers.filter("answer IS NOT NULL")
    # a batch is unanswered if one of its sessions has no answer in any wave
    open_ids = answers.select(F.explode("ids").alias("id")).distinct().join(told.select(F.explode("ids").alias("id")), "id", "left_anti")
    failed = -(-open_ids.count() // batch)
    facts = settled(distill.validated_facts(distill.parsed_facts(told), labelled(told)))
    if facts.isEmpty() and not n:
        return Refreshed(0, 0, 0, failed, [], meta.get("watermark", ""))
    old = {} if full else distill.profile_sections(kept.text("profile.md") or "", {h: s for s, h in HEADINGS.items()})
    previous = spark.createDataFrame([(s, t) for s, t in old.items() if t != distill.EMPTY_SECTION], "section string, text string")
    # asked once: what the model made of the sections is kept before it is cited and rendered
    made = settled(distill.reduced(distill.reduce_plan(distill.section_text(facts), previous), merge))
    after("reduced")
    cited = distill.with_sanitized_citations(made.select(F.col("section").alias("id"), "text"), known_ids if known_ids is not None else sessions.select("id"))
    done = {r["id"]: r for r in cited.collect()}  # seven sections
    warnings = [f"{s}: {w}" for s in HEADINGS if s in done for w in done[s]["warnings"]]
    about = distill.fact_warnings(told, labelled(told)).groupBy(F.regexp_extract("warning", "^(skipped fact|dropped unknown evidence|dropped fact)", 1).alias("w")).count()
    warnings += [f"{r['w']}: {r['count']}" for r in about.orderBy("w").collect()]  # three kinds, counted
    warnings += [f"{r['section']}: not merged" for r in made.filter("failed").select("section").orderBy("section").collect()]
    sections = spark.createDataFrame([(s, r["text"]) for s, r in done.items()], "section string, text string")
    kept.put("profile.md", distill.rendered_profile(sections, HEADINGS, title, trailer).first()["markdown"])
    covered = told.select(F.explode("ids").alias("id")).distinct().count()
    latest = told.agg(F.max("newest")).first()[0] or ""
    watermark = meta.get("watermark", "") if failed else max(latest, meta.get("watermark", ""))
    total = facts.count()
    kept.put("meta.json", json.dumps({"watermark": watermark, "sessions": covered, "facts": total}))
    if not failed:
        kept.clear()
    return Refreshed(covered, total, n, failed, warnings, watermark)
