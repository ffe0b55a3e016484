"""Distillation of sessions to facts: batches, evidence, chunks, grounding, citations and the map and reduce steps."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions import text as T
from sessionlake.session import ensure_checkpoint_dir, settled

BATCH, MAX_FACTS, CHUNK_BYTES, MIN_PREFIX = 18, 10, 6000, 8
#: Ids and candidates in a range of sorted prefixes.
RANGE_ROWS = 250_000
SECTIONS = ["identity", "conventions", "projects", "recurring_problems", "communication_style", "personal_context", "timeline"]
#: Near-miss names of sections.
SECTION_ALIASES = {
    "preferences": "conventions", "convention": "conventions", "conventions_preferences": "conventions", "personal": "personal_context", "interests": "personal_context",
    "life_context": "personal_context", "problems": "recurring_problems", "recurring": "recurring_problems", "communication": "communication_style",
    "style": "communication_style", "project": "projects", "active_projects": "projects", "context": "identity", "highlights": "timeline",
}


def batches(rows: DataFrame, order: list[Column], size: int = BATCH, by: str | None = None) -> DataFrame:
    """batch number and label S1.. in the batch, for each value of `by` or over all rows.

    Without `by` rows are sorted by ranges, and each range's numbers start after those of the ranges before it.
    """
    if by:
        numbered = rows.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
    else:
        ensure_checkpoint_dir(rows.sparkSession)
        ordered = settled(rows.orderBy(*order).withColumn("_range", F.spark_partition_id()))
        ranges = ordered.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
        before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
        numbered = ordered.withColumn("_k", place).join(ranges.select("_range", before.alias("_before")), "_range").withColumn("_k", F.col("_k") + F.col("_before")).drop("_range", "_before")
    return numbered.withColumns({"batch": F.floor(F.col("_k") / size), "label": F.concat(F.lit("S"), (F.col("_k") % size + 1).cast("string"))}).drop("_k")


def evidence_entry(label: Column, title: Column, date: Column, body: Column) -> Column:
    return F.concat(F.lit("["), label, F.lit("] "), date, F.lit(" "), title, F.lit("\n"), T.head_tail_chars(body))


def evidence_blocks(rows: DataFrame) -> DataFrame:
    """(batch, ids, block): the entries of each batch in order of label."""
    entries = F.sort_array(F.collect_list(F.struct(F.substring("label", 2, 9).cast("int").alias("k"), F.col("id"), F.col("entry"))))
    grouped = rows.groupBy("batch").agg(entries.alias("e"))
    return grouped.select("batch", F.transform("e", lambda x: x["id"]).alias("ids"), F.array_join(F.transform("e", lambda x: x["entry"]), "\n\n---\n\n").alias("block"))


def canonical_label(c: Column) -> Column:
    """S4 for s4, [S4], Session 4 and 4."""
    n = F.regexp_extract(F.trim(c), r"(?i)^\[?(?:session\s*|s)?\s*(\d+)\]?$", 1)
    return F.when(n != "", F.concat(F.lit("S"), n)).otherwise(F.trim(c))


def split_evidence(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"[,;\s]+"), lambda x: x != ""))


def section_of(c: Column) -> Column:
    """The section that a name stands for, null for none."""
    names = {**{s: s for s in SECTIONS}, **SECTION_ALIASES}
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.lower(F.trim(c))]


FACTS = "array<struct<section:string,fact:string,evidence:array<string>,date:string>>"


def parsed_facts(answers: DataFrame) -> DataFrame:
    """Facts of the model's answers (batch, answer): at most ten for each, known sections and non-blank facts only."""
    facts = F.slice(F.from_json(F.get_json_object("answer", "$.facts"), FACTS), 1, MAX_FACTS)
    rows = answers.select("batch", F.posexplode(facts).alias("fact_no", "f")).select("batch", "fact_no", section_of(F.col("f.section")).alias("section"), F.trim("f.fact").alias("fact"), "f.evidence", "f.date")
    return rows.filter("section IS NOT NULL AND fact <> ''")


def resolved_evidence(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """facts with `cited`, an array of (given, id): what each piece of evidence names in its batch, null if nothing.

    Evidence is a label, an id of the batch, or the start, of at least 8 bytes, of exactly one of its ids. A batch's
    labels (batch, label, id) are one row of at most a batch's size, so nothing is multiplied.
    """
    return facts.join(known_labels(labels), "batch").withColumn("cited", cited_ids(F.col("evidence"))).drop("_named", "_ids")


def known_labels(labels: DataFrame) -> DataFrame:
    """(batch, _named, _ids): a batch's ids by label, and its distinct ids; made once for a batch, not for each evidence."""
    known = labels.groupBy("batch").agg(F.array_distinct(F.collect_list(F.struct("label", "id"))).alias("_known"))
    return known.select("batch", F.map_from_entries("_known").alias("_named"), F.array_distinct(F.transform("_known", lambda x: x["id"])).alias("_ids"))


def cited_ids(evidence: Column) -> Column:
    """What each piece of evidence names among _named and _ids, as `cited` of resolved_evidence."""
    named, ids = F.col("_named"), F.col("_ids")

    def one(e: Column) -> Column:
        starts = F.when(F.octet_length(e) >= MIN_PREFIX, F.filter(ids, lambda i: i.startswith(e)))
        only = F.transform(F.array(starts), lambda s: F.when(F.size(s) == 1, s[0]))[0]
        return F.struct(e.alias("given"), F.coalesce(F.try_element_at(named, canonical_label(e)), F.when(F.array_contains(ids, e), e), only).alias("id"))

    return F.transform(F.filter(evidence, lambda e: e.isNotNull()), one)


def validated_facts(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """Evidence becomes ids of the batch (labels: batch, label, id); facts without known evidence go."""
    ids = F.array_distinct(F.array_compact(F.transform("cited", lambda x: x["id"])))
    return resolved_evidence(facts, labels).select("batch", "fact_no", "section", "fact", "date", ids.alias("evidence")).filter(F.size("evidence") > 0)


def fact_warnings(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """(batch, fact_no, warning): facts that were left out and why, and evidence that names no session of its batch."""
    facts = F.slice(F.from_json(F.get_json_object("answer", "$.facts"), FACTS), 1, MAX_FACTS)
    answered = answers.select("batch", facts.alias("facts")).join(known_labels(labels), "batch", "left")
    section, fact = section_of(F.col("f.section")), F.trim("f.fact")
    items = answered.select("batch", F.posexplode("facts").alias("fact_no", "f"), "_named", "_ids")
    why = (
        F.when(F.col("f.section").isNull(), "skipped fact without a section")
        .when(F.col("f.fact").isNull(), F.concat(F.lit("skipped fact without a text in section "), F.col("f.section")))
        .when(section.isNull(), F.concat(F.lit("skipped fact with unknown section "), F.col("f.section")))
    )
    good = section.isNotNull() & F.coalesce(fact != "", F.lit(False)) & F.col("_ids").isNotNull()
    judged = items.select("batch", "fact_no", why.alias("skipped"), F.when(good, fact).alias("fact"), F.when(good, F.coalesce(cited_ids(F.col("f.evidence")), F.expr("array()").cast("array<struct<given:string,id:string>>"))).alias("cited"))
    unknown = F.transform(F.filter("cited", lambda x: x["id"].isNull()), lambda x: F.concat(F.lit("dropped unknown evidence "), x["given"]))
    bare = F.when(F.forall("cited", lambda x: x["id"].isNull()), F.concat(F.lit("dropped fact without evidence: "), "fact"))
    warnings = F.array_compact(F.concat(F.array("skipped", bare), F.coalesce(unknown, F.expr("array()").cast("array<string>"))))
    return judged.select("batch", "fact_no", F.explode(warnings).alias("warning"))


def map_batches(blocks: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """(batch, answer) of a model; a failing call gives a null answer, so the watermark can be held back."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = []
            for block in frame["block"]:
                try:
                    answers.append(model(block))
                except Exception:
                    answers.append(None)
            yield pd.DataFrame({"batch": frame["batch"], "answer": answers})

    return blocks.mapInPandas(run, "batch long, answer string")


def section_text(facts: DataFrame) -> DataFrame:
    """(section, text): a line for each fact, newest first."""
    lines = F.sort_array(F.collect_list(F.struct(F.coalesce("date", F.lit("")).alias("date"), "fact", F.array_join("evidence", ", ").alias("ids"))), asc=False)
    return facts.groupBy("section").agg(lines.alias("f")).select("section", F.array_join(F.transform("f", lambda x: F.concat(F.lit("- "), x["fact"], F.lit(" ["), x["ids"], F.lit("]"))), "\n").alias("text"))


def chunk_lines(c: Column, limit: int = CHUNK_BYTES) -> Column:
    """Chunks of whole lines of at most `limit` bytes; a longer line is a chunk of its own."""
    start = F.struct(F.expr("array()").cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(s: Column, line: Column) -> Column:
        joined = F.when(s["open"] == "", line).otherwise(F.concat(s["open"], F.lit("\n"), line))
        fits = (s["open"] == "") | (F.octet_length(joined) <= limit)
        return F.struct(F.when(fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))).alias("done"), F.when(fits, joined).otherwise(line).alias("open"))

    def finish(s: Column) -> Column:
        return F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))

    return F.aggregate(F.split(c, "\n"), start, add, finish)


def plan_units(units: Column, max_tokens: int) -> Column:
    """Greedy groups of whole units by ceil(chars / 2) tokens: the group number of each unit; an oversized unit fails."""
    tokens = lambda u: F.ceil(F.char_length(u) / 2)
    start = F.struct(F.expr("array()").cast("array<int>").alias("groups"), F.lit(0).alias("group"), F.lit(0).cast("long").alias("used"))

    def add(s: Column, u: Column) -> Column:
        n = F.when(tokens(u) > max_tokens, F.raise_error(F.lit("a unit exceeds the budget")).cast("long")).otherwise(tokens(u).cast("long"))
        fits = s["used"] + n <= max_tokens
        group = F.when(fits, s["group"]).otherwise(s["group"] + 1)
        return F.struct(F.concat(s["groups"], F.array(group)).alias("groups"), group.alias("group"), F.when(fits, s["used"] + n).otherwise(n).alias("used"))

    return F.aggregate(units, start, add, lambda s: s["groups"])


def word_target(c: Column) -> Column:
    return F.least(F.lit(900), F.greatest(F.lit(300), F.round(F.char_length(c) / 4 * 0.18))).cast("int")


def with_normal(text: Column, body: Callable[[Column], Column]) -> Column:
    """body of the normalised text, which is made once: a lambda's variable is bound, a plain column may be inlined again."""
    return F.transform(F.array(T.normalize_text(text)), body)[0]


def grounded_tags(tags: Column, transcript: Column) -> Column:
    """Tags of at most 40 characters that the text holds: a single word as a word, more as a part."""
    named = F.transform(tags, lambda tag: F.struct(tag.alias("tag"), T.normalize_text(tag).alias("t")))

    def held(text: Column) -> Column:
        words = F.concat(F.lit(" "), text, F.lit(" "))
        whole = lambda t: F.when(t.contains(" "), text.contains(t)).otherwise(words.contains(F.concat(F.lit(" "), t, F.lit(" "))))
        return F.filter(named, lambda x: (F.char_length(x["tag"]) <= 40) & (x["t"] != "") & whole(x["t"]))

    return F.transform(with_normal(transcript, held), lambda x: x["tag"])


def dedupe_tags(tags: Column) -> Column:
    """Without regard to case, the first form stays."""
    return F.filter(tags, lambda t, i: ~F.exists(F.slice(tags, F.lit(1), i), lambda u: F.lower(u) == F.lower(t)))


def grounded_highlights(items: Column, transcript: Column, most: int = 12) -> Column:
    """Distinct highlights of at most 2 000 characters that the text holds, the first `most` of them."""
    named = F.transform(items, lambda h: F.struct(h.alias("h"), T.normalize_text(h).alias("t")))
    held = with_normal(transcript, lambda text: F.filter(named, lambda x: (F.char_length(x["h"]) <= 2000) & (x["t"] != "") & text.contains(x["t"])))
    return F.slice(F.array_distinct(F.transform(held, lambda x: x["h"])), 1, most)


def resolved_prefixes(candidates: DataFrame, ids: DataFrame) -> DataFrame:
    """(candidate, id) where the candidate is an id, or of at least 8 bytes and the start of exactly one id.

    Ids and candidates are sorted together. Of the ids from a candidate on, the first is the candidate itself, or the only
    one that can be repaired to if the second does not start with the candidate too. Two neighbours decide, so no id is
    paired with any other, whatever start they share. Ranges are fixed by a checkpoint; where a range ends before two ids
    have come, the first two ids of the ranges behind it are looked up, two for each range. The number of ranges follows
    from the rows, so a task's memory does not.
    """
    spark = ids.sparkSession
    ensure_checkpoint_dir(spark)
    known = ids.filter("id IS NOT NULL").select(F.col("id").alias("v"), F.lit(1).alias("known")).distinct()
    asked = candidates.filter("candidate IS NOT NULL").select(F.col("candidate").alias("v"), F.lit(0).alias("known")).distinct()
    rows = settled(known.unionByName(asked))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    ranged = settled(rows.repartitionByRange(ranges, "v").withColumn("part", F.spark_partition_id()))
    # descending: an id comes before the candidates that it may be meant by
    back = Window.partitionBy("part").orderBy(F.desc("v"), F.desc("known"))
    so_far, before = back.rowsBetween(Window.unboundedPreceding, 0), back.rowsBetween(Window.unboundedPreceding, -1)
    whole = F.when(F.col("known") == 1, F.col("v"))
    linked = ranged.repartition(ranges, "part").withColumn("pair", F.when(whole.isNotNull(), F.struct(whole.alias("one"), F.last(whole, True).over(before).alias("two"))))
    near = linked.withColumn("pair", F.last("pair", True).over(so_far)).filter("known = 0")
    heads = ranged.filter("known = 1").groupBy("part").agg(F.min_by(F.struct(F.col("v").alias("one")), "v").alias("h"), F.min("v").alias("one"))
    second = ranged.filter("known = 1").join(heads.select("part", "one"), "part").filter("v > one").groupBy("part").agg(F.min("v").alias("two"))
    # one row for each range: a table that grows with the number of ranges only
    later = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = spark.range(ranges).select(F.col("id").cast("int").alias("part")).join(heads.select("part", "one"), "part", "left").join(second, "part", "left").coalesce(1)
    firsts = firsts.withColumn("next", F.last("one", True).over(later))
    firsts = firsts.withColumn("h", F.when(F.col("one").isNotNull(), F.struct("one", F.coalesce("two", "next").alias("two"))))
    tails = firsts.select("part", F.last("h", True).over(later).alias("tail"))
    found = near.join(tails, "part").select(F.col("v").alias("candidate"), F.coalesce("pair.one", "tail.one").alias("id"), F.when(F.col("pair").isNull(), F.col("tail.two")).otherwise(F.coalesce("pair.two", "tail.one")).alias("two"))
    only = (F.octet_length("candidate") >= MIN_PREFIX) & F.startswith("id", "candidate") & ~F.coalesce(F.startswith("two", "candidate"), F.lit(False))
    return found.filter((F.col("id") == F.col("candidate")) | only).select("candidate", "id")


MAX_IDS = 3
#: A bracketed group of ids, none of them followed by a link's target: hex digits and hyphens, eight or more.
ID_GROUP = r"\[((?:[ ]*[0-9A-Fa-f-]{8,}[ ]*,)*[ ]*[0-9A-Fa-f-]{8,}[ ]*)\](?!\()"


def group_ids(inner: str) -> list[str]:
    """The ids of a group, or none if one has no hex letter: numbers and dates in brackets are prose."""
    ids = [t.strip() for t in inner.split(",")]
    return ids if all(re.search("[A-Fa-f]", t) for t in ids) else []


def sanitized_citations(text: str, known: dict[str, str]) -> tuple[str, list[str]]:
    """(text, warnings): groups keep the ids that known has (at most three), groups with none go with a doubled space."""
    warnings: list[str] = []

    def one(m: re.Match) -> str:
        before, inner, after = m.group(1), m.group(2), m.group(3)
        ids = group_ids(inner)
        if not ids:
            return m.group()
        warnings.extend(f"dropped unknown id {t}" for t in ids if t not in known)
        kept = [known[t] for t in ids if t in known][:MAX_IDS]
        if kept:
            return f"{before}[{', '.join(kept)}]"
        warnings.append(f"removed group [{inner}]")
        return "" if after else before

    return re.sub(rf"( ?){ID_GROUP}(?=( ?))", one, text), warnings


def with_sanitized_citations(texts: DataFrame, ids: DataFrame, text: str = "text") -> DataFrame:
    """texts (id, text, ...) with their citation groups resolved against all ids, and `warnings`; ids or unique prefixes count."""
    groups = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(ID_GROUP), 1), lambda g: F.transform(F.split(g, ","), lambda x: F.trim(x))))
    cited = texts.select("id", F.explode(F.array_distinct(groups)).alias("candidate"))
    known = cited.join(resolved_prefixes(cited, ids).withColumnRenamed("id", "whole"), "candidate")
    maps = known.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("candidate", "whole"))).alias("_known"))

    @F.pandas_udf("struct<text:string,warnings:array<string>>")
    def rewrite(body: pd.Series, found: pd.Series) -> pd.DataFrame:
        done = [(None, []) if t is None else sanitized_citations(t, dict(k) if k is not None else {}) for t, k in zip(body, found, strict=True)]
        return pd.DataFrame(done, columns=["text", "warnings"])

    joined = texts.join(maps, "id", "left").withColumn("_new", rewrite(text, "_known"))
    return joined.withColumns({text: F.col("_new.text"), "warnings": F.col("_new.warnings")}).select(*texts.columns, "warnings")


def parsed_summary(c: Column) -> Column:
    """The summary fields of a model's JSON answer; a missing session type is exploration."""
    s = F.from_json(c, "title string, summary string, session_type string, error_tags array<string>, topic_tags array<string>, highlights array<string>")
    return F.struct(s["title"].alias("title"), s["summary"].alias("summary"), F.coalesce(F.nullif(s["session_type"], F.lit("")), F.lit("exploration")).alias("session_type"), s["error_tags"].alias("error_tags"), s["topic_tags"].alias("topic_tags"), s["highlights"].alias("highlights"))


def profile_sections(markdown: str, headings: dict[str, str]) -> dict[str, str]:
    """Section texts of a rendered profile: known `## ` headings only."""
    parts = re.split(r"^## +(.+)$", markdown, flags=re.MULTILINE)
    return {headings[h.strip()]: body.strip() for h, body in zip(parts[1::2], parts[2::2], strict=True) if h.strip() in headings}


#: The array fields of a partial summary, in order.
PARTIAL_FIELDS = ["goals", "actions", "files_changed", "tests", "decisions", "risks", "open_issues", "evidence", "verbatim_highlights"]


def missing_partial_fields(answer: Column) -> Column:
    """The fields of a partial summary that are no JSON array; an answer that is no object misses all."""
    is_array = lambda f: F.coalesce(F.get_json_object(answer, f"$.{f}").startswith("["), F.lit(False))
    return F.array_compact(F.array(*[F.when(~is_array(f), F.lit(f)) for f in PARTIAL_FIELDS]))


CONSOLIDATE_BYTES, EMPTY_SECTION, PROFILE_PROMPT_BYTES = 60_000, "_No facts distilled yet._", 24_000


def reduce_plan(sections: DataFrame, previous: DataFrame, threshold: int = CONSOLIDATE_BYTES, chunk: int = CHUNK_BYTES) -> DataFrame:
    """(section, previous, text, step, chunks) for each known section; sections and previous: section, text.

    keep: no new facts, the old text stays; merge: the facts go to the model as they are; consolidate: all sections
    together exceed the threshold, so each goes in chunks of whole lines first.
    """
    spark = sections.sparkSession
    known = spark.createDataFrame([(s, k) for k, s in enumerate(SECTIONS)], "section string, place int")
    joined = known.join(sections.select("section", "text"), "section", "left").join(previous.select("section", F.col("text").alias("previous")), "section", "left")
    total = sections.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("total"))
    rows = joined.join(F.broadcast(total), F.lit(True))
    has = F.coalesce(F.col("text"), F.lit("")) != ""
    step = F.when(~has, "keep").when(F.col("total") > threshold, "consolidate").otherwise("merge")
    chunks = F.when(step == "consolidate", chunk_lines(F.col("text"), chunk)).otherwise(F.expr("array()").cast("array<string>"))
    return rows.select("section", "place", F.coalesce("previous", F.lit("")).alias("previous"), F.coalesce("text", F.lit("")).alias("text"), step.alias("step"), chunks.alias("chunks"))


def reduced(plan: DataFrame, model: Callable[[str, str, str], str]) -> DataFrame:
    """(section, text, failed) after the model's calls: model(section, previous text, facts). A failing call keeps the raw facts after the old text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for section, old, text, step, chunks in zip(*(frame[c] for c in ("section", "previous", "text", "step", "chunks")), strict=True):
                failed = False
                if step == "keep":
                    rows.append((section, old, False))
                    continue
                try:
                    facts = "\n".join(model(section, "", c) for c in chunks) if step == "consolidate" else text
                    new = model(section, old, facts)
                except Exception:
                    new, failed = f"{old}\n{text}" if old else text, True
                rows.append((section, new, failed))
            yield pd.DataFrame(rows, columns=["section", "text", "failed"])

    return plan.mapInPandas(run, "section string, text string, failed boolean")


def rendered_profile(sections: DataFrame, headings: dict[str, str], title: str, trailer: str = "") -> DataFrame:
    """One row (markdown): a title, every section under its heading in order, and a trailer that no model touches."""
    names = F.create_map(*[F.lit(x) for kv in headings.items() for x in kv])
    place = F.create_map(*[F.lit(x) for k, s in enumerate(headings) for x in (s, k)])
    body = F.concat(F.lit("## "), names[F.col("section")], F.lit("\n\n"), F.coalesce(F.nullif("text", F.lit("")), F.lit(EMPTY_SECTION)))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(place[F.col("section")].alias("k"), body.alias("b")))), lambda x: x["b"])
    known = sections.filter(F.col("section").isin(list(headings)))
    return known.agg(F.concat(F.lit(f"# {title}\n\n"), F.array_join(parts, "\n\n"), F.lit(f"\n\n{trailer}")).alias("markdown"))


def profile_state(text: Column, business: bool, enabled: bool) -> Column:
    """loaded, absent or owner_profile_not_found: a business workspace reads its owner's profile only if that is enabled."""
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    if business and not enabled:
        return F.lit("absent")
    return F.when(blank, "owner_profile_not_found" if business else "absent").otherwise("loaded")


def profile_prompt(text: Column) -> Column:
    """A profile for a prompt: at most 24 000 bytes, cut between characters."""
    return T.cap_bytes(text, PROFILE_PROMPT_BYTES)


def unanswered(blocks: DataFrame, pending_facts: DataFrame) -> DataFrame:
    """The batches (block) that an earlier, broken run has no stored answer for; pending_facts: block_hash, answer."""
    done = pending_facts.filter("answer IS NOT NULL").select("block_hash")
    return blocks.withColumn("block_hash", F.sha2("block", 256)).join(done, "block_hash", "left_anti")


def resumed(blocks: DataFrame, pending_facts: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """(batch, block_hash, answer) of all batches: stored answers where there are any, the model's for the rest."""
    hashed = blocks.withColumn("block_hash", F.sha2("block", 256))
    rest = unanswered(blocks, pending_facts)
    new = map_batches(rest, model).join(rest.select("batch", "block_hash"), "batch").select("batch", "block_hash", "answer")
    old = hashed.join(pending_facts.filter("answer IS NOT NULL").dropDuplicates(["block_hash"]).select("block_hash", "answer"), "block_hash").select("batch", "block_hash", "answer")
    return old.unionByName(new)


def canned_model(facts: list[dict]) -> Callable[[str], str]:
    """A stand-in for a model that always gives the same facts."""
    answer = json.dumps({"facts": facts})
    return lambda block: answer


def refresh(pending: DataFrame, model: Callable[[str], str], watermark: str) -> tuple[DataFrame, DataFrame, str]:
    """(facts, sections, new watermark) of the pending sessions (id, title, date, session_timestamp, body).

    The watermark moves to the newest session only if every batch was answered.
    """
    labelled = batches(pending, [F.desc("session_timestamp"), F.col("id")]).withColumn("entry", evidence_entry(F.col("label"), F.col("title"), F.col("date"), F.col("body")))
    answers = map_batches(evidence_blocks(labelled), model).cache()
    facts = validated_facts(parsed_facts(answers.filter("answer IS NOT NULL")), labelled)
    failed = answers.filter("answer IS NULL").isEmpty() is False
    newest = pending.agg(F.max(F.coalesce(F.nullif("session_timestamp", F.lit("")), "date"))).first()[0]
    return facts, section_text(facts), watermark if failed or newest is None else max(watermark, newest)
