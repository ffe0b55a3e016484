"""The sweep: sessions of all sources in one table, the rules that leave some out, what is new, and the written archive."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions import text as T
from sessionlake.operators import archive

#: Sources that live on the machine itself; an import-only workspace leaves them out.
LOCAL_SOURCES = ["claude_code", "codex", "forge", "ollama_chat", "apple_messages", "whatsapp", "whatsapp_business", "viber"]
#: Sources of phone messages.
PHONE_SOURCES = ["apple_messages", "whatsapp", "whatsapp_business", "viber"]
#: Requests that only greet or ask whether somebody is there.
GREETINGS = ["hello", "hi", "hey", "ping", "pong", "test", "testing", "are you here", "are you there", "are you online", "you there"]
#: What requests say that only probe for boards, or for earlier sessions.
BOARD, BOARD_PROBES, SESSION_PROBE = "board", ["monitor", "post to the board", "post on the board"], "search previous session"
MIN_MESSAGES = 3
#: The settings that name each import's folder, and those of one shared phone backup.
IMPORT_SETTINGS = {"chatgpt": "chatgpt_import_path", "claude_ai": "claudeai_import_path", "gemini": "gemini_import_path", "grok": "grok_import_path", "ollama_chat": "ollama_db_path"}
BACKUP_SETTING = "apple_backup_path"


def import_source(settings: dict[str, str], provider: str) -> str | None:
    """The configured path of a provider's import, none if it is unknown or blank."""
    key = BACKUP_SETTING if provider in PHONE_SOURCES else IMPORT_SETTINGS.get(provider)
    return (settings.get(key, "").strip() or None) if key else None


def scanned(sources: dict[str, DataFrame], import_only: bool = False) -> DataFrame:
    """One table of all sources' sessions with their provider; columns that a source lacks are null."""
    chosen = {p: d for p, d in sources.items() if not (import_only and p in LOCAL_SOURCES)}
    if not chosen:
        raise ValueError("no source to scan")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("provider", F.lit(p)) for p, d in chosen.items()])


def raw_total(sources: dict[str, Callable[[], DataFrame]], import_only: bool = False) -> DataFrame:
    """(provider, sessions, failed) of all sources, read anew; a source that cannot be read has none and is marked.

    What a source cannot read shows when its rows are counted, so each source is a job of its own.
    """
    rows = []
    for provider, read in sources.items():
        if import_only and provider in LOCAL_SOURCES:
            continue
        try:
            rows.append((provider, read().count(), False))
        except (PySparkException, OSError, ValueError):
            rows.append((provider, 0, True))
    return SparkSession.active().createDataFrame(rows, "provider string, sessions long, failed boolean")


def requests(units: Column) -> Column:
    """The user's requests among a session's units, normalised; a request is a whole unit, however many paragraphs it has."""
    return F.transform(F.filter(units, lambda u: u.startswith("[User]\n")), lambda u: T.normalize_text(F.substring(u, 8, 1 << 30)))


def low_signal_agent(units: Column) -> Column:
    """All requests are greetings, or together they probe for boards or earlier sessions; without requests it is false."""

    def judged(r: Column) -> Column:
        said = F.array_join(r, " ")
        board = said.contains(BOARD) & reduce(Column.__or__, [said.contains(p) for p in BOARD_PROBES])
        return (F.size(r) > 0) & (board | said.contains(SESSION_PROBE) | F.forall(r, lambda x: x.isin(GREETINGS)))

    return F.coalesce(F.transform(F.array(requests(units)), judged)[0], F.lit(False))


def low_signal_phone(provider: Column, n_messages: Column, n_owner: Column) -> Column:
    return provider.isin(PHONE_SOURCES) & ((n_messages < MIN_MESSAGES) | (n_owner == 0))


def project(override: Column, label: Column) -> Column:
    """A session's own project wins over the one that its path names."""
    return F.coalesce(F.nullif(F.trim(override), F.lit("")), label)


def swept(sessions: DataFrame, index: DataFrame, tombstones: DataFrame) -> DataFrame:
    """sessions with their status: deleted, low_signal, business_filtered, same, or new and changed, which are processed.

    sessions: id, provider, source_jsonl, units (as agents.session_units gives them, before they are joined to a
    transcript; null for other sources), n_messages, n_owner and the columns of archive.change_status.
    """
    left_out = (
        F.when((F.col("provider") == "codex") & low_signal_agent(F.col("units")), "low_signal")
        .when(low_signal_phone(F.col("provider"), F.col("n_messages"), F.col("n_owner")), "business_filtered")
    )
    src = F.coalesce("source_path", F.lit(""))
    marks = tombstones.groupBy("id").agg(F.bool_or(src == "").alias("_any"), F.collect_set(src).alias("_srcs"))
    rows = archive.change_status(sessions.withColumn("_left_out", left_out), index).join(marks, "id", "left")  # units need not be joined
    status = F.when(F.col("_any") | F.array_contains("_srcs", F.col("source_jsonl")), "deleted").otherwise(F.coalesce("_left_out", "change"))
    return rows.withColumn("status", status).drop("_any", "_srcs", "_left_out", "change")


def sweep_counters(rows: DataFrame) -> DataFrame:
    """(processed, skipped, low_signal_skipped, business_filtered, flagged) of a sweep; rows: status, secret_flags."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    done = F.col("status").isin("new", "changed")
    return rows.agg(n("new", "changed").alias("processed"), n("same", "deleted").alias("skipped"), n("low_signal").alias("low_signal_skipped"), n("business_filtered").alias("business_filtered"), F.count_if(done & (F.size("secret_flags") > 0)).alias("flagged"))


def archive_path(project_name: Column, sweep_time: Column, tool: Column, session_id: Column) -> Column:
    """sessions/<project>/<day>/<time>-<slug>-<id>-sweep.md"""
    return F.concat_ws("/", F.lit("sessions"), project_name, F.date_format(sweep_time, "yyyy-MM-dd"), F.concat(F.date_format(sweep_time, "HH-mm-ss"), F.lit("-"), archive.tool_slug(tool), F.lit("-"), session_id, F.lit("-sweep.md")))


def session_title(title: Column, project_name: Column, session_time: Column) -> Column:
    """The summary's title, or the project with the session's day and minute."""
    return F.coalesce(F.nullif(title, F.lit("")), F.concat(project_name, F.lit(" - "), F.date_format(session_time, "yyyy-MM-dd HH:mm")))


def written(rows: DataFrame, index: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(new index, replaced): bodies go to a table by project and day below `target`; replaced names the bodies that no row points at now.

    rows: id, project, archive_path, body, _pos and the index's columns.
    """
    day = F.split_part("archive_path", F.lit("/"), F.lit(3))
    rows.select("id", "archive_path", "body", F.col("project").alias("in_project"), day.alias("sweep_date")).write.mode("append").partitionBy("in_project", "sweep_date").parquet(target)
    old = index.select("id", F.col("archive_path").alias("_old")).join(rows.select("id", "archive_path"), "id").filter("_old <> archive_path")
    return archive.upsert(index, rows.select(*index.columns, "_pos") if "_pos" not in index.columns else rows.select(*index.columns)), old.select("id", F.col("_old").alias("archive_path"))


def preserve_raw(slices: DataFrame, target: str) -> None:
    """Raw slices (id, content), one JSON line each, in zstd files that replace what `target` held."""
    slices.select("id", "content").write.mode("overwrite").option("compression", "zstd").json(target)


def recorded_chats(chats: DataFrame, stored: DataFrame) -> DataFrame:
    """What to store of chats (session_id, created_at, turns): empty turns go, and a stored chat keeps its first created_at."""
    filled = F.filter("turns", lambda t: (F.trim(F.coalesce(t["content"], F.lit(""))) != "") | (F.size(F.coalesce(t["tool_activity"], F.array().cast("array<string>"))) > 0))
    old = stored.select("session_id", F.col("created_at").alias("_created"))
    rows = chats.join(old, "session_id", "left").select("session_id", F.coalesce("_created", "created_at").alias("created_at"), filled.alias("turns")).filter(F.size("turns") > 0)
    return stored.join(rows.select("session_id"), "session_id", "left_anti").unionByName(rows.select(*stored.columns))


def available_raw(index: DataFrame, raws: DataFrame, sources: list[str]) -> DataFrame:
    """(available): indexed sessions of the consented providers whose raw file is there."""
    return index.filter(F.col("provider").isin(sources)).join(raws.select("raw_path"), "raw_path", "left_semi").agg(F.count("*").alias("available"))


def pending(index: DataFrame, watermark: str, sources: list[str]) -> DataFrame:
    """(pending): consented sessions that are later than the watermark."""
    return archive.after_watermark(archive.consented(index, sources, PHONE_SOURCES), watermark).agg(F.count("*").alias("pending"))


def pack(
    index: DataFrame, bodies: DataFrame, digests: DataFrame | None, sources: list[str], raws: DataFrame | None = None, profile: DataFrame | None = None, never: list[str] = PHONE_SOURCES
) -> dict[str, DataFrame]:
    """The tables of a persona pack: consented index rows and their bodies; digests, profile and raws if they are given; a manifest of counts and bytes.

    raws belong to a row by raw_path, or by session_id where they have one.
    """
    rows = archive.consented(index, sources, never)
    tables = {"index": rows, "bodies": bodies.join(rows.select("archive_path"), "archive_path", "left_semi")}
    tables |= {name: table for name, table in (("digests", digests), ("profile", profile)) if table is not None}
    if raws is not None:
        key, own = ("session_id", rows.select(F.col("id").alias("session_id"))) if "session_id" in raws.columns else ("raw_path", rows.select("raw_path"))
        tables["raws"] = raws.join(own, key, "left_semi")
    size = lambda d: F.sum(F.octet_length(F.to_json(F.struct(*d.columns)))).cast("long")
    counts = [d.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.coalesce(size(d), F.lit(0)).alias("bytes")) for name, d in tables.items()]
    return tables | {"manifest": reduce(DataFrame.unionByName, counts)}


def relocated(before: DataFrame, after: DataFrame) -> DataFrame:
    """(files, bytes, same): a copy of an archive (path, length) is good if every file is there with its length and no other."""
    a, b = before.select("path", F.col("length").alias("_a")), after.select("path", F.col("length").alias("_b"))
    joined = a.join(b, "path", "full")
    return joined.agg(F.count("_a").alias("files"), F.coalesce(F.sum("_a"), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.bool_and(F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))), F.lit(True)).alias("same"))


def plist_value(xml: Column, key: str) -> Column:
    """The string or date right after a key of an XML property list, else n/a."""
    found = F.regexp_extract(xml, rf"<key>\Q{key}\E</key>\s*<(?:string>([^<]*)</string|date>([^<]*)</date)>", 0)
    return F.when(found == "", "n/a").otherwise(F.trim(F.regexp_replace(found, r"(?s)^<key>.*?</key>\s*<(string|date)>|</(string|date)>$", "")))


def model_store(store: DataFrame, model: str) -> DataFrame:
    """The records of a vector store that one model made."""
    return store.filter(F.col("model_name") == model)
