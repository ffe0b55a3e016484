"""Phone backups and import folders: their manifests, the tables beside the messages, and what an import path holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.sources.markdown import opened
from sessionlake.sources.sqlite import core_data_time, read_table, typedstream_text

TITLE_LABELS, MAX_DEPTH = 4, 5
#: States of messages that the owner sent.
SENT = ["delivered", "send", "pendingNotSent"]


def backup_path(file_id: Column) -> Column:
    """Where a backup keeps a file: in a folder named by the id's first two digits."""
    return F.concat(F.left(file_id, F.lit(2)), F.lit("/"), file_id)


MAGIC = b"SQLite format 3\x00"


def backup_state(folder: str) -> str:
    """ok, encrypted (its manifest is no plain SQLite file) or not_a_backup (no manifest)."""
    from pyarrow.fs import FileType

    fs, root = opened(folder)
    if fs.get_file_info(f"{root}/Manifest.db").type != FileType.File:
        return "not_a_backup"
    with fs.open_input_stream(f"{root}/Manifest.db") as f:
        return "ok" if f.read(len(MAGIC)) == MAGIC else "encrypted"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(fileID, domain, relativePath) of a backup; one that is encrypted or none is an error."""
    state = backup_state(folder)
    if state != "ok":
        raise ValueError(f"{folder}: {state}")
    return read_table(spark, f"{opened(folder)[1]}/Manifest.db", "Files", "fileID string, domain string, relativePath string")


def probed(tables: dict[str, tuple[DataFrame, str | None, str | None, str | None]]) -> DataFrame:
    """(table, rows, first, last, blank, bodies, undecoded) of tables, without their contents and in one job.

    tables: by name (rows, column of times as numbers, column of texts, column of typedstream blobs), columns or null.
    """
    none = F.lit(None).cast("long")
    parts = []
    for name, (rows, at, text, blob) in tables.items():
        empty = F.col(text).isNull() | (F.trim(text) == "") if text else None
        in_blob = F.col(blob).isNotNull() & (empty if text else F.lit(True)) if blob else None
        parts.append(
            rows.agg(
                F.lit(name).alias("table"),
                F.count(F.lit(1)).alias("rows"),
                (F.min(F.col(at).cast("long")) if at else none).alias("first"),
                (F.max(F.col(at).cast("long")) if at else none).alias("last"),
                (F.count_if(empty) if text else none).alias("blank"),
                (F.count_if(in_blob) if blob else none).alias("bodies"),
                (F.count_if(in_blob & typedstream_text(F.col(blob)).isNull()) if blob else none).alias("undecoded"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def located(files: DataFrame, domain: str, path: str) -> DataFrame:
    """(fileID, stored) of a file by domain and path in it; (fileID, domain, relativePath) in."""
    return files.filter((F.col("domain") == domain) & (F.col("relativePath") == path)).select("fileID", backup_path(F.col("fileID")).alias("stored"))


def domains(files: DataFrame, part: str) -> DataFrame:
    """The domains that contain a part, in any case."""
    return files.filter(F.lower("domain").contains(part.lower())).select("domain").distinct().orderBy("domain")


def viber_messages(message: DataFrame, conversation: DataFrame, phone: DataFrame) -> DataFrame:
    """Viber messages with direction, sender and skip reason (null for messages that are kept).

    A received message without a known sender is kept; no_sender marks it.
    """
    known = conversation.select(F.col("Z_PK").alias("ZCONVERSATION"), F.col("ZNAME").alias("chat"), F.lit(True).alias("_known"))
    numbers = phone.select(F.col("Z_PK").alias("ZPHONENUMINDEX"), "ZPHONE")
    rows = message.join(known, "ZCONVERSATION", "left").join(numbers, "ZPHONENUMINDEX", "left")
    state, text = F.coalesce("ZSTATE", F.lit("")), F.nullif(F.trim("ZTEXT"), F.lit(""))
    from_me, ts = state.isin(SENT), core_data_time(F.col("ZDATE"))
    media = (F.coalesce("ZATTACHMENT", F.lit(0)) != 0) | (F.coalesce("ZGALLERYTYPE", F.lit(0)) != 0)
    reason = (
        F.when(ts.isNull(), "bad_date")
        .when(F.col("_known").isNull(), "orphan")
        .when(F.col("ZSYSTEMTYPE").isNotNull(), "system")
        .when(~from_me & (state != "received"), "unknown_state")
        .when(text.isNull() & media, "media")
        .when(text.isNull(), "unusable_text")
    )
    sender = F.when(from_me, "me").otherwise(F.col("ZPHONE"))
    return rows.select(F.concat(F.lit("viber-"), "Z_PK").alias("guid"), F.col("ZCONVERSATION").alias("chat_id"), "chat", text.alias("text"), ts.alias("ts"), from_me.alias("from_me"), sender.alias("sender"), (reason.isNull() & sender.isNull()).alias("no_sender"), reason.alias("skip"))


def message_attachments(join: DataFrame, attachment: DataFrame) -> DataFrame:
    """(message_id, attachments): the files of each message in order of their ids."""
    rows = join.join(attachment.withColumnRenamed("ROWID", "attachment_id"), "attachment_id")
    return rows.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("attachment_id", "filename", "mime_type", "transfer_name", "total_bytes"))).alias("attachments"))


def chat_participants(join: DataFrame, handle: DataFrame) -> DataFrame:
    """(chat_id, participants): the handles of each chat in order of their ids."""
    rows = join.join(handle.select(F.col("ROWID").alias("handle_id"), "id"), "handle_id")
    return rows.groupBy("chat_id").agg(F.transform(F.sort_array(F.collect_set(F.struct("handle_id", "id"))), lambda x: x["id"]).alias("participants"))


def conversation_title(display_name: Column, labels: Column) -> Column:
    """The one participant's label; a group's name, or its first four labels and the number of others."""
    more = F.size(labels) - TITLE_LABELS
    listed = F.array_join(F.slice(labels, 1, TITLE_LABELS), ", ")
    group = F.when(more > 0, F.concat(listed, F.lit(", +"), more.cast("string"))).otherwise(listed)
    named = F.nullif(F.trim(display_name), F.lit(""))
    return F.when(F.size(labels) > 1, F.coalesce(named, group)).otherwise(F.coalesce(F.get(labels, F.lit(0)), F.lit("Unknown")))


def discovered(files: DataFrame, root: str, name: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Files of a name, in any case, at the least depth below a root; hidden folders are passed over.

    A split export counts as well: the name's stem, a hyphen and a suffix. (path, length) in, depth added.
    """
    stem, _, ending = name.lower().rpartition(".")
    below = F.substr(F.col("path"), F.lit(len(root.rstrip("/")) + 2))
    parts = F.split(below, "/")
    last = F.lower(F.element_at(parts, -1))
    whole = (last == name.lower()) | (last.startswith(f"{stem}-") & last.endswith(f".{ending}"))
    rows = files.filter(F.col("path").startswith(root.rstrip("/") + "/")).withColumn("depth", F.size(parts) - 1)
    rows = rows.filter(whole & (F.col("depth") <= max_depth) & ~below.rlike(r"(^|/)\.[^/]*/"))
    return rows.join(rows.agg(F.min("depth").alias("depth")), "depth", "left_semi").select(*files.columns, "depth")


def import_status(providers: DataFrame, files: DataFrame) -> DataFrame:
    """(provider, path, state, file_count, total_bytes); providers: provider, path, present; files: provider, length."""
    held = files.groupBy("provider").agg(F.count("*").alias("file_count"), F.sum("length").cast("long").alias("total_bytes"))
    rows = providers.join(held, "provider", "left")
    state = F.when(F.trim("path") == "", "unset").when(~F.col("present"), "missing_folder").when(F.col("file_count").isNull(), "no_export_found").otherwise("found")
    searched = lambda c: F.when(state == "found", F.col(c)).otherwise(F.lit(0)).cast("long").alias(c)
    return rows.select("provider", "path", state.alias("state"), searched("file_count"), searched("total_bytes"))
