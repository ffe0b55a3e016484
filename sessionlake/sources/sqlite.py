"""SQLite files as a Spark data source, and the phone-message loaders on top of it.

spark.dataSource.register(SqliteSource); spark.read.format("sqlite").schema(...).option("path", file).option("table", name).
A file is read only, one partition for each `rows` row ids; the path is one that executors can open. Comparisons of a
column with a value go to the file, before partitions are planned: a lookup by an index opens the row ids that it finds.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StringType, StructType

from sessionlake.operators.archive import latest


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        raise ValueError("name the columns with .schema(...)")

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(schema, dict(self.options))


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns, self.options = schema.names, options
        self.kinds = {f.name: f.dataType.simpleString() for f in schema}
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons with a number or text of the column's declared kind; Spark does the others, and all of them again."""
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            yield f
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if self.kinds.get(column) not in ("string", "bigint", "int"):
                continue
            name, exact = "ROWID" if column == "ROWID" else f'"{column}"', str if self.kinds[column] == "string" else int
            name += " COLLATE BINARY" if exact is str else ""
            if type(f) in signs and type(f.value) is exact:
                self.where.append(f"{name} {signs[type(f)]} ?")
                self.values.append(f.value)
            elif type(f) is In and all(type(v) is exact for v in f.value) and len(f.value) <= 500:
                self.where.append(f"{name} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif type(f) is IsNotNull:
                self.where.append(f"{name} IS NOT NULL")
            elif type(f) is StringStartsWith and exact is str and type(f.value) is str:
                self.where.append(f"substr({name}, 1, {len(f.value)}) = ?")
                self.values.append(f.value)

    def condition(self) -> str:
        return "".join(f" AND {w}" for w in self.where)

    def connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro&immutable=1", uri=True)

    def partitions(self) -> list[InputPartition]:
        table, step = self.options["table"], int(self.options.get("rows", 1_000_000))
        with self.connect() as db:
            have = {r[1] for r in db.execute(f'PRAGMA table_info("{table}")')} | {"ROWID"}
            for c in self.columns:
                if c not in have:
                    raise ValueError(f"missing column {table}.{c}")
            lo, hi = db.execute(f'SELECT min(ROWID), max(ROWID) FROM "{table}" WHERE 1{self.condition()}', self.values).fetchone()
        return [InputPartition((a, a + step)) for a in range(lo, hi + 1, step)] if lo is not None else [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = ", ".join(c if c == "ROWID" else f'"{c}"' for c in self.columns)
        with self.connect() as db:
            yield from db.execute(f'SELECT {names} FROM "{self.options["table"]}" WHERE ROWID >= ? AND ROWID < ?{self.condition()}', [*partition.value, *self.values])


def read_table(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sqlite").schema(schema).option("path", path).option("table", table).load()


def ios_time(c: Column) -> Column:
    """Nanoseconds if large, else seconds, since 2001; negative is null."""
    seconds = F.when(c > 1_000_000_000_000, c / 1_000_000_000).otherwise(c.cast("double"))
    return F.when(c >= 0, F.timestamp_micros(((seconds + 978_307_200) * 1_000_000).cast("long")))


def core_data_time(c: Column) -> Column:
    """Seconds since 2001 as a real number; not positive or not finite is null."""
    return F.when((c > 0) & (c < 1e12), F.timestamp_micros(((c + 978_307_200) * 1_000_000).cast("long")))


#: The header of a typedstream, the class names before its string, and the string's tag.
STREAM_HEADER, STREAM_CLASSES, STRING_TAG = b"\x04\x0bstreamtyped", (b"NSString", b"NSMutableString"), b"\x2b"


def stream_string(blob: bytes | None) -> str | None:
    """The first string of a typedstream: header, class name, tag, a length of 1, 3 or 5 bytes, UTF-8; null if any is amiss."""
    blob = bytes(blob or b"")
    found = [(at, len(name)) for name in STREAM_CLASSES if (at := blob.find(name)) >= 0]
    if not blob.startswith(STREAM_HEADER) or not found:
        return None
    at = blob.find(STRING_TAG, sum(min(found)))
    if at < 0 or at + 1 >= len(blob):
        return None
    kind, start = blob[at + 1], at + 2
    if kind > 0x82 or kind == 0x80:
        return None
    size = {0x81: 2, 0x82: 4}.get(kind, 0)
    length = int.from_bytes(blob[start : start + size], "little") if size else kind
    body = blob[start + size : start + size + length]
    try:
        return body.decode() if len(body) == length else None
    except UnicodeDecodeError:
        return None


@F.pandas_udf(StringType())
def typedstream_text(blobs: pd.Series) -> pd.Series:
    return blobs.map(stream_string)


def phone_messages(message: DataFrame, chat_join: DataFrame, handle: DataFrame, chat_handles: DataFrame) -> DataFrame:
    """iPhone messages with conversation, sender and skip reason (null for messages that are kept).

    A message in several chats counts for the first; the sender is the owner, the handle, or the only other participant.
    """
    first = latest(chat_join, ["message_id"], [F.col("chat_id")]).select(F.col("message_id").alias("ROWID"), "chat_id")
    only = chat_handles.groupBy("chat_id").agg(F.when(F.count("*") == 1, F.first("handle_id")).alias("only_handle"))
    text = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.nullif(typedstream_text("attributedBody"), F.lit("")))
    rows = message.join(first, "ROWID", "left").join(only, "chat_id", "left")
    rows = rows.withColumn("sender_handle", F.when(F.col("is_from_me") == 1, None).otherwise(F.coalesce(F.nullif("handle_id", F.lit(0)), "only_handle")))
    rows = rows.join(handle.select(F.col("ROWID").alias("sender_handle"), F.col("id").alias("sender_id")), "sender_handle", "left")
    reason = F.when(F.col("associated_message_type") != 0, "reaction").when(F.col("item_type") != 0, "group_event").when(F.col("chat_id").isNull(), "orphan").when(text.isNull(), "no_text")
    return rows.select("guid", "chat_id", text.alias("text"), ios_time(F.col("date")).alias("ts"), (F.col("is_from_me") == 1).alias("from_me"), F.when(F.col("is_from_me") == 1, "me").otherwise(F.col("sender_id")).alias("sender"), reason.alias("skip"))


def whatsapp_messages(message: DataFrame, sessions: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """WhatsApp messages; orphans, media without text and group events are skipped; a group's own id is never a sender."""
    rows = message.join(sessions.select(F.col("Z_PK").alias("ZCHATSESSION"), F.col("ZPARTNERNAME").alias("chat")), "ZCHATSESSION", "left")
    if members is not None:
        rows = rows.join(members.select(F.col("Z_PK").alias("ZGROUPMEMBER"), "ZMEMBERJID"), "ZGROUPMEMBER", "left")
    jid = F.coalesce(F.col("ZMEMBERJID"), F.col("ZFROMJID")) if members is not None else F.col("ZFROMJID")
    phone = F.when(~jid.endswith("@g.us"), F.concat(F.lit("+"), F.nullif(F.regexp_extract(jid, r"^(\d+)@", 1), F.lit(""))))
    reason = F.when(F.col("chat").isNull(), "orphan").when(F.col("ZGROUPEVENTTYPE") != 0, "group_event").when(F.trim(F.coalesce("ZTEXT", F.lit(""))) == "", "no_text")
    name = F.nullif(F.trim("ZPUSHNAME"), F.lit(""))
    return rows.select(F.col("Z_PK").alias("id"), F.col("ZCHATSESSION").alias("chat_id"), F.col("ZTEXT").alias("text"), core_data_time(F.col("ZMESSAGEDATE")).alias("ts"), (F.col("ZISFROMME") == 1).alias("from_me"), F.when(F.col("ZISFROMME") == 1, "me").otherwise(F.coalesce(name, phone)).alias("sender"), reason.alias("skip"))


def ollama_messages(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages of a local chat database in order; thinking comes before the content."""
    order = F.row_number().over(Window.partitionBy("chat_id").orderBy("created_at", "rowid")) - 1
    thought = F.when(F.trim(F.coalesce("thinking", F.lit(""))) != "", F.concat(F.lit("[Thinking]\n"), F.trim("thinking")))
    rows = messages.join(chats.select(F.col("id").alias("chat_id"), "title"), "chat_id").withColumn("text", F.concat_ws("\n\n", thought, F.nullif(F.trim("content"), F.lit(""))))
    return rows.filter("text <> ''").select(F.col("chat_id").alias("session_id"), "title", order.cast("long").alias("turn"), "role", "text")
