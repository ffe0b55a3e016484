"""Queries of the readers and of the incremental operators: tables are written as exports and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions import phones
from sessionlake.queries import query
from sessionlake.session import ensure_checkpoint_dir, table
from sessionlake.sources import agents, exports, log_lines, nested

TURNS = "SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, md5({}) AS text_md5 FROM conversations WHERE {} <> ''"
LINES = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))"


def digest(messages: DataFrame) -> DataFrame:
    return messages.select("session_id", "turn", "role", F.md5("text").alias("text_md5"))


def by_conversation(rows: DataFrame, *fields: F.Column) -> DataFrame:
    return rows.groupBy("conv_id").agg(*fields)


@query(TURNS.format(LINES, LINES))
def read_chatgpt_export(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation as a mapping of nodes with parent pointers, walked back from its last one."""
    c = table(spark, sf, "conversations")
    node = F.struct(
        F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parent"),
        F.struct(F.struct("role").alias("author"), F.struct(F.lit("text").alias("content_type"), F.array("text").alias("parts")).alias("content")).alias("message"),
    )
    convs = by_conversation(c, F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), node))).alias("mapping"), F.max("turn").cast("string").alias("current_node"))
    docs = convs.select(F.to_json(F.array(F.struct(F.col("conv_id").cast("string").alias("id"), "current_node", "mapping"))).alias("json"))
    return digest(exports.chatgpt(docs))


@query("SELECT coalesce(source, 'none') AS source, row_number() OVER (PARTITION BY coalesce(source, 'none') ORDER BY doc_id) - 1 AS line_no, doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents")
def log_lines_split(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as logs, one file a source, read back by ranges of some kilobytes that cut lines anywhere; a task reads some megabytes of them."""
    folder = f"{ensure_checkpoint_dir(spark)}/logs-{uuid.uuid4().hex}"
    d = table(spark, sf, "documents").withColumn("source", F.coalesce("source", F.lit("none"))).withColumn("text", F.coalesce("text", F.lit("")))
    d.repartition("source").sortWithinPartitions("source", "doc_id").select("source", F.to_json(F.struct("doc_id", "text")).alias("value")).write.partitionBy("source").text(folder)
    rows = log_lines.read(spark, folder, suffix=".txt", split_bytes=50_000, task_bytes=8 << 20).filter("line <> ''")
    doc = F.from_json("line", "doc_id long, text string")
    return rows.select(F.regexp_extract("path", "source=([^/]*)", 1).alias("source"), "line_no", doc["doc_id"].alias("doc_id"), F.md5(doc["text"]).alias("text_md5"))


@query("""WITH t AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS most FROM conversations)
SELECT 'x' || conv_id AS session_id, CAST(turn AS BIGINT) AS turn, role, md5(text) AS text_md5 FROM (SELECT conv_id, turn, most, role, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM t)
WHERE text <> '' AND (conv_id % 4 <> 1 OR turn = 0)""")
def export_threads(spark: SparkSession, sf: str) -> DataFrame:
    """Fourths of the conversations: whole, without a current node, with an unknown parent, and a loop from first to last."""
    c = table(spark, sf, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("most"))
    name = lambda n: F.lpad(n.cast("string"), 6, "0")
    k = F.col("conv_id") % 4
    parent = F.when(F.col("turn") > 0, name(F.col("turn") - 1)).when(k == 2, "gone").when(k == 3, name(F.col("most")))
    message = F.struct(F.struct("role").alias("author"), F.struct(F.lit("text").alias("content_type"), F.array("text").alias("parts")).alias("content"))
    node = F.concat(F.lit('"'), name(F.col("turn")), F.lit('":{"parent":'), F.coalesce(F.concat(F.lit('"'), parent, F.lit('"')), F.lit("null")), F.lit(',"message":'), F.to_json(message), F.lit("}"))
    convs = by_conversation(c.join(last, "conv_id").withColumn("n", node), F.array_join(F.sort_array(F.collect_list("n"), False), ",").alias("m"), F.max("most").alias("most"))
    current = F.when(F.col("conv_id") % 4 == 1, F.lit("nowhere")).otherwise(name(F.col("most")))
    docs = convs.select(F.concat(F.lit('[{"id":"x'), F.col("conv_id").cast("string"), F.lit('","current_node":"'), current, F.lit('","mapping":{'), "m", F.lit("}}]")).alias("json"))
    return digest(exports.chatgpt(docs))


@query("""SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(concat_ws(chr(10), 'first', 't' || doc_id, 'r' || doc_id, 'deep' || doc_id, text, 'x' || doc_id, 'last'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS text_md5 FROM documents""")
def nested_content(spark: SparkSession, sf: str) -> DataFrame:
    """Texts at four levels of arrays and objects, between pictures, numbers and fields that are no text."""
    i = F.col("doc_id").cast("string")
    tag = lambda t: F.concat(F.lit(t), i)
    deepest = F.struct(F.array(F.struct(tag("deep").alias("body"), F.array(F.col("text")).alias("items"))).alias("items"))
    level2 = F.struct(tag("r").alias("result"), F.array(F.array(deepest), F.array_except(F.array(deepest), F.array(deepest))).alias("parts"))
    level1 = F.struct(tag("t").alias("text"), F.array(level2).alias("parts"), F.array(F.struct(tag("x").alias("text"))).alias("items"))
    picture = F.struct(F.lit("image_asset_pointer").alias("content_type"), F.lit("no").alias("text"))
    odd = F.struct(F.struct(F.lit("no").alias("a")).alias("text"), F.lit(7).alias("n"))
    parts = [F.to_json(x) for x in (picture, level1, odd)]
    value = F.concat(F.lit('[" first ",'), parts[0], F.lit(","), parts[1], F.lit(",12,null,"), parts[2], F.lit(',"last"]'))
    rows = table(spark, sf, "documents").select("doc_id", F.parse_json(value).alias("v"))
    found = nested.joined(nested.fragments(rows, ["doc_id"]), ["doc_id"])
    return found.select("doc_id", F.md5("text").alias("text_md5"))


@query(TURNS.format("trim(text)", "trim(text)"))
def read_claudeai_export(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    sender = F.when(F.col("role") == "user", "human").otherwise(F.col("role"))
    m = F.struct("turn", sender.alias("sender"), "text", F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit(" "), "text").alias("text"))).alias("content"))
    convs = by_conversation(c, F.sort_array(F.collect_list(m)).alias("chat_messages"))
    docs = convs.select(F.to_json(F.array(F.struct(F.col("conv_id").cast("string").alias("uuid"), "chat_messages"))).alias("json"))
    return digest(exports.claudeai(docs))


@query(TURNS.format("trim(text)", "trim(text)").replace("turn, role,", "turn, CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS role,"))
def read_grok_export(spark: SparkSession, sf: str) -> DataFrame:
    """Responses come in reverse and are ordered by their times."""
    c = table(spark, sf, "conversations")
    m = F.struct((-F.col("turn")).alias("k"), F.struct(F.col("text").alias("message"), F.when(F.col("role") == "user", "human").otherwise("assistant").alias("sender"), F.to_json(F.struct(F.struct((F.col("turn") * 1000).cast("string").alias("$numberLong")).alias("$date"))).alias("create_time")).alias("response"))
    convs = by_conversation(c, F.sort_array(F.collect_list(m)).alias("responses"))
    docs = convs.select(F.to_json(F.struct(F.array(F.struct(F.struct(F.col("conv_id").cast("string").alias("id")).alias("conversation"), "responses")).alias("conversations"))).alias("json"))
    return digest(exports.grok(docs))


@query("SELECT CAST(user_id AS VARCHAR) AS path, least(100.0, greatest(0.0, round(arg_max(33000 + event_id % 50000, {'t': ts, 'e': event_id}) / 200000.0 * 100, 6)))::DOUBLE AS fill_pct FROM events WHERE event_type <> 'view' GROUP BY 1")
def agent_fill_last_line(spark: SparkSession, sf: str) -> DataFrame:
    """Events as log lines: the last line that names a model tells the fill."""
    e = table(spark, sf, "events")
    usage = F.struct((F.col("event_id") % 50000).alias("input_tokens"))
    line = F.to_json(F.struct(F.struct(F.when(F.col("event_type") == "view", "").otherwise("m").alias("model"), usage.alias("usage")).alias("message")))
    rows = e.select(F.col("user_id").cast("string").alias("path"), F.struct("ts", "event_id").alias("line_no"), line.alias("line"))
    return agents.agent_fill(rows).select("path", F.round("fill_pct", 6).alias("fill_pct"))


@query("SELECT CAST(user_id AS VARCHAR) AS path, CAST(max(event_id) AS BIGINT) AS output_tokens, false AS tokens_estimated FROM events GROUP BY 1")
def forge_token_total(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    rows = e.select(F.col("user_id").cast("string").alias("path"), F.lit(0).alias("line_no"), F.to_json(F.struct(F.lit("usage").alias("type"), F.col("event_id").alias("output_tokens"))).alias("line"))
    return agents.forge_tokens(rows)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '+3069' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN c_custkey % 3 = 1 THEN '+3021' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS phone FROM customer""")
def phone_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """International, national with a trunk zero, and names that are no numbers."""
    digits = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    m = F.col("c_custkey") % 3
    raw = F.when(m == 0, F.concat(F.lit("00 30 (69) "), digits)).when(m == 1, F.concat(F.lit("021-"), digits)).otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", phones.normalize(raw, "30").alias("phone"))


@query("SELECT c_custkey % 1000 AS key, min(c_name) AS name FROM customer GROUP BY 1 HAVING count(*) = 1")
def contact_unambiguous(spark: SparkSession, sf: str) -> DataFrame:
    """At the larger scales every second key has two claims."""
    return phones.contact_keys(table(spark, sf, "customer").select(F.col("c_custkey").alias("contact_id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 1000).alias("key")))
