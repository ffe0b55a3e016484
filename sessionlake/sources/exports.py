"""Readers of chat exports: JSON conversations to the message table (session_id, turn, role, text, ts, speaker).

Each parser takes a DataFrame with one JSON document a row in `json` and keeps its other columns; `load` reads files.
Schemas are explicit; unreadable documents are dropped (PERMISSIVE) except where a reader says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions import text as T
from sessionlake.session import ensure_checkpoint_dir, settled
from sessionlake.sources import nested

CAPACITY = {"chatgpt": 1_200_000, "grok": 1_200_000, "claudeai": 600_000, "ollama": 600_000, "gemini": 3_000_000}


def load(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(path, json) of the files below a folder, a file a row."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))


def elements(documents: DataFrame, schema: str) -> DataFrame:
    """One row (doc_no, e) for each element of the JSON array in `json`."""
    return documents.select("*", F.posexplode(F.from_json("json", f"array<{schema}>")).alias("doc_no", "e")).drop("json")


def epoch(c: Column) -> Column:
    """Seconds, whole, fractional or as digits, to a timestamp."""
    return F.timestamp_micros((F.try_to_number(c, F.lit("999999999999999.999999")).cast("double") * 1_000_000).cast("long"))


def mongo_time(c: Column) -> Column:
    """{"$date": {"$numberLong": ms}}, a number of milliseconds, or RFC 3339, from JSON text."""
    ms = F.coalesce(F.get_json_object(c, "$['$date']['$numberLong']"), F.get_json_object(c, "$['$date']"), c)
    return F.coalesce(F.timestamp_millis(ms.try_cast("long")), F.trim(F.lit('"'), c).try_cast("timestamp"), F.get_json_object(c, "$['$date']").try_cast("timestamp"))


def attachment_note(names: Column) -> Column:
    full = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.when(F.size(full) > 0, F.concat(F.lit("[Attachments: "), F.array_join(F.transform(full, lambda x: F.trim(x)), ", "), F.lit("]"))).otherwise("")


def joined_blocks(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (F.trim(x) != "")), "\n\n")


def node_table(conversations: DataFrame) -> DataFrame:
    """(tree, node, ord, parent, root, message) of the nodes of conversations (tree, v: variant); ord follows the names of nodes.

    root: the node says that it has no parent, which is not the same as saying nothing.
    """
    nodes = conversations.select("tree", F.posexplode(F.try_variant_get("v", "$.mapping", "map<string,variant>")).alias("ord", "node", "v"))
    parent = F.try_variant_get("v", "$.parent", "variant")
    return nodes.select("tree", "node", "ord", F.when(F.schema_of_variant(parent) == "STRING", F.variant_get(parent, "$", "string")).alias("parent"), F.is_variant_null(parent).alias("root"), F.try_variant_get("v", "$.message", "variant").alias("message"))


def active_threads(conversations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, node, pos): from a root to the current node, by parent pointers.

    Without a current node that is there, the thread is that of the first node that says it has no parent, else of the
    first node. Unknown parents and loops end it.
    """
    current = conversations.select("tree", F.try_variant_get("v", "$.current_node", "string").alias("current"))
    is_current = nodes.join(current, "tree", "left").withColumn("current", F.col("node") == F.col("current"))
    first = is_current.groupBy("tree").agg(F.max(F.when(F.col("current"), F.col("node"))).alias("c"), F.min_by("node", F.when(F.col("root"), F.col("ord"))).alias("r"), F.min_by("node", "ord").alias("f"))
    known = nodes.select("tree", F.col("node").alias("parent"))
    found = nested.ancestors(first.select("tree", F.coalesce("c", "r", "f").alias("node")), nodes.select("tree", "node", "parent").join(known, ["tree", "parent"], "left_semi"))
    longest = found.groupBy("tree").agg(F.max("distance").alias("most"))
    return found.join(longest, "tree").select("tree", "node", (F.col("most") - F.col("distance")).alias("pos"))


def chatgpt(documents: DataFrame) -> DataFrame:
    """Messages of the active threads; hidden, custom and empty system messages and empty texts go.

    A conversation is a row, a node is a row, and a nested part of a message is a row: neither long threads nor deep
    content make a task large.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    each = documents.select(F.explode(F.from_json("json", "array<string>")).alias("e"))
    convs = settled(each.select(F.monotonically_increasing_id().alias("tree"), F.try_parse_json("e").alias("v")).filter("schema_of_variant(v) LIKE 'OBJECT%'"))
    nodes = settled(node_table(convs))
    of = lambda path, kind="string": F.try_variant_get("message", f"$.{path}", kind)
    said = active_threads(convs, nodes).join(nodes.select("tree", "node", "message"), ["tree", "node"]).filter("schema_of_variant(message) LIKE 'OBJECT%'")
    hidden = F.coalesce(of("metadata.is_visually_hidden_from_conversation", "boolean"), F.lit(False)) | F.coalesce(of("metadata.is_user_system_message", "boolean"), F.lit(False))
    named = said.select("tree", "node", "pos", of("author.role").alias("role"), F.coalesce(of("content.content_type"), F.lit("")).alias("kind"), hidden.alias("hidden"), "message", of("create_time").alias("created"))
    kept = settled(named.filter("role IN ('user', 'assistant', 'system') AND NOT hidden"))
    parts = F.when(F.col("kind") == "code", of("content.text", "variant")).otherwise(of("content.parts", "variant"))
    keys = ["tree", "node"]
    content = nested.joined(nested.fragments(kept.select(*keys, parts.alias("v")), keys), keys).withColumnRenamed("text", "content")
    names = F.transform(F.from_json(F.to_json(of("metadata.attachments", "variant")), "array<struct<name:string,file_name:string>>"), lambda a: F.coalesce(a["name"], a["file_name"]))
    full = kept.join(content, keys, "left").filter("NOT (role = 'system' AND (kind IN ('user_editable_context', '') OR content IS NULL))")
    text = T.nonblank_lines(joined_blocks(F.coalesce("content", F.lit("")), attachment_note(names)))
    about = convs.select("tree", F.try_variant_get("v", "$.id", "string").alias("session_id"), F.try_variant_get("v", "$.title", "string").alias("title"))
    rows = full.withColumn("text", text).filter("text <> ''").join(about, "tree")
    return rows.select("session_id", "title", F.col("pos").alias("turn"), "role", "text", epoch(F.col("created")).alias("ts"), F.lit(None).cast("string").alias("speaker"))


CLAUDEAI = (
    "struct<uuid:string,name:string,created_at:string,updated_at:string,chat_messages:array<struct<sender:string,text:string,created_at:string,content:array<struct<"
    "type:string,text:string,name:string,message:string,content:array<struct<text:string>>>>,attachments:array<struct<file_name:string>>,files:array<struct<file_name:string>>>>>"
)
SENDERS = {"human": "user", "assistant": "assistant", "system": "system"}


def block_text(b: Column) -> Column:
    detail = F.trim(F.coalesce(b["message"], F.lit("")))
    name = F.coalesce(b["name"], F.lit("tool"))
    results = F.array_join(F.filter(F.transform(b["content"], lambda x: F.trim(x["text"])), lambda x: x.isNotNull() & (x != "")), "\n")
    return (
        F.when(b["type"] == "text", F.trim(b["text"]))
        .when(b["type"] == "tool_use", F.concat(F.lit("[Tool use: "), name, F.lit("]"), F.when(detail != "", F.concat(F.lit(" "), detail)).otherwise("")))
        .when((b["type"] == "tool_result") & (results != ""), F.concat(F.lit("[Tool result]\n"), results))
    )


def claudeai(documents: DataFrame) -> DataFrame:
    """Messages of known senders: the text, content blocks that say something else, and attachments."""
    rows = elements(documents, CLAUDEAI).select(F.col("e.uuid").alias("session_id"), F.col("e.name").alias("title"), F.posexplode("e.chat_messages").alias("pos", "m"))
    m = F.col("m")
    role = F.create_map(*[F.lit(x) for kv in SENDERS.items() for x in kv])[m["sender"]]
    primary = F.trim(F.coalesce(m["text"], F.lit("")))
    derived = F.trim(F.array_join(F.filter(F.transform(m["content"], block_text), lambda x: x.isNotNull() & (x != "")), "\n\n"))
    other = F.when(T.collapse_spaces(derived) != T.collapse_spaces(primary), derived)
    names = F.concat(F.coalesce(F.transform(m["attachments"], lambda a: a["file_name"]), F.array().cast("array<string>")), F.coalesce(F.transform(m["files"], lambda a: a["file_name"]), F.array().cast("array<string>")))
    text = F.trim(joined_blocks(primary, other, attachment_note(names)))
    return rows.filter(role.isNotNull()).select("session_id", "title", F.col("pos").cast("long").alias("turn"), role.alias("role"), text.alias("text"), m["created_at"].try_cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("speaker")).filter("text <> ''")


GEMINI = "struct<title:string,time:string,header:string,safeHtmlItem:array<struct<html:string>>>"


def gemini(documents: DataFrame) -> DataFrame:
    """Each dated activity is a session of one prompt and one answer."""
    rows = elements(documents, GEMINI).withColumn("ts", F.col("e.time").try_cast("timestamp")).filter("ts IS NOT NULL")
    raw = F.coalesce("e.title", F.lit(""))
    prompt = T.nonblank_lines(F.when(raw.startswith("Prompted "), F.substr(raw, F.lit(10))).otherwise(raw))
    answer = F.array_join(F.filter(F.transform(F.coalesce("e.safeHtmlItem", F.expr("array()").cast("array<struct<html:string>>")), lambda x: T.html_to_text(x["html"])), lambda x: x.isNotNull() & (x != "")), "\n\n")
    flat = F.left(T.collapse_spaces(prompt), F.lit(120))
    title = F.when(flat != "", flat).otherwise(F.coalesce(F.nullif(T.collapse_spaces(F.col("e.header")), F.lit("")), F.lit("Gemini activity")))
    named = rows.select("ts", prompt.alias("prompt"), answer.alias("answer"), title.alias("title"))
    session = F.concat(F.lit("gemini-"), F.date_format("ts", "yyyy-MM-dd'T'HH-mm-ss.SSS'Z'"), F.lit("-"), F.left(F.lower(F.hex(F.xxhash64("title"))), F.lit(8)))
    turns = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("text")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text")))
    out = named.select(session.alias("session_id"), "title", "ts", F.posexplode(F.filter(turns, lambda t: t["text"] != "")).alias("turn", "m"))
    return out.select("session_id", "title", F.col("turn").cast("long"), "m.role", "m.text", "ts", F.lit(None).cast("string").alias("speaker"))


GROK = "struct<conversation:struct<id:string,title:string,create_time:string,modify_time:string>,responses:array<struct<response:struct<message:string,sender:string,create_time:string>>>>"


def grok(documents: DataFrame) -> DataFrame:
    """Non-empty responses by time, undated first, then in order of the export."""
    convs = documents.select(F.posexplode(F.from_json("json", f"conversations array<{GROK}>")["conversations"]).alias("doc_no", "e"))
    r = lambda x: x["response"]
    timed = F.transform(F.col("e.responses"), lambda x, i: F.struct(mongo_time(r(x)["create_time"]).alias("ts"), i.alias("i"), F.trim(r(x)["message"]).alias("text"), F.lower(r(x)["sender"]).alias("sender")))
    ordered = F.sort_array(F.filter(timed, lambda x: x["text"].isNotNull() & (x["text"] != "")))
    rows = convs.filter("e.conversation.id <> ''").select(F.col("e.conversation.id").alias("session_id"), F.col("e.conversation.title").alias("title"), F.posexplode(ordered).alias("turn", "m"))
    role = F.when(F.col("m.sender").isin("human", "user"), "user").otherwise("assistant")
    return rows.select("session_id", "title", F.col("turn").cast("long"), role.alias("role"), "m.text", "m.ts", F.lit(None).cast("string").alias("speaker"))


RECORDED = "session_id string, created_at string, turns array<struct<role:string,content:string,tool_activity:array<string>,attachment_name:string>>"


def recorded(documents: DataFrame) -> DataFrame:
    """Recorded chats: content, tool activity and an attachment line in each turn; empty turns go."""
    rows = documents.select(F.from_json("json", RECORDED).alias("e")).select(F.col("e.session_id").alias("session_id"), F.posexplode("e.turns").alias("turn", "m"))
    note = F.when(F.col("m.attachment_name").isNotNull(), F.concat(F.lit("[Attachment: "), F.col("m.attachment_name"), F.lit("]")))
    text = F.trim(F.concat_ws("\n", F.nullif(F.trim("m.content"), F.lit("")), F.nullif(F.array_join("m.tool_activity", "\n"), F.lit("")), note))
    return rows.select("session_id", F.lit(None).cast("string").alias("title"), F.col("turn").cast("long"), "m.role", text.alias("text"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("speaker")).filter("text <> ''")


READERS = {"chatgpt": chatgpt, "claudeai": claudeai, "gemini": gemini, "grok": grok, "recorded": recorded}


def read(documents: DataFrame, provider: str) -> DataFrame:
    return READERS[provider](documents).withColumn("provider", F.lit(provider))


def session_titles(messages: DataFrame) -> DataFrame:
    """(session_id, title): the export's, else the first 80 characters of the first user message."""
    first = F.min_by(F.when(F.col("role") == "user", F.left("text", F.lit(80))), F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("session_id").agg(F.coalesce(F.max(F.nullif(F.trim("title"), F.lit(""))), first).alias("title"))


def raw_slices(documents: DataFrame, schema: str, key: str) -> DataFrame:
    """(session_id, content): each conversation's own JSON."""
    return elements(documents, schema).select(F.col(f"e.{key}").alias("session_id"), F.to_json("e").alias("content"))
