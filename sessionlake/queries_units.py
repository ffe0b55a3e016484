"""Queries of agent logs, the other exports, archive upkeep and small functions, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions import phones
from sessionlake.functions import text as T
from sessionlake.operators import archive, briefing, distill, search, semantic, sessions
from sessionlake.queries import LINES, SESSIONS, archive_sessions, query, raw_lines
from sessionlake.session import table
from sessionlake.sources import agents, exports, sqlite

#: The last place of up to 1 800 bytes that no continuation byte (10xxxxxx) follows.
CUT = "CASE WHEN strlen(text) <= 1800 THEN strlen(text) ELSE list_max(list_filter([1797, 1798, 1799, 1800], lambda n: hex(encode(text))[2*n+1:2*n+2] NOT BETWEEN '80' AND 'BF')) END"
FNV = "list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), list_transform(range(0, strlen({0})), lambda i: CAST('0x' || hex(encode({0}))[2*i+1:2*i+2] AS UHUGEINT))), lambda h, b: (xor(h, b) * CAST(1099511628211 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT))"
UNITS = "SELECT CAST(conv_id AS VARCHAR) AS path, CAST(turn AS BIGINT) AS line_no, item_no, md5(unit) AS unit_md5 FROM ({}) WHERE trim(unit) <> ''"


def log_lines(spark: SparkSession, sf: str, body: F.Column) -> DataFrame:
    """conversations as a log: a turn is a line of its conversation's file."""
    return table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").cast("long").alias("line_no"), F.to_json(body).alias("line"))


def digested(units: DataFrame) -> DataFrame:
    return units.select("path", "line_no", F.col("item_no").cast("int").alias("item_no"), F.md5("unit").alias("unit_md5"))


#: What tests take for white space around texts, and a text cut at some characters, in SQL.
TRIMMED = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
CUT_AT = "CASE WHEN length({0}) > {1} THEN left({0}, {1}) || '...[truncated]' ELSE {0} END"
SAID = CUT_AT.format(TRIMMED, 2000)


def window_sql(side: int) -> str:
    """First and last lines of text in SQL; conversations have no carriage returns."""
    lines = "string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))"
    return f"CASE WHEN len({lines}) <= {2 * side} THEN text ELSE array_to_string(list_concat({lines}[1:{side}], ['... (' || (len({lines}) - {2 * side}) || ' lines omitted) ...'], {lines}[-{side}:]), chr(10)) END"


@query(UNITS.format(f"""SELECT conv_id, turn, 0::INTEGER AS item_no, CASE WHEN turn % 4 IN (0, 1) AND {TRIMMED} = '' THEN '' WHEN turn % 4 = 0 THEN '[User]' || chr(10) || {SAID} WHEN turn % 4 = 1 THEN '[Assistant]' || chr(10) || {SAID}
WHEN turn % 4 = 2 THEN '[Tool: shell]' || CASE WHEN turn % 3 = 0 THEN ' ls ' || turn WHEN turn % 3 = 1 AND {TRIMMED} <> '' THEN ' ' || {CUT_AT.format(TRIMMED, 160)} ELSE '' END
WHEN text = '' THEN '' ELSE '[Tool result]' || chr(10) || {window_sql(10)} END AS unit FROM conversations"""))
def codex_units(spark: SparkSession, sf: str) -> DataFrame:
    """Requests after a marker, answers, calls with and without a detail, and results."""
    m, t = F.col("turn") % 4, F.col("turn") % 3
    kind = F.when(m == 0, "user_message").when(m == 1, "assistant_message").when(m == 2, "function_call").otherwise("function_output")
    message = F.when(m == 0, F.when(t == 0, F.concat(F.lit("context\n## My request for Codex:\n"), "text")).otherwise(F.col("text"))).when((m == 1) & (t > 0), F.col("text"))
    arguments = F.when(m == 2, F.struct(F.when(t == 0, F.concat(F.lit(" ls "), F.col("turn").cast("string"))).alias("command"), F.when(t == 1, F.col("text")).alias("pattern")))
    payload = F.struct(kind.alias("type"), message.alias("message"), F.when((m == 1) & (t == 0), F.col("text")).alias("text"), F.when(m == 2, "shell").alias("name"), arguments.alias("arguments"), F.when(m == 3, F.col("text")).alias("output"))
    return digested(agents.codex_units(log_lines(spark, sf, F.struct(F.lit("event_msg").alias("type"), payload.alias("payload")))))


@query(UNITS.format(f"""SELECT conv_id, turn, k::INTEGER AS item_no, u AS unit FROM (SELECT conv_id, turn, unnest(us) AS u, generate_subscripts(us, 1) - 1 AS k FROM (SELECT conv_id, turn,
CASE WHEN turn % 3 = 0 THEN ['[Tool: grep] p' || turn, '[Tool: ?]'] WHEN {TRIMMED} = '' THEN [] ELSE [CASE WHEN role = 'user' THEN '[User]' ELSE '[Assistant]' END || chr(10) || {SAID}, '[Thinking]' || chr(10) || {CUT_AT.format(TRIMMED, 500)}] END AS us
FROM conversations WHERE role IN ('user', 'assistant')))"""))
def forge_units(spark: SparkSession, sf: str) -> DataFrame:
    call = lambda name, path: F.struct(name.alias("name"), F.struct(path.alias("query")).alias("input"))
    calls = F.when(F.col("turn") % 3 == 0, F.array(call(F.lit("grep"), F.concat(F.lit("p"), F.col("turn").cast("string"))), call(F.lit(None).cast("string"), F.lit(" "))))
    return digested(agents.forge_units(log_lines(spark, sf, F.struct("role", F.col("text").alias("content"), F.col("text").alias("reasoning"), calls.alias("tool_calls")))))


@query(UNITS.format(f"""SELECT conv_id, turn, 0::INTEGER AS item_no, CASE WHEN role = 'user' THEN '[User]' ELSE '[Assistant]' END || chr(10) || concat_ws(chr(10), CASE WHEN {TRIMMED} <> '' THEN {SAID} END, CASE
WHEN turn % 2 = 0 THEN CASE WHEN turn % 4 = 0 THEN '[Bash: ls ' || turn || ']' ELSE '[Read: f' || turn || ']' END
WHEN NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1 AND p.role <> 'system') OR turn % 5 = 0 THEN CASE WHEN turn % 3 = 0 THEN '[Error: ' ELSE '[Result: ' END || CASE WHEN strlen(text) <= 500 THEN text ELSE strlen(text) || ' chars' END || ']'
WHEN turn % 4 = 1 THEN CASE WHEN turn % 3 = 0 THEN '[Error: bash]' ELSE '[Result: bash]' END || chr(10) || {window_sql(5)}
ELSE CASE WHEN turn % 3 = 0 THEN '[Error: f' ELSE '[Result: f' END || (turn - 1) || ' (' || CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) END || ' lines)]' END) AS unit FROM conversations c WHERE role <> 'system'"""))
def agent_units(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with a tool's use in even turns and its result in odd ones, found by the id that the turn before registered, if it is known."""
    t = F.col("turn")
    even, s = t % 2 == 0, t.cast("string")
    use = F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("u"), s).alias("id"), F.when(t % 4 == 0, "Bash").otherwise("Read").alias("name"), F.struct(F.concat(F.lit("ls "), s).alias("command"), F.concat(F.lit("f"), s).alias("file_path")).alias("input"))
    named = F.concat(F.when(t % 5 == 0, "gone").otherwise("u"), (t - 1).cast("string"))
    plain = F.struct(F.lit("tool_result").alias("type"), named.alias("tool_use_id"), F.col("text").alias("content"), (t % 3 == 0).alias("is_error"))
    block = F.when(even, F.to_json(use)).otherwise(F.to_json(plain))
    text = F.to_json(F.struct(F.lit("text").alias("type"), "text"))
    rows = log_lines(spark, sf, F.struct("role")).join(table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("path"), t.cast("long").alias("line_no"), text.alias("x"), block.alias("y")), ["path", "line_no"])
    line = F.concat(F.lit('{"message":'), F.regexp_replace("line", r"\}$", ""), F.lit(',"content":['), "x", F.lit(","), "y", F.lit("]}}"))
    return digested(agents.agent_units(rows.select("path", "line_no", line.alias("line"))))


@query("""SELECT CAST(conv_id AS VARCHAR) AS path, CAST(CASE WHEN conv_id % 2 = 0 THEN max_by(100 * turn, turn) ELSE sum(turn) END AS BIGINT) AS output_tokens, false AS tokens_estimated FROM conversations GROUP BY conv_id""")
def codex_token_total(spark: SparkSession, sf: str) -> DataFrame:
    """Even conversations report running totals, odd ones each turn's."""
    even = F.col("conv_id") % 2 == 0
    usage = lambda v: F.struct(v.cast("long").alias("output_tokens"))
    info = F.struct(F.when(even, usage(F.col("turn") * 100)).alias("total_token_usage"), usage(F.col("turn")).alias("last_token_usage"))
    return agents.codex_tokens(log_lines(spark, sf, F.struct(F.struct(F.lit("token_count").alias("type"), info.alias("info")).alias("payload"))))


@query("SELECT CAST(conv_id AS VARCHAR) AS path, CAST(coalesce(sum(turn) FILTER (role = 'assistant'), 0) AS BIGINT) AS output_tokens FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') > 0")
def agent_token_total(spark: SparkSession, sf: str) -> DataFrame:
    message = F.struct("role", F.struct(F.col("turn").alias("output_tokens")).alias("usage"))
    return agents.agent_tokens(log_lines(spark, sf, F.struct(message.alias("message")))).filter("NOT tokens_estimated").select("path", "output_tokens")


@query("""SELECT CAST(conv_id AS VARCHAR) AS path, kind, CAST(n // 4 AS BIGINT) AS output_tokens FROM (
SELECT conv_id, 'agent' AS kind, sum(CASE WHEN role = 'assistant' THEN strlen(text) + 3 + strlen('{"a":' || turn || '}') ELSE 0 END) AS n FROM conversations GROUP BY 1
UNION ALL SELECT conv_id, 'codex', sum(CASE WHEN turn % 2 = 0 THEN strlen(text) ELSE strlen('{"a":' || turn || '}') END) FROM conversations GROUP BY 1
UNION ALL SELECT conv_id, 'forge', sum(CASE WHEN role = 'assistant' THEN strlen(text) + 3 + strlen(CAST(turn AS VARCHAR)) ELSE 0 END) FROM conversations GROUP BY 1)""")
def estimated_tokens_of_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Logs that report no tokens: a quarter of the bytes that the model wrote, tool arguments included."""
    even = F.col("turn") % 2 == 0
    given = F.struct(F.col("turn").alias("a"))
    message = F.struct("role", F.array(F.struct("text", F.lit("hmm").alias("thinking"), given.alias("input"))).alias("content"))
    payload = F.struct(F.when(even, "assistant_message").otherwise("tool_call").alias("type"), F.when(even, F.col("text")).alias("message"), F.when(~even, given).alias("arguments"))
    calls = F.array(F.struct(F.col("turn").cast("string").alias("input")))
    found = {
        "agent": agents.agent_tokens(log_lines(spark, sf, F.struct(message.alias("message")))),
        "codex": agents.codex_tokens(log_lines(spark, sf, F.struct(payload.alias("payload")))),
        "forge": agents.forge_tokens(log_lines(spark, sf, F.struct("role", F.col("text").alias("content"), F.lit("hmm").alias("reasoning"), calls.alias("tool_calls")))),
    }
    parts = [d.filter("tokens_estimated").select("path", F.lit(k).alias("kind"), "output_tokens") for k, d in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT CAST(conv_id AS VARCHAR) AS path, round(least(100.0, max_by(turn, turn) * 1000 / 10000.0 * 100), 6)::DOUBLE AS fill_pct FROM conversations GROUP BY conv_id HAVING least(100.0, max_by(turn, turn) * 1000 / 10000.0 * 100) >= 20")
def codex_fill_gate(spark: SparkSession, sf: str) -> DataFrame:
    info = F.struct(F.struct((F.col("turn") * 1000).alias("input_tokens")).alias("last_token_usage"), F.lit(10000).alias("model_context_window"))
    fills = agents.codex_fill(log_lines(spark, sf, F.struct(F.struct(F.lit("token_count").alias("type"), info.alias("info")).alias("payload"))))
    return agents.gated(fills, 20.0).select("path", F.round("fill_pct", 6).alias("fill_pct"))


@query("SELECT CAST(conv_id AS VARCHAR) AS path, round(max(turn * 100.0 / 50) FILTER (turn % 3 = 0 AND conv_id % 2 = 0), 6)::DOUBLE AS fill_pct FROM conversations GROUP BY conv_id HAVING coalesce(max(turn * 100.0 / 50) FILTER (turn % 3 = 0 AND conv_id % 2 = 0), 100) >= 10")
def forge_fill_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Files without a compaction pass the gate."""
    kind = F.when((F.col("turn") % 3 == 0) & (F.col("conv_id") % 2 == 0), "compaction").otherwise("message")
    fills = agents.forge_fill(log_lines(spark, sf, F.struct(kind.alias("type"), F.col("turn").alias("used_tokens"), F.lit(50).alias("max_tokens"))))
    return agents.gated(fills, 10.0, unknown_passes=True).select("path", F.round("fill_pct", 6).alias("fill_pct"))


@query("SELECT 'f' || conv_id AS path, CASE WHEN conv_id % 2 = 0 THEN 'proj' || conv_id WHEN min(turn) FILTER (role = 'user' AND turn < 8) IS NOT NULL THEN 'w' || min(turn) FILTER (role = 'user' AND turn < 8) END AS project FROM conversations GROUP BY conv_id")
def log_project_labels(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    id = F.col("conv_id").cast("string")
    path = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("/home/projects/proj"), id, F.lit("/f"), id)).otherwise(F.concat(F.lit("/home/f"), id))
    cwd = F.when(F.col("role") == "user", F.concat(F.lit("/work/w"), F.col("turn").cast("string")))
    rows = c.select(path.alias("path"), F.col("turn").cast("long").alias("line_no"), F.to_json(F.struct(F.struct(cwd.alias("cwd")).alias("payload"))).alias("line"))
    return agents.labels(rows).select(T.last_path_part(F.col("path")).alias("path"), "project")


@query(f"""WITH u AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '[User]' ELSE '[Assistant]' END || chr(10) || {SAID}, chr(10) ORDER BY turn) AS t FROM conversations WHERE {TRIMMED} <> '' AND role <> 'system' GROUP BY 1)
SELECT CAST(conv_id AS VARCHAR) AS path, md5(t) AS transcript_md5 FROM u""")
def log_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    content = F.array(F.struct(F.lit("text").alias("type"), "text"))
    rows = log_lines(spark, sf, F.struct(F.struct("role", content.alias("content")).alias("message")))
    return agents.rendered(agents.agent_units(rows)).select("path", F.md5("transcript").alias("transcript_md5"))


FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
NONBLANK = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))"


@query(f"SELECT turn, role, md5(t) AS text_md5, count(*) AS n FROM (SELECT 0 AS turn, 'user' AS role, {NONBLANK} AS t FROM conversations WHERE turn = 0 UNION ALL SELECT 1, 'assistant', 'a' || conv_id FROM conversations WHERE turn = 0) WHERE t <> '' GROUP BY ALL")
def read_gemini_export(spark: SparkSession, sf: str) -> DataFrame:
    """First turns as activities with an HTML answer; the session's hash is this library's own and left out."""
    c = table(spark, sf, "conversations").filter("turn = 0 AND trim(text) <> ''")
    html = F.array(F.struct(F.concat(F.lit("<p>a"), F.col("conv_id").cast("string"), F.lit("</p>")).alias("html")))
    docs = c.select(F.to_json(F.array(F.struct(F.concat(F.lit("Prompted "), "text").alias("title"), F.lit("2024-03-04T05:06:07Z").alias("time"), html.alias("safeHtmlItem")))).alias("json"))
    return exports.gemini(docs).groupBy(F.col("turn").cast("int").alias("turn"), "role", F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"))


@query("""SELECT 'c' || conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, role, md5(concat_ws(chr(10), nullif(trim(text), ''), CASE WHEN turn % 2 = 0 THEN 'ran' END, CASE WHEN turn % 5 = 0 THEN '[Attachment: f' || turn || ']' END)) AS text_md5
FROM conversations WHERE NOT (trim(text) = '' AND turn % 2 = 1 AND turn % 5 <> 0)""")
def read_recorded_chats(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    t = F.col("turn")
    turn = F.struct("turn", "role", F.col("text").alias("content"), F.when(t % 2 == 0, F.array(F.lit("ran"))).otherwise(F.array().cast("array<string>")).alias("tool_activity"), F.when(t % 5 == 0, F.concat(F.lit("f"), t.cast("string"))).alias("attachment_name"))
    docs = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns")).select(F.to_json(F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), F.lit("x").alias("created_at"), "turns")).alias("json"))
    rows = exports.recorded(docs)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("session_id").orderBy("turn")) - 1
    return rows.select("session_id", place.cast("long").alias("place"), "role", F.md5("text").alias("text_md5"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS session_id, 't' || conv_id AS title, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, md5(CASE WHEN turn % 3 = 0 THEN '[Thinking]' || chr(10) || 'hm' || CASE WHEN trim(text) <> '' THEN chr(10) || chr(10) ELSE '' END ELSE '' END || trim(text)) AS text_md5
FROM conversations WHERE trim(text) <> '' OR turn % 3 = 0""")
def read_ollama_chats(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    id = F.col("conv_id").cast("string")
    m = c.select(id.alias("chat_id"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("created_at"), F.col("turn").alias("rowid"), "role", F.col("text").alias("content"), F.when(F.col("turn") % 3 == 0, " hm ").alias("thinking"))
    rows = sqlite.ollama_messages(c.select(id.alias("id"), F.concat(F.lit("t"), id).alias("title")).distinct(), m)
    return rows.select("session_id", "title", "turn", "role", F.md5("text").alias("text_md5"))


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, CASE WHEN conv_id % 2 = 0 THEN 'Named ' || conv_id ELSE left(arg_min(text, turn) FILTER (role = 'user'), 80) END AS title FROM conversations GROUP BY conv_id")
def export_titles(spark: SparkSession, sf: str) -> DataFrame:
    id = F.col("conv_id").cast("string")
    rows = table(spark, sf, "conversations").select(id.alias("session_id"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(" Named "), id)).otherwise(" ").alias("title"), "role", "turn", "text")
    return exports.session_titles(rows)


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, md5('{\"id\":\"' || conv_id || '\",\"n\":' || count(*) || '}') AS content_md5 FROM conversations GROUP BY conv_id")
def export_raw_slices(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "conversations").groupBy("conv_id").count().select(F.to_json(F.array(F.struct(F.col("conv_id").cast("string").alias("id"), F.col("count").alias("n")))).alias("json"))
    return exports.raw_slices(docs, "struct<id:string,n:long>", "id").select("session_id", F.md5("content").alias("content_md5"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at FROM events")
def epoch_parsing(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds as whole numbers, fractions and digits."""
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    text = F.when(F.col("event_id") % 2 == 0, s.cast("string")).otherwise(F.concat(s.cast("string"), F.lit(".5")))
    return table(spark, sf, "events").select("event_id", F.date_format(exports.epoch(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'null' ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS ios, CASE WHEN event_id % 7 = 0 THEN 'null' ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS core FROM events")
def apple_times(spark: SparkSession, sf: str) -> DataFrame:
    """Nanoseconds and seconds since 2001; negative ones and reals that are not positive are null."""
    s = F.unix_seconds(F.col("ts").cast("timestamp")) - 978_307_200
    ios = F.when(F.col("event_id") % 5 == 0, F.lit(-5).cast("long")).when(F.col("event_id") % 2 == 0, s * 1_000_000_000).otherwise(s)
    core = F.when(F.col("event_id") % 7 == 0, 0.0).otherwise(s.cast("double"))
    shown = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("null"))
    return table(spark, sf, "events").select("event_id", shown(sqlite.ios_time(ios)).alias("ios"), shown(sqlite.core_data_time(core)).alias("core"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 6 = 1 THEN 'taken-by-me' WHEN event_id % 6 = 2 THEN 'p' || event_id || '-0123456789abcdef' WHEN event_id % 6 = 3 THEN 'p' || event_id || '-' || left(lpad(lower(hex(CAST(@fnv@ AS UBIGINT))), 16, '0'), 8) ELSE 'p' || event_id END AS resolved FROM events""".replace("@fnv@", FNV.format("('/f/' || event_id)")))
def resolved_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Free ids, own ids, a stored suffix of another build, ids of another source, and owners without a source."""
    e = table(spark, sf, "events")
    p, src = F.concat(F.lit("p"), F.col("event_id").cast("string")), F.concat(F.lit("/f/"), F.col("event_id").cast("string"))
    m = F.col("event_id") % 6
    work = e.select(p.alias("id"), src.alias("source_path"), "event_id")
    own = lambda k, id, path: e.filter(m == k).select(id.alias("id"), path.alias("source_path"))
    owners = own(1, p, src).union(own(1, F.concat(p, F.lit("-0123456789abcdef")), src)).union(own(2, F.concat(p, F.lit("-0123456789abcdef")), src)).union(own(2, p, F.lit("/other"))).union(own(3, p, F.lit("/other"))).union(own(4, p, F.lit("")))
    out = archive.resolved_ids(work, owners)
    shown = F.when((m == 1) & (F.col("id") == p), "taken-by-me").otherwise(F.col("id"))
    return out.select(F.col("event_id").alias("id"), shown.alias("resolved"))


@query("SELECT count(*) FILTER (NOT replaced) AS kept, count(*) FILTER (replaced) AS superseded FROM (SELECT doc_id % 3 = 0 AND doc_id % 2 = 0 AS replaced FROM documents)")
def raw_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Every third document comes again, half of those with other content."""
    stored = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("content"))
    new = stored.filter("id % 3 = 0").withColumn("content", F.when(F.col("id") % 2 == 0, "new").otherwise(F.col("content")))
    current, old = archive.raw_versions(stored, new, "now")
    return current.agg(F.count_if(F.col("content") != "new").alias("kept")).crossJoin(old.agg(F.count("*").alias("superseded")))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'already_had' WHEN doc_id % 3 <> 0 THEN 'source_missing' WHEN doc_id % 4 = 1 THEN 'repaired' ELSE 'recovered' END AS status FROM documents")
def backfill_status(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 < 2, F.concat(F.lit("raw/"), F.col("doc_id").cast("string"))).otherwise("").alias("raw_path"))
    out = archive.backfill_status(s, s.filter("id % 3 = 0").select("id"), s.filter("id % 4 = 0").select("raw_path"))
    return out.select(F.col("id").alias("doc_id"), "status")


@query("SELECT (SELECT count(*) FROM documents WHERE source <> 'src1') AS left_over, (SELECT count(*) FROM documents WHERE source = 'src1') AS marked, (SELECT count(*) FROM documents WHERE source = 'src2') AS flagged")
def delete_and_set(spark: SparkSession, sf: str) -> DataFrame:
    """Deleting one source records a tombstone for each row first; a column is set for another source's rows."""
    index = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_jsonl"), F.lit("").alias("flag"))
    marks = spark.createDataFrame([], "id long, deleted_at string, source_path string")
    tombs, rest = archive.delete(index, index.filter("source_jsonl = 'src1'").select("id"), marks, "now")
    new = archive.set_column(rest, rest.filter("source_jsonl = 'src2'").select("id", F.lit("x").alias("flag")), "flag")
    return new.agg(F.count("*").alias("left_over"), F.count_if(F.col("flag") == "x").alias("flagged")).crossJoin(tombs.agg(F.count("*").alias("marked")))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'captured' ELSE 'new' END AS state FROM documents")
def captured_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """A source with another size or time counts as new."""
    found = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.octet_length("text").alias("size"), F.lit(5).alias("mtime_secs"))
    known = found.filter("id % 3 = 0").union(found.filter("id % 3 = 1").withColumn("mtime_secs", F.lit(6)))
    new = archive.not_captured(found, known).select("id", F.lit("new").alias("s"))
    return found.join(new, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("s", F.lit("captured")).alias("state"))


@query("SELECT doc_id, CAST(least(5, (length(text) - length(replace(text, 'tion', ''))) // 4) AS INTEGER) AS n_excerpts, CASE WHEN contains(text, 'tion') THEN right(left(text, instr(text, 'tion') - 1), 60) || '>>>tion<<<' END AS first_start FROM documents")
def redact_preview(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", archive.preview(F.col("text"), "tion").alias("p"))
    return d.select("doc_id", F.size("p").alias("n_excerpts"), F.concat(F.substring_index(F.get("p", F.lit(0)), "<<<", 1), F.lit("<<<")).alias("first_start"))


@query("SELECT doc_id, lower(regexp_replace(regexp_replace(lower(source || ' / ' || lang || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, regexp_replace(source || '/' || doc_id, '[^A-Za-z0-9_-]', '_', 'g') AS guid, CASE WHEN n_chars * 1000 < 1000000 THEN CAST(n_chars AS VARCHAR) || ' KB' ELSE 'more' END AS size FROM documents")
def slugs_and_sizes(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    size = T.human_size((F.col("n_chars") * 1000).cast("long"))
    return d.select("doc_id", T.slug(F.concat_ws(" / ", "source", F.concat("lang", F.lit("!")))).alias("slug"), T.sanitize_guid(F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("guid"), F.when(size.endswith("KB") | size.endswith(" B"), F.when(F.col("n_chars") == 0, "0 KB").otherwise(size)).otherwise("more").alias("size"))


@query(f"SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, md5(unhex(hex(encode(text))[1:2*n])) AS cut_md5 FROM (SELECT doc_id, text, {CUT} AS n FROM documents)")
def byte_cap(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", T.cap_bytes(F.col("text"), 1800).alias("cut"))
    return d.select("doc_id", F.octet_length("cut").cast("long").alias("n_bytes"), F.md5(F.col("cut").cast("binary")).alias("cut_md5"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey % 100, c_custkey) AS place FROM customer")
def natural_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Titles with numbers order as numbers do; the place is found by a range-partitioned sort."""
    from pyspark.sql import Window

    c = table(spark, sf, "customer").select("c_custkey", T.natural_key(F.concat(F.lit("Title "), (F.col("c_custkey") % 100).cast("string"))).alias("k"))
    groups = c.groupBy("k").agg(F.count("*").alias("n"))
    before = groups.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a hundred keys
    place = F.row_number().over(Window.partitionBy("k").orderBy("c_custkey"))
    return c.join(before.select("k", "before"), "k").select("c_custkey", (F.col("before") + place).alias("place"))


@query(f"WITH {SESSIONS} SELECT id FROM s WHERE (contains(lower(title), 'er') OR contains(lower(project), 'er') OR contains(lower(tool), 'er') OR contains(lower(provider), 'er') OR contains(lower(err), 'er') OR contains(lower(topic), 'er')) AND pos % 100 BETWEEN 10 AND 60")
def ui_filter(spark: SparkSession, sf: str) -> DataFrame:
    s = archive_sessions(spark, sf).withColumn("fill_pct", (F.col("_pos") % 100).cast("double"))
    return search.ui_filter(s, "ER", 10, 60).select("id")


HITS = "len(list_filter(range(1, length(line) + 1), lambda i: lower(line)[i:i+3] = 'anan'))"


@query(f"WITH {LINES}, h AS (SELECT session_id, {HITS} AS n FROM l) SELECT count(DISTINCT session_id) AS sessions, CAST(coalesce(sum(n), 0) AS BIGINT) AS hits, count(*) AS hit_lines, least(count(DISTINCT session_id), 200) AS returned FROM h WHERE n > 0")
def raw_totals(spark: SparkSession, sf: str) -> DataFrame:
    return search.raw_totals(raw_lines(spark, sf), "aNan")


@query("SELECT conv_id AS session_id, turn AS line_no, excerpt FROM (SELECT conv_id, turn, '{\"t\":\"say \\\"hi\\\"\",\"n\":' || turn || '}' AS excerpt, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 20")
def raw_excerpts_escaped(spark: SparkSession, sf: str) -> DataFrame:
    """A needle with quotes is found in its JSON form."""
    lines = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("line_no"), F.to_json(F.struct(F.lit('say "hi"').alias("t"), F.col("turn").alias("n"))).alias("line"))
    return search.raw_excerpts(lines, 'Say "HI"')


@query("SELECT event_id AS session_id, event_id || '.jsonl' AS title, strftime(ts, '%Y-%m-%d') AS date FROM events")
def unsummarised_titles(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("/a/b\\"), F.col("event_id").cast("string"), F.lit(".jsonl")).alias("source_path"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("mtime_secs"))
    return search.unsummarised(e)


@query(f"WITH {SESSIONS} SELECT id, CASE WHEN contains(lower(title), 'tion') THEN 8 ELSE 1 END AS score FROM s WHERE contains(lower(title), 'tion') OR (pos % 2 = 0 AND contains(lower(body), 'tion')) ORDER BY score DESC, date DESC, pos LIMIT 30")
def search_body_join(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies are a table of their own, which every second session has a row in."""
    s = archive_sessions(spark, sf).withColumn("archive_path", F.concat(F.lit("p/"), "id"))
    return search.ranked_page(s.drop("body"), search.SearchParams("tion", limit=30), s.filter("_pos % 2 = 0").select("archive_path", "body")).select("id", "score")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 2 = 0")
def embeddings_attach(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    found = e.select(F.col("vec_id").alias("session_id"))
    return semantic.attach(found, e.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), "label")).select(F.col("id").alias("vec_id"), "label")


@query("SELECT doc_id, md5('title: ' || source || ' | text: ' || trim(regexp_replace(lang || ' summary  of ' || doc_id, '\\s+', ' ', 'g'))) AS input_md5 FROM documents")
def embedding_inputs(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat(F.lit("head\n---\n\n"), "lang", F.lit(" summary\n of "), F.col("doc_id").cast("string"), F.lit("\n\n---\ntail"))
    return table(spark, sf, "documents").select("doc_id", F.md5(semantic.embedding_input(F.col("source"), body)).alias("input_md5"))


@query("SELECT vec_id AS session_id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS summary_hash FROM embeddings WHERE vec_id % 5 <> 0")
def embedding_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """New records for every third session; every fifth session is gone."""
    e = table(spark, sf, "embeddings")
    rows = lambda h, c: e.filter(c).select(F.col("vec_id").alias("session_id"), F.lit("m").alias("model_name"), F.lit(h).alias("summary_hash"), "embedding")
    return semantic.refreshed_store(rows("old", "true"), rows("new", "vec_id % 3 = 0"), e.filter("vec_id % 5 <> 0").select(F.col("vec_id").alias("id"))).select("session_id", "summary_hash")


@query("""WITH d AS (SELECT doc_id, length(text) AS a, length(text) - length(replace(text, 'e', '')) AS b, length(text) - length(replace(text, chr(10), '')) AS c FROM documents)
SELECT doc_id, CAST(a AS FLOAT) AS x, CAST(b AS FLOAT) AS y, CAST(c AS FLOAT) AS z, md5(text) AS summary_hash FROM d JOIN documents USING (doc_id)""")
def embed_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in batches of at most sixteen, of whole documents; the model counts characters, so each vector is known."""

    def model(texts: list[str]) -> list[list[float]]:
        if not 0 < len(texts) <= 16:
            raise ValueError("a batch has at most sixteen texts")
        return [[float(len(t)), float(t.count("e")), float(t.count("\n"))] for t in texts]

    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("session_id"), F.lit("m").alias("model_name"), F.md5("text").alias("summary_hash"), "text")
    out = semantic.embed(d, model)
    return out.select(F.col("session_id").cast("long").alias("doc_id"), *[F.col("embedding")[k].alias(c) for k, c in enumerate("xyz")], "summary_hash")


@query("SELECT label, avg(1) * 0 + count(*) AS n, model FROM (SELECT label, CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS model FROM embeddings) WHERE model = 'a' GROUP BY ALL".replace("avg(1) * 0 + ", ""))
def model_filter(spark: SparkSession, sf: str) -> DataFrame:
    from sessionlake.operators import sweep

    e = table(spark, sf, "embeddings").withColumn("model_name", F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b"))
    return sweep.model_store(e, "a").groupBy("label", F.col("model_name").alias("model")).agg(F.count("*").alias("n"))


def fact_answers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(answers, labels): twelve facts an answer, of which ten count; near-miss and unknown sections; labels in several forms, a whole id, and starts of one and of several ids."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("batch"))
    k = lambda x: x.cast("string")
    section = lambda x: F.when(x % 3 == 0, " Preferences").when(x % 3 == 1, "projects").otherwise("nothing")
    label = lambda x: F.when(x % 2 == 0, F.concat(F.lit("[s"), k(x + 1), F.lit("]"))).otherwise(F.concat(F.lit("Session "), k(x + 1)))
    fact = lambda x, b: F.struct(section(x).alias("section"), F.concat(F.lit(" fact "), k(b), F.lit("-"), k(x)).alias("fact"), F.array(F.when(x % 5 == 4, k(F.lit(100_000_000) + b * 10 + 7)), label(x), F.lit("S99"), F.lit("10000000")).alias("evidence"), F.lit("2024-01-01").alias("date"))
    answers = d.select("batch", F.to_json(F.struct(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda x: fact(x, F.col("batch"))).alias("facts"))).alias("answer"))
    labels = d.select("batch", F.explode(F.sequence(F.lit(1), F.lit(18))).alias("n")).select("batch", F.concat(F.lit("S"), k(F.col("n"))).alias("label"), (F.lit(100_000_000) + F.col("batch") * 10 + F.col("n") - 1).cast("string").alias("id"))
    return answers, labels


@query("""SELECT batch, fact_no, section, 'fact ' || batch || '-' || fact_no AS fact, CASE WHEN fact_no % 5 = 4 THEN CAST(100000000 + batch * 10 + 7 AS VARCHAR) || ',' ELSE '' END || CAST(100000000 + batch * 10 + fact_no AS VARCHAR) AS ids
FROM (SELECT doc_id AS batch, k AS fact_no, CASE WHEN k % 3 = 0 THEN 'conventions' ELSE 'projects' END AS section FROM documents, (SELECT unnest(range(0, 10)) AS k)) WHERE fact_no % 3 <> 2""")
def fact_validation(spark: SparkSession, sf: str) -> DataFrame:
    answers, labels = fact_answers(spark, sf)
    out = distill.validated_facts(distill.parsed_facts(answers), labels)
    return out.select("batch", F.col("fact_no").cast("long").alias("fact_no"), "section", "fact", F.array_join("evidence", ",").alias("ids"))


@query("""SELECT doc_id AS batch, warning, CAST(n AS BIGINT) AS n FROM documents, (VALUES ('skipped fact with unknown section nothing', 3), ('dropped unknown evidence S99', 7), ('dropped unknown evidence 10000000', 7)) AS w(warning, n)""")
def fact_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return distill.fact_warnings(*fact_answers(spark, sf)).groupBy("batch", "warning").agg(F.count("*").alias("n"))


@query("SELECT source AS section, md5(string_agg('- fact ' || doc_id || ' [id' || doc_id || ']', chr(10) ORDER BY doc_id % 28 DESC, 'fact ' || doc_id DESC)) AS text_md5 FROM documents GROUP BY 1")
def section_facts(spark: SparkSession, sf: str) -> DataFrame:
    id = F.col("doc_id").cast("string")
    facts = table(spark, sf, "documents").select(F.col("source").alias("section"), F.concat(F.lit("fact "), id).alias("fact"), F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")).alias("date"), F.array(F.concat(F.lit("id"), id)).alias("evidence"))
    return distill.section_text(facts).select("section", F.md5("text").alias("text_md5"))


@query("""WITH e AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, doc_id, text FROM documents)
SELECT (k - 1) // 18 AS batch, source, md5(string_agg('[S' || ((k - 1) % 18 + 1) || '] 2024-01-01 ' || lang || chr(10) || CASE WHEN length(text) <= 3000 THEN text ELSE left(text, 1200) || chr(10) || '[...snip...]' || chr(10) || right(text, 1800) END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY k)) AS block_md5
FROM e JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY ALL""")
def evidence_blocks(spark: SparkSession, sf: str) -> DataFrame:
    d = distill.batches(table(spark, sf, "documents"), [F.col("doc_id")], by="source")
    rows = d.select(F.struct("batch", "source").alias("batch"), "label", F.col("doc_id").alias("id"), distill.evidence_entry(F.col("label"), F.col("lang"), F.lit("2024-01-01"), F.col("text")).alias("entry"))
    return distill.evidence_blocks(rows).select("batch.batch", "batch.source", F.md5("block").alias("block_md5"))


@query("SELECT doc_id, least(900, greatest(300, CAST(round(length(text) / 4.0 * 0.18) AS INTEGER))) AS words FROM documents")
def word_targets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", distill.word_target(F.col("text")).alias("words"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || ',x' WHEN 1 THEN 'Tag,b' ELSE 'a1,b2,c3' END AS tags FROM documents")
def tag_splitting(spark: SparkSession, sf: str) -> DataFrame:
    """Tags that differ in case only, and evidence lists with several separators."""
    d, m = table(spark, sf, "documents"), F.col("doc_id") % 3
    tags = F.when(m == 0, F.array("lang", F.upper("lang"), F.lit("x"))).when(m == 1, F.array(F.lit("Tag"), F.lit("b"), F.lit("TAG"), F.lit("B")))
    return d.select("doc_id", F.array_join(F.coalesce(distill.dedupe_tags(tags), distill.split_evidence(F.lit(" a1, b2;b2  c3 a1"))), ",").alias("tags"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS n FROM documents")
def highlight_grounding(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("It FAILED, with code "), F.col("doc_id").cast("string"), F.lit("!"))
    items = F.array(F.concat(F.lit("failed with code "), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.lit(-7)).cast("string"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(" no")), F.lit("..."))
    return table(spark, sf, "documents").select("doc_id", F.size(distill.grounded_highlights(items, text)).alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'exploration' ELSE lang END AS session_type, source AS title FROM documents")
def summary_parse(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 1, F.col("lang")).when(F.col("doc_id") % 3 == 2, F.col("lang")).otherwise("")
    json = F.to_json(F.struct(F.col("source").alias("title"), F.lit("s").alias("summary"), kind.alias("session_type")))
    out = table(spark, sf, "documents").select("doc_id", distill.parsed_summary(json).alias("p"))
    return out.select("doc_id", "p.session_type", "p.title")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 7 ELSE strlen(text) // 4 END AS tokens, doc_id % 4 <> 0 AS estimated, CASE WHEN source = 'src1' THEN 1000 ELSE 200000 END AS context_size FROM documents")
def token_rules(spark: SparkSession, sf: str) -> DataFrame:
    tokens, estimated = sessions.token_count(F.when(F.col("doc_id") % 4 == 0, 7).cast("long"), F.octet_length("text"))
    return table(spark, sf, "documents").select("doc_id", tokens.cast("long").alias("tokens"), estimated.alias("estimated"), sessions.context_window(F.col("source"), {"src1": 1000}).alias("context_size"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '+49' || (1000000 + c_custkey) END AS intl, CASE WHEN c_custkey % 2 = 0 THEN CAST(1000000 + c_custkey AS VARCHAR) END AS national FROM customer")
def phone_forms(spark: SparkSession, sf: str) -> DataFrame:
    digits = F.concat(F.lit("49"), (F.col("c_custkey") + 1_000_000).cast("string"))
    raw = F.when(F.col("c_custkey") % 2 == 0, digits).otherwise("n/a")
    intl = phones.bare_international(raw)
    return table(spark, sf, "customer").select("c_custkey", intl.alias("intl"), phones.national_form(intl, "49").alias("national"))


@query("SELECT event_id, (k - 1) // 18 AS batch, 'S' || ((k - 1) % 18 + 1) AS label FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS k FROM events)")
def batch_all(spark: SparkSession, sf: str) -> DataFrame:
    """One sequence of all rows, numbered by ranges."""
    return distill.batches(table(spark, sf, "events").select("event_id", "ts"), [F.desc("ts"), F.col("event_id")]).select("event_id", "batch", "label")
