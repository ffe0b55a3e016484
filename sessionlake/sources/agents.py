"""Readers of coding-agent logs (JSON lines): fill, tokens and rendered units of each file.

`lines` gives (path, line_no, line); a log file is one session, read by as many tasks as its size asks for. Unreadable
lines are skipped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.functions import text as T
from sessionlake.operators.sessions import AGENT_OVERHEAD, CONTEXT_DEFAULT, last_by
from sessionlake.sources import log_lines

MAX_DEPTH = 12


def lines(spark: SparkSession, path: str, modified_after: float | None = None, split_bytes: int = log_lines.SPLIT_BYTES) -> DataFrame:
    """(path, mtime, line_no, line) of the .jsonl files in at most 12 folders below one, changed after a time (seconds) if one is given."""
    rows = log_lines.read(spark, path, max_depth=MAX_DEPTH, split_bytes=split_bytes, **({"modified_after": modified_after} if modified_after is not None else {}))
    return rows.filter("trim(line) <> ''")


def number(path: str) -> Column:
    return F.get_json_object("line", path).try_cast("long")


def clamp(c: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), c)))  # least and greatest pass over nulls


def agent_fill(rows: DataFrame, windows: dict[str, int] | None = None) -> DataFrame:
    """(path, fill_pct) by the last line that names a model: its tokens and a fixed overhead over the model's context."""
    model = F.nullif(F.get_json_object("line", "$.message.model"), F.lit(""))
    size = F.coalesce(F.create_map(*[F.lit(x) for kv in windows.items() for x in kv])[model] if windows else F.lit(None).cast("int"), F.lit(CONTEXT_DEFAULT))
    used = sum((F.coalesce(number(f"$.message.usage.{k}"), F.lit(0)) for k in ("input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens")), F.lit(AGENT_OVERHEAD))
    return rows.groupBy("path").agg(last_by(F.when(model.isNotNull(), clamp(used / size * 100)), "line_no").alias("fill_pct")).filter("fill_pct IS NOT NULL")


def codex_fill(rows: DataFrame) -> DataFrame:
    """(path, fill_pct) by the last token count; files without one go."""
    is_count = F.get_json_object("line", "$.payload.type") == "token_count"
    pct = number("$.payload.info.last_token_usage.input_tokens") / number("$.payload.info.model_context_window") * 100
    return rows.groupBy("path").agg(last_by(F.when(is_count, clamp(pct)), "line_no").alias("fill_pct")).filter("fill_pct IS NOT NULL")


def forge_fill(rows: DataFrame) -> DataFrame:
    """(path, fill_pct), the most that a compaction saw; null where there was none."""
    used = F.when(F.get_json_object("line", "$.type") == "compaction", number("$.used_tokens") / number("$.max_tokens") * 100)
    return rows.groupBy("path").agg(F.max(clamp(used)).alias("fill_pct"))


def gated(fills: DataFrame, least: float, unknown_passes: bool = False) -> DataFrame:
    passes = F.col("fill_pct") >= least
    return fills.filter(passes | F.col("fill_pct").isNull() if unknown_passes else passes)


def with_estimate(rows: DataFrame, reported: Column, generated: Column) -> DataFrame:
    """(path, output_tokens, tokens_estimated): the reported number, else a quarter of the bytes that the model wrote."""
    grouped = rows.groupBy("path").agg(reported.alias("r"), F.floor(F.sum(F.coalesce(generated, F.lit(0))) / 4).alias("e"))
    return grouped.select("path", F.coalesce("r", "e").alias("output_tokens"), F.col("r").isNull().alias("tokens_estimated"))


def text_at(value: str | Column, path: str) -> Column:
    """The string at a path of a variant; null if something else is there."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))


def written(value: Column) -> Column:
    """Bytes of a tool's arguments as the model wrote them: of a string its own, of anything else its JSON's."""
    kind = F.schema_of_variant(value)
    size = F.when(kind == "STRING", F.octet_length(F.try_variant_get(value, "$", "string"))).when(kind != "VOID", F.octet_length(F.to_json(value)))
    return F.coalesce(size, F.lit(0))


def size_of(c: Column) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0))


def summed(items: Column, size: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.coalesce(items, F.array().cast("array<variant>")), F.lit(0), lambda n, x: n + size(x))


def agent_tokens(rows: DataFrame) -> DataFrame:
    """The sum of what the assistant's turns report, else by its texts, thoughts and tool arguments."""
    v = rows.withColumn("v", F.try_parse_json("line"))
    items = F.try_variant_get("v", "$.message.content", "array<variant>")
    made = summed(items, lambda x: size_of(text_at(x, "$.text")) + size_of(text_at(x, "$.thinking")) + written(F.try_variant_get(x, "$.input", "variant")))
    own = text_at("v", "$.message.role") == "assistant"
    return with_estimate(v, F.sum(F.when(own, number("$.message.usage.output_tokens"))), F.when(own, made))


def codex_tokens(rows: DataFrame) -> DataFrame:
    """The last cumulative total, else the sum of turns that have none, else by messages and tool arguments."""
    total, turn = number("$.payload.info.total_token_usage.output_tokens"), number("$.payload.info.last_token_usage.output_tokens")
    v = rows.withColumn("v", F.try_parse_json("line"))
    kind = text_at("v", "$.payload.type")
    argument = F.coalesce(F.try_variant_get("v", "$.payload.arguments", "variant"), F.try_variant_get("v", "$.payload.input", "variant"))
    said = F.coalesce(text_at("v", "$.payload.text"), text_at("v", "$.payload.message"))
    made = F.when(kind.isin("assistant_message", "response_output_text"), size_of(said)).when(kind.isin("tool_call", "function_call"), written(argument))
    return with_estimate(v, F.coalesce(last_by(total, "line_no"), F.sum(F.when(total.isNull(), turn))), made)


def forge_tokens(rows: DataFrame) -> DataFrame:
    """The largest running total, else by the assistant's texts, thoughts and tool arguments."""
    v = rows.withColumn("v", F.try_parse_json("line"))
    calls = summed(F.try_variant_get("v", "$.tool_calls", "array<variant>"), lambda x: written(F.try_variant_get(x, "$.input", "variant")))
    made = F.when(text_at("v", "$.role") == "assistant", size_of(text_at("v", "$.content")) + size_of(text_at("v", "$.reasoning")) + calls)
    return with_estimate(v, F.max(F.when(F.get_json_object("line", "$.type") == "usage", number("$.output_tokens"))), made)


#: The most characters of a text, of a tool's detail and of a thought; the forms of the units below are fixed too.
TEXT_CHARS, DETAIL_CHARS, THOUGHT_CHARS = 2000, 160, 500
READS, EDITS = ["Read", "NotebookRead"], ["Edit", "MultiEdit", "str_replace_based_edit", "NotebookEdit"]
CODEX_MARKER = "## My request for Codex:\n"
CODEX_DETAILS, FORGE_DETAILS = ["command", "file_path", "pattern"], ["path", "command", "query", "pattern", "search_term", "target_directory"]


def white_trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(T.WHITE_SPACE))


def content_text(value: Column) -> Column:
    """A result's text: a string, or the text blocks of an array, a line each."""
    blocks = F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda x: text_at(x, "$.type") == "text")
    return F.coalesce(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")), F.array_join(F.transform(blocks, lambda x: F.coalesce(text_at(x, "$.text"), F.lit(""))), "\n"), F.lit(""))


def content_blocks(rows: DataFrame) -> DataFrame:
    """One row (path, line_no, item_no, role, v) for each block of a message's content; content that is no array has none."""
    v = rows.select("path", "line_no", F.try_parse_json("line").alias("m"))
    role = text_at("m", "$.message.role")
    each = v.select("path", "line_no", role.alias("role"), F.posexplode(F.try_variant_get("m", "$.message.content", "array<variant>")).alias("item_no", "v"))
    return each.filter("role <> 'system'")


def file_of(use: Column) -> Column:
    return F.coalesce(text_at(use, "$.file_path"), F.lit("?"))


def read_of(use: Column) -> Column:
    return F.coalesce(text_at(use, "$.file_path"), text_at(use, "$.notebook_path"), F.lit("?"))


def use_label(name: Column, args: Column) -> Column:
    """[Read: path], [Bash: command] and the like; any other tool by its name."""
    named = lambda kind, v: F.concat(F.lit(f"[{kind}: "), v, F.lit("]"))
    pattern = F.coalesce(text_at(args, "$.pattern"), F.lit("?"))
    return (
        F.when(name.isin(READS), named("Read", read_of(args)))
        .when(name == "Write", named("Write", file_of(args)))
        .when(name.isin(EDITS), named("Edit", file_of(args)))
        .when(name == "Bash", named("Bash", T.truncate_chars(F.coalesce(text_at(args, "$.command"), F.lit("")), 80)))
        .when(name == "Glob", named("Glob", pattern))
        .when(name == "Grep", named("Grep", pattern))
        .otherwise(named("Tool", name))
    )


def result_label(name: Column, args: Column, text: Column, error: Column) -> Column:
    """What came of a tool's use: of a read its lines, of a command its first and last five, of others the text or its size."""
    begin = F.when(error, "[Error").otherwise("[Result")
    told = lambda *parts: F.concat(begin, *parts)
    return (
        F.when(name.isin(READS), told(F.lit(": "), read_of(args), F.lit(" ("), F.size(T.text_lines(text)).cast("string"), F.lit(" lines)]")))
        .when(name == "Bash", told(F.lit(": bash]\n"), T.head_tail_lines(text, 5, 5)))
        .when(name == "Write", told(F.lit(": wrote "), file_of(args), F.lit("]")))
        .when(name.isin(EDITS), told(F.lit(": edited "), file_of(args), F.lit("]")))
        .when(F.octet_length(text) <= 500, told(F.lit(": "), text, F.lit("]")))
        .otherwise(told(F.lit(": "), F.octet_length(text).cast("string"), F.lit(" chars]")))
    )


def agent_units(rows: DataFrame) -> DataFrame:
    """(path, line_no, item_no, unit), a unit for each message: its texts, tool uses and results, a line or more each.

    A result is labelled by the tool that was last registered for its id, on its own line or before.
    """
    blocks = content_blocks(rows).withColumns({"kind": text_at("v", "$.type"), "error": F.coalesce(F.try_variant_get("v", "$.is_error", "boolean"), F.lit(False))})
    uses = blocks.filter("kind = 'tool_use'").select("path", F.col("line_no").alias("on"), text_at("v", "$.id").alias("id"), text_at("v", "$.name").alias("used"), F.try_variant_get("v", "$.input", "variant").alias("with"), F.struct("line_no", "item_no").alias("at"))
    results = blocks.filter("kind = 'tool_result'").withColumn("id", text_at("v", "$.tool_use_id"))
    known = results.join(uses.filter("id IS NOT NULL AND used IS NOT NULL"), ["path", "id"], "left").filter("at IS NULL OR on <= line_no")
    latest = known.withColumn("k", F.row_number().over(Window.partitionBy("path", "line_no", "item_no").orderBy(F.desc_nulls_last("at")))).filter("k = 1").select("path", "line_no", "item_no", "used", "with")
    joined = blocks.join(latest, ["path", "line_no", "item_no"], "left")
    text = F.nullif(white_trimmed(F.coalesce(text_at("v", "$.text"), F.lit(""))), F.lit(""))
    part = (
        F.when(F.col("kind") == "text", T.truncate_chars(text, TEXT_CHARS))
        .when(F.col("kind") == "tool_use", use_label(F.coalesce(text_at("v", "$.name"), F.lit("?")), F.try_variant_get("v", "$.input", "variant")))
        .when(F.col("kind") == "tool_result", result_label(F.coalesce("used", F.lit("unknown")), F.col("with"), content_text(F.try_variant_get("v", "$.content", "variant")), F.col("error")))
    )
    turns = joined.withColumn("part", part).filter("part IS NOT NULL").groupBy("path", "line_no", "role").agg(F.sort_array(F.collect_list(F.struct("item_no", "part"))).alias("parts"))
    label = F.when(F.col("role") == "user", "[User]\n").otherwise("[Assistant]\n")
    return turns.select("path", "line_no", F.lit(0).alias("item_no"), F.concat(label, F.array_join(F.transform("parts", lambda x: x["part"]), "\n")).alias("unit"))


def detailed(name: Column, args: Column, fields: list[str]) -> Column:
    """[Tool: name], and the first of some arguments that is a text."""
    detail = F.coalesce(*[F.nullif(white_trimmed(text_at(args, f"$.{f}")), F.lit("")) for f in fields])
    return F.concat(F.lit("[Tool: "), F.coalesce(name, F.lit("?")), F.lit("]"), F.coalesce(F.concat(F.lit(" "), T.truncate_chars(detail, DETAIL_CHARS)), F.lit("")))


def codex_units(rows: DataFrame) -> DataFrame:
    """(path, line_no, item_no, unit): messages, of the user's what follows the marker of a request; tool calls and results."""
    v = rows.select("path", "line_no", F.try_parse_json("line").alias("v")).filter(text_at("v", "$.type") == "event_msg")
    p = lambda k: text_at("v", f"$.payload.{k}")
    message = p("message")
    asked = F.when(message.contains(CODEX_MARKER), F.substr(message, F.instr(message, CODEX_MARKER) + len(CODEX_MARKER))).otherwise(message)
    said = lambda label, c: F.concat(F.lit(f"{label}\n"), T.truncate_chars(F.nullif(white_trimmed(c), F.lit("")), TEXT_CHARS))
    kind, output = p("type"), F.nullif(F.coalesce(p("output"), p("text")), F.lit(""))
    unit = (
        F.when(kind == "user_message", said("[User]", asked))
        .when(kind.isin("assistant_message", "response_output_text"), said("[Assistant]", F.coalesce(p("text"), message)))
        .when(kind.isin("tool_call", "function_call"), detailed(p("name"), F.try_variant_get("v", "$.payload.arguments", "variant"), CODEX_DETAILS))
        .when(kind.isin("tool_output", "function_output"), F.concat(F.lit("[Tool result]\n"), T.head_tail_lines(output, 10, 10)))
    )
    return v.select("path", "line_no", F.lit(0).alias("item_no"), unit.alias("unit")).filter("unit IS NOT NULL")


def forge_units(rows: DataFrame) -> DataFrame:
    """(path, line_no, item_no, unit): a message's tool calls, or its text and then its thought."""
    v = rows.select("path", "line_no", F.try_parse_json("line").alias("v"))
    role = text_at("v", "$.role")
    calls = F.transform(F.try_variant_get("v", "$.tool_calls", "array<variant>"), lambda c: detailed(text_at(c, "$.name"), F.try_variant_get(c, "$.input", "variant"), FORGE_DETAILS))
    filled = lambda c: F.nullif(white_trimmed(c), F.lit(""))
    said = F.concat(F.when(role == "user", "[User]\n").otherwise("[Assistant]\n"), T.truncate_chars(filled(text_at("v", "$.content")), TEXT_CHARS))
    thought = F.when(said.isNotNull(), F.concat(F.lit("[Thinking]\n"), T.truncate_chars(filled(text_at("v", "$.reasoning")), THOUGHT_CHARS)))
    return v.filter(role.isin("user", "assistant")).select("path", "line_no", F.posexplode(F.coalesce(calls, F.array_compact(F.array(said, thought)))).alias("item_no", "unit"))


def session_units(units: DataFrame) -> DataFrame:
    """(path, units): a file's units in order, the unit of storage of one session."""
    m = F.sort_array(F.collect_list(F.struct("line_no", "item_no", "unit")))
    return units.groupBy("path").agg(m.alias("m")).select("path", F.transform("m", lambda x: x["unit"]).alias("units"))


def rendered(units: DataFrame) -> DataFrame:
    """(path, transcript): a file's units in order, joined by line ends."""
    return session_units(units).select("path", F.array_join("units", "\n").alias("transcript"))


def labels(rows: DataFrame) -> DataFrame:
    """(path, project): the folder below `projects`, else the working folder or workspace in the first eight lines, else null."""
    head = F.when(F.col("line_no") < 8, F.coalesce(T.last_path_part(F.get_json_object("line", "$.payload.cwd")), F.get_json_object("line", "$.workspace_name")))
    below = F.nullif(F.regexp_extract("path", r"/projects/([^/]+)/", 1), F.lit(""))
    return rows.groupBy("path").agg(F.min_by(head, F.when(head.isNotNull(), F.col("line_no"))).alias("h")).select("path", F.coalesce(below, "h").alias("project"))
