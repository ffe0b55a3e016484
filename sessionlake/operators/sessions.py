"""From messages to sessions: gap windows, assembly, rendering, token and fill estimates, low-signal rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions import text as T
from sessionlake.session import ensure_checkpoint_dir, settled

WINDOW_DAYS, WINDOW_MESSAGES, MIN_MESSAGES = 30, 400, 3
ROLE_LABELS = {"user": "[User]", "assistant": "[Assistant]", "system": "[System]"}
#: Context sizes by model, and that of an unknown model; tokens that a coding agent always carries.
CONTEXT_DEFAULT, AGENT_OVERHEAD = 200_000, 33_000


#: Rows of a key above which it is cut into blocks of time, and the number of blocks. Any values give the same windows.
BLOCK_ROWS, BLOCKS = 200_000, 64


def time_blocks(rows: DataFrame, key: str, ts: str, block_rows: int, blocks: int) -> DataFrame:
    """rows with _block, from 0 in order of time within a key: keys of many rows are cut at quantiles of their times.

    Rows of one key and time are in one block. The quantiles are settled, so a task that runs again cuts alike.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    large = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block_rows).select(F.col(key).alias("_key"))
    quantiles = F.percentile_approx(F.col(ts), [k / blocks for k in range(1, blocks)], 10_000)
    cuts = rows.join(large, F.col(key).eqNullSafe(F.col("_key")), "left_semi").groupBy(F.col(key).alias("_key")).agg(F.array_distinct(quantiles).alias("_cuts"))
    dealt = rows.join(settled(cuts), F.col(key).eqNullSafe(F.col("_key")), "left")
    block = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(ts))), F.lit(0))
    return dealt.withColumn("_block", F.when(F.col("_cuts").isNull(), 0).otherwise(block)).drop("_key", "_cuts")


def gap_windows(
    rows: DataFrame, key: str, ts: str, tie: str, gap: str = f"{WINDOW_DAYS} days", cap: int | None = WINDOW_MESSAGES, block_rows: int = BLOCK_ROWS, blocks: int = BLOCKS
) -> DataFrame:
    """rows with island (a new one after a longer gap), chunk (at most `cap` rows) and place in the chunk, all from 0.

    A segmented scan: no task needs a whole key. A block of a key's time tells its first and last time, how often an
    island begins within it, and its rows and those after its last break. These summaries, one row a block, are combined
    along the key: islands before a block, and how many rows the island that is open at its begin has had. Rows are then
    numbered within their blocks. Rows without a time come first and break nothing; a null key is a key.
    """
    cut = time_blocks(rows, key, ts, block_rows, blocks)
    order = Window.partitionBy(key, "_block").orderBy(ts, tie)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    longer = lambda a, b: F.coalesce(a > b + F.expr(f"INTERVAL {gap}"), F.lit(False))
    marked = cut.withColumn("_new", longer(F.col(ts), F.lag(ts).over(order)).cast("long"))
    marked = marked.withColumns({"_islands": F.sum("_new").over(so_far), "_row": F.row_number().over(order)})
    marked = marked.withColumn("_begin", F.max(F.when(F.col("_new") == 1, F.col("_row"))).over(so_far))
    # a block's summary; its rows from the last break on are its tail
    summary = marked.groupBy(F.col(key).alias("_k"), F.col("_block").alias("_b")).agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.max("_islands").alias("breaks"), F.count(F.lit(1)).alias("n"), F.max("_begin").alias("last_break")
    )
    along = Window.partitionBy("_k").orderBy("_b")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    fresh = longer(F.col("first"), F.last("last", True).over(before))
    summary = summary.withColumn("fresh", fresh.cast("long"))
    summary = summary.withColumn("reset", F.sum(F.when((F.col("fresh") == 1) | (F.col("breaks") > 0), 1).otherwise(0)).over(along))
    tail = F.when(F.col("breaks") > 0, F.col("n") - F.col("last_break") + 1).otherwise(F.col("n"))
    open_rows = F.sum(tail).over(Window.partitionBy("_k", "reset").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    summary = summary.withColumn("open_rows", open_rows).withColumn("carried", F.when(F.col("fresh") == 1, 0).otherwise(F.coalesce(F.lag("open_rows").over(along), F.lit(0))))
    summary = summary.withColumn("base", F.col("fresh") + F.coalesce(F.sum(F.col("breaks") + F.col("fresh")).over(before), F.lit(0)))
    joined = marked.join(summary.select("_k", "_b", "base", "carried"), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")))
    place = F.when(F.col("_begin").isNull(), F.col("_row") - 1 + F.col("carried")).otherwise(F.col("_row") - F.col("_begin"))
    size = cap or 2**31 - 1
    placed = joined.withColumns({"island": F.col("base") + F.col("_islands"), "_place": place})
    placed = placed.withColumns({"chunk": F.floor(F.col("_place") / size), "place": F.col("_place") % size})
    return placed.select(*rows.columns, "island", "chunk", "place")


def assemble(messages: DataFrame, key: str, turn: str = "turn") -> DataFrame:
    """One row for each session: messages in order, counts, transcript and its hash; sessions without text go.

    Messages are collected by session, the unit that the archive stores as one body.
    """
    full = F.trim(F.coalesce("text", F.lit("")))
    m = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), "role", full.alias("text"))))
    grouped = messages.groupBy(key).agg(m.alias("m"), F.count("*").alias("n_messages"))
    some = F.filter("m", lambda x: x["text"] != "")
    label = F.create_map(*[F.lit(x) for kv in ROLE_LABELS.items() for x in kv])
    transcript = F.array_join(F.transform(some, lambda x: F.concat(F.coalesce(label[x["role"]], F.concat(F.lit("["), x["role"], F.lit("]"))), F.lit("\n"), x["text"])), "\n\n")
    assistant = F.filter(some, lambda x: x["role"] == "assistant")
    n_bytes = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.octet_length(x["text"]))
    return grouped.filter(F.size(some) > 0).select(
        key,
        "n_messages",
        transcript.alias("transcript"),
        F.sha2(F.array_join(F.transform(some, lambda x: x["text"]), "\n"), 256).alias("transcript_hash"),
        F.floor(n_bytes(assistant) / 4).cast("long").alias("output_tokens"),
        n_bytes(some).cast("long").alias("n_bytes"),
    )


def token_count(reported: Column, n_bytes: Column) -> tuple[Column, Column]:
    """(tokens, estimated): a reported 0 is measured."""
    return F.coalesce(reported, F.floor(n_bytes / 4)), reported.isNull()


def context_window(model: Column, curves: dict[str, int]) -> Column:
    known = F.create_map(*[F.lit(x) for kv in curves.items() for x in kv]) if curves else None
    return F.coalesce(known[model], F.lit(CONTEXT_DEFAULT)) if curves else F.lit(CONTEXT_DEFAULT)


def last_by(value: str | Column, order: str | Column) -> Column:
    """The value of the last row that has one."""
    v = F.col(value) if isinstance(value, str) else value
    return F.max_by(v, F.when(v.isNotNull(), F.col(order) if isinstance(order, str) else order))


def low_signal(messages: DataFrame, key: str) -> DataFrame:
    """Keys with fewer than three messages, or none by the owner (role assistant)."""
    counted = messages.groupBy(key).agg(F.count("*").alias("n_messages"), F.count_if(F.col("role") == "assistant").alias("n_owner"))
    return counted.filter(f"n_messages < {MIN_MESSAGES} OR n_owner = 0")


def transcript_units(c: Column) -> Column:
    return F.filter(F.split(c, "\n\n"), lambda x: F.trim(x) != "")


def project_label(path: Column) -> Column:
    """The folder below `projects` on a path."""
    return F.nullif(F.regexp_extract(path, r"[/\\]projects[/\\]([^/\\]+)[/\\]", 1), F.lit(""))


def estimated(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumns({"tokens": T.estimated_tokens(F.col(text)).cast("long"), "fill_pct": T.fill_percent(F.octet_length(text))})
