"""From phone messages to sessions: windows joined to their conversations, speakers, raw slices and the session table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions import text as T
from sessionlake.operators.sessions import WINDOW_DAYS, WINDOW_MESSAGES, gap_windows


def attachment_lines(attachments: Column, largest: str = "GB") -> Column:
    """A line for each attachment: its name, kind and decimal size in units up to `largest` (the form is a fixed value)."""
    parts = lambda a: [F.coalesce(a["transfer_name"], F.lit("unnamed")), F.coalesce(a["mime_type"], F.lit("unknown")), F.coalesce(T.human_size(a["total_bytes"], largest), F.lit("unknown"))]
    return F.array_join(F.transform(attachments, lambda a: F.concat(F.lit("[attachment: "), F.concat_ws(" · ", *parts(a)), F.lit("]"))), "\n")


def speaker(from_me: Column, sender: Column, members: Column, chat_name: Column) -> Column:
    """Me; the sender or a chat's only member; else the chat's name, and Unknown in a group or without one."""
    only = F.when(F.size(members) == 1, members[0])
    named = F.when(F.coalesce(F.size(members), F.lit(0)) <= 1, F.nullif(F.trim(chat_name), F.lit("")))
    return F.when(from_me, "Me").otherwise(F.coalesce(F.trim(F.coalesce(sender, only)), named, F.lit("Unknown")))


def conversation_org(members: Column, org: Column) -> Column:
    """The project of a conversation: its one member's organisation; a group has none."""
    return F.when(F.coalesce(F.size(members), F.lit(0)) <= 1, F.nullif(F.trim(org), F.lit("")))


def with_attachments(text: Column, attachments: Column, largest: str = "GB") -> Column:
    """A message's text, and below it a line for each attachment: a message of attachments only has those."""
    lines = F.coalesce(attachment_lines(attachments, largest), F.lit(""))
    return F.array_join(F.filter(F.array(F.coalesce(text, F.lit("")), lines), lambda t: t != ""), "\n")


def windowed(messages: DataFrame, conversations: DataFrame, gap: str = f"{WINDOW_DAYS} days", cap: int = WINDOW_MESSAGES, largest: str = "GB") -> DataFrame:
    """messages (chat_id, guid, ts, ...) with window numbers, joined to their conversations (chat_id, ...).

    window: a new one after a longer gap or `cap` messages; it names the window within this table only, as earlier
    messages that arrive later move the numbers. Messages may have attachments (array of structs), which become text with
    sizes in units up to `largest`.
    """
    if "attachments" in messages.columns:
        messages = messages.withColumn("text", with_attachments(F.col("text"), F.col("attachments"), largest))
    rows = gap_windows(messages, "chat_id", "ts", "guid", gap, cap)
    # chunks restart in each island, so a window is the pair of them
    return rows.withColumn("window", F.concat_ws("-", "island", "chunk")).join(conversations, "chat_id")


def phone_sessions(windows: DataFrame, provider: str) -> DataFrame:
    """One session for each window with a text (chat_id, window, guid, ts, text, from_me, speaker, title, org).

    Its id is the provider and the guid of the window's first message: earlier messages that arrive later and begin a
    window of their own change no other id. The owner's messages are the assistant's. Windows are bounded, so a session's
    messages fit one row.
    """
    full = F.trim(F.coalesce("text", F.lit("")))
    m = F.sort_array(F.collect_list(F.struct("ts", "guid", full.alias("text"), "from_me", "speaker")))
    grouped = windows.groupBy("chat_id", "window").agg(m.alias("m"), F.first("title").alias("title"), F.first("org").alias("project"))
    some = F.filter("m", lambda x: x["text"] != "")
    label = lambda x: F.concat(F.when(x["from_me"], "[Assistant]").otherwise("[User]"), F.lit("\n"), x["text"])
    rows = grouped.filter(F.size(some) > 0)
    return rows.select(
        F.concat_ws("-", F.lit(provider), T.sanitize_guid(F.col("m")[0]["guid"].cast("string"))).alias("id"),
        "title",
        "project",
        F.col("m")[0]["ts"].alias("created_at"),
        F.element_at("m", -1)["ts"].alias("updated_at"),
        F.size(some).cast("long").alias("n_messages"),
        F.size(F.filter(some, lambda x: x["from_me"])).cast("long").alias("n_owner"),
        F.array_distinct(F.transform(some, lambda x: x["speaker"])).alias("participants"),
        F.array_join(F.transform(some, label), "\n\n").alias("transcript"),
        T.fill_percent(F.octet_length(F.array_join(F.transform(some, lambda x: x["text"]), "\n"))).alias("fill_pct"),
    )


def raw_slices(windows: DataFrame, service: str, backup: str) -> DataFrame:
    """(chat_id, window, content): a header of the conversation and window, then a block for each message, in the session's time zone.

    The lines of the header and the form of a block are fixed values; of more than four participants the rest is a number.
    """
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    block = lambda x: F.concat(F.lit("["), F.date_format(x["ts"], "yyyy-MM-dd HH:mm:ss"), F.lit("] "), x["speaker"], F.when(F.trim(x["text"]) != "", F.concat(F.lit("\n"), x["text"])).otherwise(""))
    m = F.sort_array(F.collect_list(F.struct("ts", "guid", F.coalesce("text", F.lit("")).alias("text"), "speaker")))
    rows = windows.groupBy("chat_id", "window").agg(m.alias("m"), F.first("title").alias("title"), F.first("org").alias("org"))
    people = F.array_sort(F.array_distinct(F.transform("m", lambda x: x["speaker"])))
    head = F.concat(F.lit("# Messages - "), "title", F.when(F.col("org").isNotNull(), F.concat(F.lit(" - "), "org")).otherwise(""))
    more = F.when(F.size(people) > 4, F.concat(F.lit(", +"), (F.size(people) - 4).cast("string"))).otherwise("")
    about = F.concat(F.lit("# chat: "), F.col("chat_id").cast("string"), F.lit(f" / service: {service} / participants: "), F.array_join(F.slice(people, 1, 4), ", "), more)
    when = F.concat(F.lit("# window: "), day(F.col("m")[0]["ts"]), F.lit(" to "), day(F.element_at("m", -1)["ts"]), F.lit(" / "), F.size("m").cast("string"), F.lit(f" messages / backup: {backup}"))
    content = F.concat(F.array_join(F.array(head, about, when), "\n"), F.lit("\n\n"), F.array_join(F.transform("m", block), "\n\n"))
    return rows.select("chat_id", "window", content.alias("content"))
