"""Quotation linking: from messages with quoted passages to reply-ordered conversations without quotes.

A message's lines are parsed by their number of leading `>` marks. Lines of level 0 are its own text; maximal runs of
lines of one deeper level are quoted passages; attribution lines before them go. Passages, their paragraphs and their
lines are normalised (case, white space, outer punctuation) and hashed. The own texts of all messages are hashed the
same way, and each hash keeps its earliest message of each conversation, and for other conversations those of the two
smallest only, as one of them is not the quoting one: the join has one row on that side for every key, so frequent
lines make no pairs.

A passage links to an earlier message of its conversation, else to a message of another one; whole passages before
paragraphs before lines. A message replies to the latest message that its level-1 passages link to, else to the turn
before it. Following replies gives each message the turn that its thread starts at and its depth; in the order of
(conv_id, root_turn, depth, turn) every reply comes after what it replies to; position is the place in that order, and
`assembled` writes conversations out in it, in parts of a bounded number of messages.

Every message is parsed once, and the result is kept for all steps.

Defined results: null text is an empty message; a passage with no words links to nothing; rows with an equal
conv_id and turn are one place in the thread and keep a row each; a null conv_id or turn has no thread
and is linked neither from nor to; an empty table gives an empty result; texts of any length are read whole; columns
other than conv_id, turn, role and text, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.session import ensure_checkpoint_dir, settled

QUOTE = re.compile(r"^(?:[ \t]*>)+[ \t]?")
ATTRIBUTION = re.compile(r"^(?:On|Am|Le|El) .{3,200}(?:wrote|schrieb|écrit|escribió)[^\n]{0,80}:$", re.IGNORECASE)
OUTER = " \t\n\r.,;:!?\"'“”„«»()[]-*_"
#: Shorter lines say too little to link by; whole passages may be shorter.
MIN_LINE = 16
BLOCK = 1000
WHOLE, PARAGRAPH, LINE = 0, 1, 2


def normalise(text: str) -> str:
    return " ".join(text.lower().split()).strip(OUTER)


def digests(text: str) -> list[tuple[int, str]]:
    """(kind, hash) of a passage as a whole, its paragraphs and its lines."""
    parts = [(WHOLE, text), *((PARAGRAPH, p) for p in re.split(r"\n[ \t]*\n", text)), *((LINE, x) for x in text.split("\n") if len(x) >= MIN_LINE)]
    found = {hashlib.sha256(n.encode()).hexdigest()[:32]: kind for kind, p in reversed(parts) if (n := normalise(p))}
    return [(kind, h) for h, kind in found.items()]


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(own text, [(level, passage)]) of a message."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in text.split("\n"):
        mark = QUOTE.match(line)
        level = mark.group().count(">") if mark else 0
        if level:
            body = line[mark.end() :]
            if level != last:
                if not last:
                    while own and not own[-1].strip():
                        own.pop()
                    if own and ATTRIBUTION.match(own[-1].strip()):
                        own.pop()
                passages.append((level, []))
            passages[-1][1].append(body)
        else:
            own.append(line)
        last = level
    return "\n".join(own).strip(), [(level, "\n".join(p).strip()) for level, p in passages]


PARSED = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n_passages", pa.int32()), ("hashes", pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("kind", pa.int32()), ("hash", pa.string())])))]
PARSED_SQL = "conv_id long, turn long, role string, text string, n_passages int, hashes array<struct<passage:int,level:int,kind:int,hash:string>>"


def parsed(messages: DataFrame) -> DataFrame:
    """Each message's own text, number of passages, and hashes: passage -1 and level 0 for its own text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, passages = parse(text or "")
                hashes = [(number, level, kind, h) for number, (level, p) in enumerate([(0, own), *passages], -1) for kind, h in digests(p)]
                rows.append((conv, turn, role, own, len(passages), [dict(zip(("passage", "level", "kind", "hash"), h, strict=True)) for h in hashes]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), PARSED, strict=True)], names=[n for n, _ in PARSED])

    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, PARSED_SQL)


def previous_turns(places: DataFrame) -> DataFrame:
    """places (conv_id, turn) with the turn before, by blocks of turns: no task orders a whole conversation."""
    blocked = places.withColumn("block", F.floor(F.col("turn") / BLOCK))
    within = Window.partitionBy("conv_id", "block").orderBy("turn")
    last = blocked.groupBy("conv_id", "block").agg(F.max("turn").alias("last"))
    before = last.withColumn("carried", F.lag("last").over(Window.partitionBy("conv_id").orderBy("block"))).drop("last")
    joined = blocked.withColumn("near", F.lag("turn").over(within)).join(before, ["conv_id", "block"])
    return joined.select("conv_id", "turn", F.coalesce("near", "carried").alias("previous"))


def link(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, passage, level, to_conv, to_turn, kind) of each quoted passage that a message is found for; messages: as parsed."""
    hashed = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode("hashes").alias("h")).select("conv_id", "turn", "h.*")
    own = hashed.filter("passage = -1")
    quoted = hashed.filter("passage >= 0")
    here = own.groupBy("conv_id", "hash").agg(F.min("turn").alias("to_turn"))
    # Spark keeps two rows of a hash in each task before it sends them
    number = F.row_number().over(Window.partitionBy("hash").orderBy("conv_id"))
    ends = here.withColumn("number", number).filter("number <= 2").groupBy("hash")
    place = F.struct("conv_id", F.col("to_turn").alias("turn"))
    there = ends.agg(F.min(place).alias("first"), F.max(place).alias("second"))
    near = quoted.join(here, ["conv_id", "hash"]).filter("to_turn < turn")
    near = near.select("conv_id", "turn", "passage", "level", F.struct(F.lit(0).alias("far"), "kind", F.col("conv_id").alias("c"), F.col("to_turn").alias("t")).alias("found"))
    other = F.expr("CASE WHEN first.conv_id <> conv_id THEN first ELSE second END")
    far = quoted.join(there, "hash").withColumn("other", other).filter("other.conv_id <> conv_id")
    far = far.select("conv_id", "turn", "passage", "level", F.struct(F.lit(1).alias("far"), "kind", F.col("other.conv_id").alias("c"), F.col("other.turn").alias("t")).alias("found"))
    best = near.union(far).groupBy("conv_id", "turn", "passage", "level").agg(F.min("found").alias("f"))
    return best.select("conv_id", "turn", "passage", "level", F.col("f.c").alias("to_conv"), F.col("f.t").alias("to_turn"), F.col("f.kind").alias("kind"))


def threads(places: DataFrame, links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, root_turn, depth), by pointer doubling: as many joins as the depth has binary digits.

    Each round moves only the messages that have not reached their root.
    """
    replied = links.filter("level = 1 AND to_conv = conv_id").groupBy("conv_id", "turn").agg(F.max("to_turn").alias("quoted"))
    parents = previous_turns(places).join(replied, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("quoted", "previous").alias("parent_turn"))
    root = F.col("parent_turn").isNull()
    state = settled(parents.select("conv_id", "turn", "parent_turn", F.coalesce("parent_turn", "turn").alias("up"), F.when(root, 0).otherwise(1).alias("depth"), root.alias("done")))
    while not state.filter("NOT done").isEmpty():
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("higher"), F.col("depth").alias("more"), F.col("done").alias("reached"))
        moved = state.filter("NOT done").join(above, ["conv_id", "up"])
        moved = moved.select("conv_id", "turn", "parent_turn", F.col("higher").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("reached").alias("done"))
        state = settled(state.filter("done").unionByName(moved))
    return state.select("conv_id", "turn", "parent_turn", F.col("up").alias("root_turn"), "depth")


def positions(threaded: DataFrame) -> DataFrame:
    """threaded (conv_id, turn, root_turn, depth, ...) with position, the place in the conversation by (root_turn, depth, turn).

    Places are counted in blocks of roots and of depths and added up, so no task orders a whole conversation.
    """
    keyed = threaded.withColumns({"_roots": F.floor(F.col("root_turn") / BLOCK), "_depths": F.floor(F.col("depth") / BLOCK)})
    before = lambda keys, order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = keyed.groupBy("conv_id", "_roots").agg(F.count("*").alias("n")).withColumn("_a", before(["conv_id"], ["_roots"])).drop("n")
    groups = keyed.groupBy("conv_id", "_roots", "root_turn", "_depths").agg(F.count("*").alias("n")).withColumn("_b", before(["conv_id", "_roots"], ["root_turn", "_depths"])).drop("n")
    place = F.row_number().over(Window.partitionBy("conv_id", "root_turn", "_depths").orderBy("depth", "turn"))
    numbered = keyed.withColumn("_c", place).join(groups, ["conv_id", "_roots", "root_turn", "_depths"]).join(blocks, ["conv_id", "_roots"])
    return numbered.withColumn("position", F.col("_a") + F.col("_b") + F.col("_c") - 1).select(*threaded.columns, "position")


def conversations(messages: DataFrame) -> DataFrame:
    """Every message with its own text, links and place in its thread.

    (conv_id, turn, role, text, parent_turn, root_turn, depth, position, n_passages, links); links is an array of (passage,
    level, to_conv, to_turn, kind) in order of passage.
    """
    ensure_checkpoint_dir(messages.sparkSession)
    rows = settled(parsed(messages))
    links = settled(link(rows))
    places = rows.select("conv_id", "turn").filter("conv_id IS NOT NULL AND turn IS NOT NULL").distinct()
    of_message = links.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_set(F.struct("passage", "level", "to_conv", "to_turn", "kind"))).alias("links"))
    joined = rows.drop("hashes").join(positions(threads(places, links)), ["conv_id", "turn"], "left").join(of_message, ["conv_id", "turn"], "left")
    return joined.select("conv_id", "turn", "role", "text", "parent_turn", "root_turn", "depth", "position", "n_passages", "links")


def assembled(messages: DataFrame, part: int = 500) -> DataFrame:
    """(conv_id, part, n_messages, conversation): conversations without quotes in reply order, `part` places to a row.

    conversation: (turn, parent_turn, role, text) of each message with a text of its own; messages that only quote go.
    """
    rows = conversations(messages).filter("position IS NOT NULL AND text <> ''")
    message = F.struct("position", "turn", "parent_turn", "role", "text")
    grouped = rows.groupBy("conv_id", F.floor(F.col("position") / part).alias("part")).agg(F.sort_array(F.collect_list(message)).alias("m"))
    named = F.transform("m", lambda x: F.struct(x["turn"].alias("turn"), x["parent_turn"].alias("parent_turn"), x["role"].alias("role"), x["text"].alias("text")))
    return grouped.select("conv_id", "part", F.size("m").cast("long").alias("n_messages"), named.alias("conversation"))
