"""Search over a session table: structured filters, ranked and full-text keyword search, literal search of raw lines.

Sessions have the columns of schema.SESSION and `_pos`, their place in the index, the last tie-breaker of every order.
Bodies are joined only where a query word is not decided by the metadata.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions import text as T

TITLE, TOPIC, ERROR, BODY = 8, 4, 3, 1
PAGE_DEFAULT, PAGE_MAX = 20, 30
GROUP_CAP, EXCERPT_CAP, EXCERPT_CHARS = 200, 20, 200
#: Tool filters that stand for a part of the display name.
TOOL_ALIASES = {"claude_code": "claude"}


@dataclass
class SearchParams:
    query: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    tags: list[str] = field(default_factory=list)
    project: str | None = None
    tool: str | None = None
    limit: int = PAGE_DEFAULT
    offset: int = 0


@dataclass(frozen=True)
class ParsedQuery:
    phrase: str | None
    tokens: tuple[str, ...] = ()


def parse_query(query: str) -> ParsedQuery:
    """A quoted query is a phrase; else its words without stop words, or with them if none would be left."""
    trimmed = query.strip()
    if len(trimmed) > 2 and trimmed[0] == trimmed[-1] == '"':
        return ParsedQuery(T.fold_str(trimmed[1:-1]))
    words = [w for w in re.split(rf"[\s{re.escape(T.QUERY_SEPARATORS)}]+", T.fold_str(trimmed)) if w]
    kept = [w for w in words if w not in T.STOP_WORDS] or words
    return ParsedQuery(None, tuple(kept)) if kept else ParsedQuery(T.fold_str(trimmed))


def date_bound(date: Column, bound: str, lower: bool) -> Column:
    """Dates are compared as dates if both sides are, else as text."""
    a, b = F.try_to_date(date, "yyyy-M-d"), F.try_to_date(F.lit(bound), "yyyy-M-d")
    as_date, as_text = (a >= b, date >= bound) if lower else (a <= b, date <= bound)
    return F.when(a.isNotNull() & b.isNotNull(), as_date).otherwise(as_text)


def structured(p: SearchParams) -> Column:
    """Date bounds (inclusive), all tags (exact), project (folded part) and tool (part)."""
    parts = [F.lit(True)]
    if p.date_from:
        parts.append(date_bound(F.col("date"), p.date_from, True))
    if p.date_to:
        parts.append(date_bound(F.col("date"), p.date_to, False))
    if p.tags:
        own = F.concat("error_tags", "topic_tags")
        parts.append(F.size(F.array_except(F.array(*map(F.lit, p.tags)), own)) == 0)
    if p.project:
        parts.append(T.fold(F.col("project")).contains(T.fold_str(p.project)))
    if p.tool:
        parts.append(F.lower("tool").contains(TOOL_ALIASES.get(p.tool.lower(), p.tool.lower())))
    return reduce(lambda a, b: a & b, parts)


def in_scope(sessions: DataFrame, allowed: DataFrame | None) -> DataFrame:
    return sessions if allowed is None else sessions.join(allowed.select("id"), "id", "left_semi")


#: The folded fields of a session, made once for all words of a query.
FOLDED = ("title", "topic_tags", "error_tags", "project", "body")


def folded(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """rows with each field folded beside it, as _title and so on: a column of its own, so that no word folds it again."""
    kinds = dict(rows.dtypes)
    return rows.withColumns({f"_{f}": F.transform(f, T.fold) if kinds[f].startswith("array") else T.fold(F.col(f)) for f in fields})


def field_weight(needle: str) -> Column:
    """The best single folded field that holds the needle, else null."""
    has = lambda tags: F.exists(tags, lambda t: t.contains(needle))
    return F.when(F.col("_title").contains(needle), TITLE).when(has("_topic_tags"), TOPIC).when(has("_error_tags"), ERROR)


def in_body(needle: str) -> Column:
    return F.coalesce(F.col("_body").contains(needle), F.lit(False))


def score(query: str | None) -> Column:
    """The rank of a session with folded fields for a query, null for no match; without a query every session has 0."""
    if query is None:
        return F.lit(0)
    parsed = parse_query(query)
    needles = [parsed.phrase] if parsed.phrase is not None else list(parsed.tokens)
    each = [F.coalesce(field_weight(n), F.when(in_body(n), BODY)) for n in needles]
    total = reduce(lambda a, b: a + b, each)  # null if any is null: all words are needed
    return total


def with_bodies(sessions: DataFrame, bodies: DataFrame | None) -> DataFrame:
    if bodies is None:
        return sessions if "body" in sessions.columns else sessions.withColumn("body", F.lit(None).cast("string"))
    return sessions.join(bodies.select("archive_path", "body"), "archive_path", "left")


def matches(sessions: DataFrame, p: SearchParams, bodies: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    found = with_bodies(in_scope(sessions, allowed).filter(structured(p)), bodies)
    if p.query is not None:
        found = folded(found, FOLDED[:3] + FOLDED[4:])
    return found.withColumn("score", score(p.query)).filter("score IS NOT NULL").drop("body", *[f"_{f}" for f in FOLDED])


def ranked_page(sessions: DataFrame, p: SearchParams, bodies: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """By score, then date (both falling), then index order; offset and at most 30 rows: a top-k without a full sort."""
    found = matches(sessions, p, bodies, allowed)
    return found.orderBy(F.desc("score"), F.desc("date"), "_pos").offset(p.offset).limit(min(p.limit, PAGE_MAX))


def page_counts(sessions: DataFrame, p: SearchParams, bodies: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """searched (scope before filters), total_matches and returned of a ranked page, in one pass each."""
    searched = in_scope(sessions, allowed).agg(F.count("*").alias("searched"))
    total = matches(sessions, p, bodies, allowed).agg(F.count("*").alias("total_matches"))
    left = F.greatest(F.col("total_matches") - p.offset, F.lit(0))
    return searched.join(total, F.lit(True)).withColumn("returned", F.least(left, F.lit(min(p.limit, PAGE_MAX)).cast("long")))


def recent(sessions: DataFrame, p: SearchParams, bodies: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """The newest matches, unranked."""
    return matches(sessions, p, bodies, allowed).drop("score").orderBy(F.desc("date"), "_pos").limit(p.limit)


def fulltext(sessions: DataFrame, query: str, bodies: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """All sessions that hold every word in title, project, tags or body, newest first; an empty query takes all."""
    rows = with_bodies(in_scope(sessions, allowed), bodies)
    if query.strip():
        parsed = parse_query(query)
        needles = [parsed.phrase] if parsed.phrase is not None else list(parsed.tokens)
        meta = lambda n: F.coalesce(field_weight(n).isNotNull() | F.col("_project").contains(n), F.lit(False))
        rows = folded(rows, FOLDED).filter(reduce(lambda a, b: a & b, [meta(n) | in_body(n) for n in needles]))
    return rows.drop("body", *[f"_{f}" for f in FOLDED]).orderBy(F.desc("date"), "_pos")


def ui_filter(sessions: DataFrame, text: str = "", fill_min: float = 0.0, fill_max: float = 100.0) -> DataFrame:
    """A part of the title, project, tool, provider or a tag, and a range of fill."""
    t = text.lower()
    tags = F.exists(F.concat("error_tags", "topic_tags"), lambda x: F.lower(x).contains(t))
    names = reduce(lambda a, b: a | b, [F.lower(c).contains(t) for c in ("title", "project", "tool", "provider")])
    return sessions.filter((names | tags) & F.col("fill_pct").between(fill_min, fill_max))


SORT_KEYS = ("date", "title", "project", "tool", "fill", "tokens", "tags")


def sorted_sessions(sessions: DataFrame, key: str, descending: bool = False, position: str = "_pos") -> DataFrame:
    """sessions in order of one of SORT_KEYS: texts by collation and numbers in them by value; equal ones by position.

    Descending is the exact reverse. A null counts as an empty text, or as 0.
    """
    text = lambda c: T.natural_key(F.coalesce(c, F.lit("")))
    filled = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    tags = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    order = {
        "date": lambda: [text(F.coalesce(filled("updated_at"), filled("session_timestamp"), filled("date")))],
        "title": lambda: [text(F.col("title"))],
        "project": lambda: [text(F.col("project"))],
        "tool": lambda: [text(F.col("tool"))],
        "fill": lambda: [F.coalesce("fill_pct", F.lit(0.0)), text(F.col("title"))],
        "tokens": lambda: [F.coalesce("output_tokens", F.lit(0)), text(F.col("title"))],
        "tags": lambda: [text(F.array_join(F.concat(tags("error_tags"), tags("topic_tags")), " "))],
    }[key]()
    by = [*order, F.col(position)]
    return sessions.orderBy(*[c.desc() if descending else c.asc() for c in by])


def raw_scope(sessions: DataFrame, groups: DataFrame) -> DataFrame:
    """The loaded rows that a raw search found something in, with its groups (session_id, ...) beside them; order is the rows'."""
    return sessions.join(groups, F.col("id") == F.col("session_id")).drop("session_id")


def literal_forms(needle: str) -> list[str]:
    """The folded needle, and its JSON-escaped form if that differs."""
    return list(dict.fromkeys([T.fold_str(needle), T.fold_str(T.json_escaped(needle))]))


def literal_hits(line: Column, needle: str) -> Column:
    """Overlapping places of the folded needle or of its JSON-escaped form; a place counts once."""
    return F.regexp_count(T.fold(line), F.lit("(?=" + "|".join(f"\\Q{f}\\E" for f in literal_forms(needle)) + ")"))


def raw_groups(lines: DataFrame, needle: str) -> DataFrame:
    """(session_id, hits, hit_lines, first_line) of every session with a hit in its raw lines (session_id, line_no, line)."""
    if not needle.strip():
        raise ValueError("a literal search needs a text")
    hits = lines.withColumn("n", literal_hits(F.col("line"), needle)).filter("n > 0")
    return hits.groupBy("session_id").agg(F.sum("n").cast("long").alias("hits"), F.count("*").alias("hit_lines"), F.min("line_no").alias("first_line"))


def raw_totals(lines: DataFrame, needle: str) -> DataFrame:
    """(sessions, hits, hit_lines, returned) over all groups, whatever the page shows."""
    groups = raw_groups(lines, needle)
    total = groups.agg(F.count("*").alias("sessions"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum("hit_lines"), F.lit(0)).alias("hit_lines"))
    return total.withColumn("returned", F.least("sessions", F.lit(GROUP_CAP).cast("long")))


def raw_grep(lines: DataFrame, sessions: DataFrame, needle: str) -> DataFrame:
    """Groups of hits, newest first, at most 200 of them; totals over all: `raw_totals`, excerpts: `raw_excerpts`.

    Sessions that were captured but not indexed come after all others.
    """
    named = raw_groups(lines, needle).join(sessions.select(F.col("id").alias("session_id"), "title", "date", "_pos"), "session_id", "left")
    ordered = named.orderBy(F.col("_pos").isNull(), F.desc("date"), "_pos", "session_id")
    return ordered.limit(GROUP_CAP).withColumn("excerpts_truncated", F.col("hit_lines") > EXCERPT_CAP)


def unsummarised(captured: DataFrame) -> DataFrame:
    """(session_id, title, date) of captured sources (id, source_path, mtime_secs): the file's name and day."""
    return captured.select(F.col("id").alias("session_id"), T.last_path_part(F.col("source_path")).alias("title"), F.coalesce(F.date_format(F.timestamp_seconds("mtime_secs"), "yyyy-MM-dd"), F.lit("")).alias("date"))


def excerpt(line: Column, needle: str, size: int = EXCERPT_CHARS) -> Column:
    """`size` characters around the first hit of either form of the needle."""
    places = [F.when(F.instr(T.fold(line), f) > 0, F.struct(F.instr(T.fold(line), f).alias("at"), F.lit(len(f)).alias("n"))) for f in literal_forms(needle)]
    hit = places[0] if len(places) == 1 else F.array_min(F.array_compact(F.array(*places)))
    start = F.greatest(F.lit(1), F.least(hit["at"] - (size - hit["n"]) / 2, F.char_length(line) - size + 1).cast("int"))
    return F.substring(line, start, F.lit(size))


def raw_excerpts(lines: DataFrame, needle: str) -> DataFrame:
    """The first 20 hit lines of each session, an excerpt each."""
    hits = lines.filter(reduce(lambda a, b: a | b, [T.fold(F.col("line")).contains(f) for f in literal_forms(needle)]))
    order = Window.partitionBy("session_id").orderBy("line_no")
    first = hits.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= EXCERPT_CAP)
    return first.select("session_id", "line_no", excerpt(F.col("line"), needle).alias("excerpt"))


def page_bytes(text: str, offset: int, limit: int) -> dict:
    """A slice of UTF-8 bytes between character boundaries, and where the next one starts."""
    raw = text.encode()

    def floor(i: int) -> int:
        i = min(max(i, 0), len(raw))
        while i < len(raw) and i > 0 and raw[i] & 0xC0 == 0x80:
            i -= 1
        return i

    start, end = floor(offset), floor(offset + limit)
    if end <= start < len(raw):  # a limit shorter than one character still moves on
        end = start + 1
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
    return {"text": raw[start:end].decode(), "next_offset": end if end < len(raw) else None, "total_bytes": len(raw)}
