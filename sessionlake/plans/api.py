"""The read-only tools and the analytics dispatch over an archive of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from sessionlake.operators import analytics, search, sweep

RAW_DEFAULT, RAW_MAX, BYTES_DEFAULT, BYTES_MAX = 40, 120, 20_000, 50_000


@dataclass
class Archive:
    """The tables of one workspace; scope, if any, is a table of ids that all tools keep to."""

    sessions: DataFrame
    bodies: DataFrame
    raw_lines: DataFrame
    profile: str | None = None
    digests: dict[str, str] | None = None
    scope: DataFrame | None = None

    def search_sessions(self, **params) -> dict:
        p = search.SearchParams(**params)
        counts = search.page_counts(self.sessions, p, self.bodies, self.scope).first().asDict()
        return counts | {"offset": p.offset, "results": [r.asDict() for r in search.ranked_page(self.sessions, p, self.bodies, self.scope).collect()]}

    def search_raw_transcripts(self, query: str, limit: int = RAW_DEFAULT) -> dict:
        n = max(1, min(limit, RAW_MAX))
        lines = self.raw_lines if self.scope is None else self.raw_lines.join(self.scope.select(F.col("id").alias("session_id")), "session_id", "left_semi")
        groups = search.raw_grep(lines, self.sessions, query)
        found = groups.limit(n + 1).collect()
        wanted = [r["session_id"] for r in found[:n]]
        excerpts = search.raw_excerpts(lines.filter(F.col("session_id").isin(wanted)), query).orderBy("session_id", "line_no").collect()
        of = {w: [e["excerpt"] for e in excerpts if e["session_id"] == w] for w in wanted}
        return {"groups": [r.asDict() | {"excerpts": of[r["session_id"]]} for r in found[:n]], "results_truncated": len(found) > n}

    def visible(self, session_id: str) -> DataFrame:
        return search.in_scope(self.sessions, self.scope).filter(F.col("id") == session_id)

    def read_session(self, session_id: str) -> str | None:
        row = self.visible(session_id).join(self.bodies, "archive_path").select("body").first()
        return row and row["body"]

    def read_raw_session(self, session_id: str, offset: int = 0, limit: int = BYTES_DEFAULT) -> dict | None:
        if self.visible(session_id).isEmpty():
            return None
        size = F.octet_length("line") + 1
        ends = F.sum(size).over(Window.orderBy("line_no"))
        lines = self.raw_lines.filter(F.col("session_id") == session_id).select("line_no", "line", ends.alias("end"), (ends - size).alias("start"))
        total = max((lines.agg(F.max("end")).first()[0] or 1) - 1, 0)
        offset, limit = min(max(offset, 0), total), min(limit, BYTES_MAX)
        # only the lines of the page come to the driver
        rows = lines.filter((F.col("end") > offset) & (F.col("start") < offset + limit + 4)).orderBy("line_no").collect()
        base = rows[0]["start"] if rows else offset
        page = search.page_bytes("\n".join(r["line"] for r in rows), offset - base, limit)
        end = base + (page["total_bytes"] if page["next_offset"] is None else page["next_offset"])
        return {"text": page["text"], "next_offset": end if end < total else None, "total_bytes": total}

    def get_profile(self) -> str | None:
        return self.profile

    def get_digest(self, name: str | None = None, offset: int = 0, max_bytes: int = BYTES_DEFAULT) -> str | None:
        """A weekly digest by name, or the latest one; a part of it has a header line that tells where the next one starts."""
        full = (self.digests or {}).get(name or max(self.digests or {"": ""}))
        limit = max(1, min(max_bytes, BYTES_MAX))
        if full is None or (offset == 0 and len(full.encode()) <= limit):
            return full
        page = search.page_bytes(full, offset, limit)
        end = page["total_bytes"] if page["next_offset"] is None else page["next_offset"]
        more = "end of digest" if page["next_offset"] is None else f"continue with offset={end}"
        return f"[digest slice bytes {end - len(page['text'].encode())}..{end} of {page['total_bytes']}; {more}]\n{page['text']}"

    def count_by_provider(self, date_from: str | None = None, date_to: str | None = None) -> dict:
        rows = search.in_scope(self.sessions, self.scope)
        chosen = rows.filter(search.structured(search.SearchParams(date_from=date_from, date_to=date_to)))
        return {"searched": rows.count(), "total": chosen.count(), "groups": [r.asDict() for r in analytics.facet(chosen, "tool").collect()]}

    def archive_facets(self) -> list[dict]:
        return [r.asDict() for r in analytics.facets(search.in_scope(self.sessions, self.scope), ["tool", "project", "session_type"]).orderBy("facet", F.desc("n"), "value").collect()]

    def compare_periods(self, key: str, first: tuple[str, str], second: tuple[str, str]) -> list[dict]:
        between = lambda p: search.structured(search.SearchParams(date_from=p[0], date_to=p[1]))
        return [r.asDict() for r in analytics.compare_periods(search.in_scope(self.sessions, self.scope), key, between(first), between(second)).collect()]


TOOLS = ["search_sessions", "search_raw_transcripts", "read_session", "read_raw_session", "get_profile", "get_digest", "count_by_provider", "archive_facets", "compare_periods"]


def dispatch(tables: Archive, name: str, arguments: dict) -> object:
    """A tool by name; unknown names and wrong arguments are errors."""
    if name not in TOOLS:
        raise ValueError(f"unknown tool {name}")
    try:
        return getattr(tables, name)(**arguments)
    except TypeError as e:
        raise ValueError(f"wrong arguments for {name}: {e}") from e


def pack(tables: Archive, path: str, sources: list[str], never: list[str], with_raw: bool = False, digests: DataFrame | None = None, profile: DataFrame | None = None) -> dict:
    """Writes the tables of a persona pack (sweep.pack) below a folder; returns the rows of each, counted as they are written."""
    parts = sweep.pack(tables.sessions, tables.bodies, digests, sources, tables.raw_lines if with_raw else None, profile, never)
    counts = {}
    for name, rows in parts.items():
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/{name}")
        counts[name] = seen.get["n"]
    del counts["manifest"]
    return counts
