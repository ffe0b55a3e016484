"""Briefings: the sessions that one covers, their order and its header line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions import text as T

FALLBACK, PAGE = 6, 25


def instant(c: str) -> Column:
    """An RFC 3339 time, or null."""
    return F.when(F.col(c).rlike(r"^\d{4}-\d\d-\d\dT"), F.try_to_timestamp(F.col(c)))


def session_time() -> Column:
    """updated_at, else session_timestamp, else the date with the time that starts the archived file's name."""
    name = F.substring_index("archive_path", "/", -1)
    clock = F.nullif(F.regexp_replace(F.regexp_extract(name, r"^(\d{1,2}-\d{1,2}-\d{1,2})", 1), "-", ":"), F.lit(""))
    filed = F.try_to_timestamp(F.concat("date", F.lit(" "), F.coalesce(clock, F.lit("00:00:00"))))
    return F.coalesce(instant("updated_at"), instant("session_timestamp"), filed, F.current_timestamp())


def recent_first(sessions: DataFrame, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """A page in order of updated_at, session_timestamp or date, compared as text; empty ones count as missing."""
    key = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("updated_at", "session_timestamp", "date")])
    return sessions.orderBy(key.desc(), "_pos").offset(offset).limit(limit)


def keyword_matches(keyword: str, body: str = "body") -> Column:
    """The keyword in the joined fields, where it may cross from one to the next, or in the body."""
    needle = T.fold_str(keyword)
    fields = F.concat_ws(" ", "title", "session_type", F.array_join("error_tags", " "), F.array_join("topic_tags", " "))
    return T.fold(fields).contains(needle) | F.coalesce(T.fold(F.col(body)).contains(needle), F.lit(False))


def briefing_sessions(
    sessions: DataFrame, date_from: str | None = None, date_to: str | None = None, fill_min: float | None = None, fill_max: float | None = None, keyword: str = "", fallback: int = FALLBACK
) -> DataFrame:
    """Sessions that pass all filters, newest first; without filters, or if none passes, the newest `fallback` ones.

    A date that can't be read passes both date filters.
    """
    day = F.try_to_date(F.col("date"), "yyyy-M-d")
    tests = [day.isNull() | (day >= F.lit(date_from).cast("date"))] if date_from else []
    tests += [day.isNull() | (day <= F.lit(date_to).cast("date"))] if date_to else []
    tests += [F.col("fill_pct") >= fill_min] if fill_min is not None else []
    tests += [F.col("fill_pct") <= fill_max] if fill_max is not None else []
    tests += [keyword_matches(keyword)] if keyword else []
    newest = [session_time().desc(), "_pos"]
    if tests:
        found = sessions.filter(reduce(lambda a, b: a & b, tests))
        if not found.isEmpty():
            return found.orderBy(*newest)
    return sessions.orderBy(*newest).limit(fallback)


def header(sessions: DataFrame) -> DataFrame:
    """One row: the number of sessions and their days, shortened within a month."""
    n, first, last = F.col("n"), F.to_date("first"), F.to_date("last")
    short = lambda d: F.date_format(d, "MMM d")
    days = F.when(n == 0, "").when(first == last, short(first)).when(F.trunc(first, "month") == F.trunc(last, "month"), F.concat(short(first), F.lit("-"), F.date_format(last, "d")))
    counted = sessions.agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
    return counted.select(F.concat(n.cast("string"), F.when(n == 1, " session - ").otherwise(" sessions - "), days.otherwise(F.concat(short(first), F.lit("-"), short(last)))).alias("header"))


def first_seen(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, values): the distinct values of each key in the order in which they came first."""
    first = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("_at"))
    pairs = F.sort_array(F.collect_list(F.struct("_at", value)))
    return first.groupBy(key).agg(F.transform(pairs, lambda x: x[value]).alias("values"))


def covered(*tables: DataFrame) -> DataFrame:
    """How many different ids the tables have together; each has one column."""
    return reduce(DataFrame.union, tables).agg(F.count_distinct(F.col(tables[0].columns[0])).alias("covered"))
