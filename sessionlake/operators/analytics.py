"""Counts and comparisons over sessions: facets, periods, health, statistics, project activity and the weekly digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE_DAYS, QUIET_DAYS, ACTIVITY_ROWS, TOP_TAGS = 60, 180, 40, 10
UNLABELED = "(unlabeled)"


def facet(rows: DataFrame, key: str | Column) -> DataFrame:
    """(value, n), most frequent first, then by value."""
    value = F.col(key) if isinstance(key, str) else key
    return rows.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def facets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(facet, value, n) of several keys in one pass, by grouping sets."""
    sets = [[F.col(k)] for k in keys]
    grouped = rows.groupingSets(sets, *[F.col(k) for k in keys]).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    which = F.when(F.lit(False), "")
    value = F.lit(None).cast("string")
    for i, k in enumerate(keys):
        mine = F.col("g").bitwiseAND(1 << (len(keys) - 1 - i)) == 0
        which, value = which.when(mine, k), F.when(mine, F.col(k).cast("string")).otherwise(value)
    return grouped.select(which.alias("facet"), value.alias("value"), "n")


def date_bounds(rows: DataFrame, date: str = "date") -> DataFrame:
    return rows.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count("*").alias("n"))


def percent_change(first: Column, second: Column) -> Column:
    """Null if there was nothing before."""
    return F.when(first > 0, (second - first) * 100.0 / first)


def compare_periods(rows: DataFrame, key: str, first: Column, second: Column) -> DataFrame:
    """Counts of each key in two periods, which may overlap: one pass, keys that occur in either."""
    counted = rows.groupBy(F.col(key).alias("key")).agg(F.count_if(first).alias("n_first"), F.count_if(second).alias("n_second"))
    some = counted.filter("n_first > 0 OR n_second > 0")
    return some.select("key", "n_first", "n_second", (F.col("n_second") - F.col("n_first")).alias("change"), F.round(percent_change(F.col("n_first"), F.col("n_second")), 6).alias("percent")).orderBy("key")


def archive_health(sessions: DataFrame, summaries: DataFrame, raws: DataFrame) -> DataFrame:
    """How many sessions have their summary and raw file; the listings hold one path or id a row."""
    joined = (
        sessions.join(summaries.select("id").distinct().withColumn("has_summary", F.lit(True)), "id", "left")
        .join(raws.select("id").distinct().withColumn("has_raw", F.lit(True)), "id", "left")
        .withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_summary", "has_raw")})
    )
    return joined.agg(
        F.count("*").alias("sessions"),
        F.count_if("has_summary").alias("summaries_present"),
        F.count_if(~F.col("has_summary")).alias("summaries_missing"),
        F.count_if("has_raw").alias("raws_present"),
        F.count_if(~F.col("has_raw")).alias("raws_missing"),
    )


def top_tags(rows: DataFrame, tags: str, n: int = TOP_TAGS) -> DataFrame:
    """The n most frequent tags; ties by tag."""
    exploded = rows.select(F.explode(tags).alias("tag"))
    return exploded.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(n)


def activity_status(last: Column, today: Column) -> Column:
    """active up to 60 days, quiet up to 180, then dormant; an unreadable date is active."""
    days = F.datediff(today, last)
    return F.when(days.isNull() | (days <= ACTIVE_DAYS), "active").when(days <= QUIET_DAYS, "quiet").otherwise("dormant")


def project_activity(rows: DataFrame, today: Column, project: str = "project", date: str = "date", limit: int | None = ACTIVITY_ROWS) -> DataFrame:
    """Sessions, first and last day and status of each project; names of digits only are one unlabelled project."""
    name = F.when(F.col(project).rlike("^[0-9]+$") | (F.trim(project) == ""), UNLABELED).otherwise(F.col(project))
    grouped = rows.groupBy(name.alias("project")).agg(F.count("*").alias("sessions"), F.min(date).alias("first_seen"), F.max(date).alias("last_seen"))
    out = grouped.withColumn("status", activity_status(F.try_to_date(F.col("last_seen").cast("string"), "yyyy-M-d"), today)).orderBy(F.desc("sessions"), "project")
    return out if limit is None else out.limit(limit)


def iso_week(ts: Column) -> Column:
    """ISO year and week as 2024-W05."""
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))


def weekly_digest(rows: DataFrame, ts: str, key: str) -> DataFrame:
    return rows.groupBy(iso_week(F.col(ts)).alias("week"), F.col(key).alias("key")).agg(F.count("*").alias("n"))


def skip_counts(rows: DataFrame, reason: Column) -> DataFrame:
    return rows.withColumn("reason", reason).filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def probe(rows: DataFrame, ts: str, text: str) -> DataFrame:
    """Row count, date range and blank texts of a source table, without its contents."""
    blank = F.col(text).isNull() | (F.trim(text) == "")
    return rows.agg(F.count("*").alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count_if(blank).alias("blank_texts"))
