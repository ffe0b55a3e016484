"""Queries of briefings, imports and backups, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.operators import briefing
from sessionlake.queries import FOLD, SESSIONS, archive_sessions, query
from sessionlake.session import table
from sessionlake.sources import backup


def briefed(spark: SparkSession, sf: str) -> DataFrame:
    """documents as sessions with the columns that briefings read."""
    return archive_sessions(spark, sf).withColumns({"session_type": F.lit("chat"), "fill_pct": (F.col("_pos") % 100).cast("double"), "archive_path": F.concat(F.lit("p/10-20-30-"), "id"), "updated_at": F.lit("")})


JOINED = FOLD.format("coalesce(title, '') || ' chat ' || err || ' ' || topic")


@query(f"""WITH {SESSIONS} SELECT id FROM s WHERE date BETWEEN '2023-02-05' AND '2023-09-30' AND pos % 100 BETWEEN 5 AND 90
AND (contains({JOINED}, 'chat src1') OR contains({FOLD.format("coalesce(body, '')")}, 'chat src1'))""")
def briefing_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The keyword crosses from the type to the tags."""
    return briefing.briefing_sessions(briefed(spark, sf), "2023-02-05", "2023-09-30", 5, 90, "Chat SRC1").select("id")


@query(f"WITH {SESSIONS} SELECT id FROM s ORDER BY date DESC, pos LIMIT 6")
def briefing_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Nothing matches: the newest six."""
    return briefing.briefing_sessions(briefed(spark, sf), keyword="no document says this").select("id")


@query(f"WITH {SESSIONS} SELECT count(*) || ' sessions - Mar ' || min(day(CAST(date AS DATE))) || '-' || max(day(CAST(date AS DATE))) AS header FROM s WHERE date BETWEEN '2023-03-01' AND '2023-03-31'")
def briefing_header(spark: SparkSession, sf: str) -> DataFrame:
    return briefing.header(briefed(spark, sf).filter("date BETWEEN '2023-03-01' AND '2023-03-31'"))


@query(f"WITH {SESSIONS} SELECT id, date FROM s ORDER BY date DESC, pos LIMIT 25 OFFSET 50")
def recent_sessions_page(spark: SparkSession, sf: str) -> DataFrame:
    return briefing.recent_first(briefed(spark, sf), offset=50).select("id", "date")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS participants FROM (SELECT user_id, event_type, min(event_id) AS first FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def first_seen_values(spark: SparkSession, sf: str) -> DataFrame:
    found = briefing.first_seen(table(spark, sf, "events"), "user_id", "event_type", "event_id")
    return found.select("user_id", F.array_join("values", ",").alias("participants"))


@query("SELECT count(*) AS covered FROM (SELECT doc_id FROM labels UNION SELECT page_id FROM pages)")
def covered_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return briefing.covered(table(spark, sf, "labels").select("doc_id"), table(spark, sf, "pages").select("page_id"))


@query("""WITH p(provider, path, present) AS (VALUES ('src1', '/a', true), ('src2', '', true), ('src3', '/b', false), ('nobody', '/c', true)),
f AS (SELECT source AS provider, count(*) AS n, sum(strlen(coalesce(text, ''))) AS b FROM documents GROUP BY 1),
j AS (SELECT provider, path, CASE WHEN path = '' THEN 'unset' WHEN NOT present THEN 'missing_folder' WHEN n IS NULL THEN 'no_export_found' ELSE 'found' END AS state, n, b FROM p LEFT JOIN f USING (provider))
SELECT provider, path, state, CAST(CASE WHEN state = 'found' THEN n ELSE 0 END AS BIGINT) AS file_count, CAST(CASE WHEN state = 'found' THEN b ELSE 0 END AS BIGINT) AS total_bytes FROM j""")
def import_path_status(spark: SparkSession, sf: str) -> DataFrame:
    """documents are the files of their sources."""
    providers = spark.createDataFrame([("src1", "/a", True), ("src2", "", True), ("src3", "/b", False), ("nobody", "/c", True)], "provider string, path string, present boolean")
    files = table(spark, sf, "documents").select(F.col("source").alias("provider"), F.octet_length(F.coalesce("text", F.lit(""))).alias("length"))
    return backup.import_status(providers, files)


@query("""WITH t AS (SELECT conv_id, list_distinct(list(role || '-' || (turn % 7))) AS roles FROM conversations GROUP BY 1), o AS (SELECT conv_id, list_sort(roles) AS x FROM t)
SELECT conv_id, CASE WHEN len(x) <= 1 THEN coalesce(x[1], 'Unknown') WHEN conv_id % 3 = 0 THEN 'Group ' || conv_id WHEN len(x) > 4 THEN array_to_string(x[1:4], ', ') || ', +' || (len(x) - 4) ELSE array_to_string(x, ', ') END AS title FROM o""")
def conversation_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Every third conversation has a name; the others are named by their participants."""
    labels = F.sort_array(F.collect_set(F.concat("role", F.lit("-"), (F.col("turn") % 7).cast("string"))))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(labels.alias("labels"))
    name = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(" Group "), F.col("conv_id").cast("string")))
    return rows.select("conv_id", backup.conversation_title(name, F.col("labels")).alias("title"))
