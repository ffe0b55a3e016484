"""The registered queries of the archive operators, with DuckDB SQL for each that SQL expresses.

The driver's tables carry the operators: a document is a session with a body, a conversation is a session of messages,
customers are projects, events are messages with times.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions import text as T
from sessionlake.operators import analytics, archive, distill, search, semantic, sessions, sweep
from sessionlake.session import table
from sessionlake.sources import agents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query by its function's name, with its DuckDB SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def archive_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """documents as sessions: the first line is the title, lang and source are tags, ids give days."""
    d = table(spark, sf, "documents")
    return d.select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"),
        F.col("source").alias("project"),
        F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") % 700).cast("int")), "yyyy-MM-dd").alias("date"),
        F.left(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(80)).alias("title"),
        F.concat(F.lit("Tool "), "lang").alias("tool"),
        F.lit("").alias("session_timestamp"),
        F.col("lang").alias("provider"),
        F.array("source").alias("error_tags"),
        F.array("lang").alias("topic_tags"),
        F.col("doc_id").alias("_pos"),
        F.col("text").alias("body"),
    )


SESSIONS = """s AS (SELECT 'doc-' || doc_id AS id, source AS project, strftime(DATE '2023-01-01' + CAST(doc_id % 700 AS INTEGER), '%Y-%m-%d') AS date,
  left(string_split(text, chr(10))[1], 80) AS title, 'Tool ' || lang AS tool, lang AS provider, source AS err, lang AS topic, doc_id AS pos, text AS body FROM documents)"""
FOLD = "translate(lower({}), 'άέήίόύώΐΰϊϋς', 'αεηιουωιυιυσ')"


def weight_sql(needle: str) -> str:
    has = lambda c: f"contains({FOLD.format(c)}, '{needle}')"
    return f"CASE WHEN {has('title')} THEN 8 WHEN {has('topic')} THEN 4 WHEN {has('err')} THEN 3 WHEN {has('body')} THEN 1 END"


PAGE = ["id", "date", "score"]


@query(f"WITH {SESSIONS}, r AS (SELECT id, date, pos, {weight_sql('ertion')} + {weight_sql('heed')} AS score FROM s WHERE date >= '2023-02-01') SELECT id, date, score FROM r WHERE score IS NOT NULL ORDER BY score DESC, date DESC, pos LIMIT 20 OFFSET 5")
def search_ranked_page(spark: SparkSession, sf: str) -> DataFrame:
    p = search.SearchParams("the ertion, of heed?", date_from="2023-2-1", limit=20, offset=5)
    return search.ranked_page(archive_sessions(spark, sf), p).select(*PAGE)


@query(f"WITH {SESSIONS}, r AS (SELECT {weight_sql('ertion')} + {weight_sql('heed')} AS score FROM s WHERE date >= '2023-02-01') SELECT (SELECT count(*) FROM s) AS searched, count(*) AS total_matches, least(greatest(count(*) - 5, 0), 20) AS returned FROM r WHERE score IS NOT NULL")
def search_page_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = search.SearchParams("the ertion, of heed?", date_from="2023-2-1", limit=20, offset=5)
    return search.page_counts(archive_sessions(spark, sf), p)


@query(f"WITH {SESSIONS} SELECT id, date, {weight_sql('of the')} AS score FROM s WHERE {weight_sql('of the')} IS NOT NULL ORDER BY score DESC, date DESC, pos LIMIT 30")
def search_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return search.ranked_page(archive_sessions(spark, sf), search.SearchParams('"of the"', limit=500)).select(*PAGE)


@query(f"WITH {SESSIONS} SELECT id, date FROM s WHERE {weight_sql('licensed')} IS NOT NULL ORDER BY date DESC, pos LIMIT 15")
def search_recency(spark: SparkSession, sf: str) -> DataFrame:
    return search.recent(archive_sessions(spark, sf), search.SearchParams("licensed", limit=15)).select("id", "date")


@query(f"WITH {SESSIONS} SELECT id, date FROM s WHERE ({weight_sql('src1')} IS NOT NULL OR contains(lower(project), 'src1'))")
def search_fulltext(spark: SparkSession, sf: str) -> DataFrame:
    return search.fulltext(archive_sessions(spark, sf), "src1 the").select("id", "date")


@query(f"WITH {SESSIONS} SELECT id, project, date FROM s WHERE date BETWEEN '2023-03-05' AND '2024-01-31' AND topic = 'en' AND contains(lower(project), 'src1') AND contains(lower(tool), 'tool')")
def filter_date_tags_project_tool(spark: SparkSession, sf: str) -> DataFrame:
    p = search.SearchParams(date_from="2023-3-5", date_to="2024-01-31", tags=["en"], project="SRC1", tool="tool")
    return archive_sessions(spark, sf).filter(search.structured(p)).select("id", "project", "date")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def scope_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    allowed = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    orders = table(spark, sf, "orders").withColumn("id", F.col("o_custkey"))
    return search.in_scope(orders, allowed).select("o_orderkey", "o_custkey")


@query(f"WITH {SESSIONS} SELECT id FROM s WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE 'doc-' || l.doc_id = id AND toxic = 1 AND (quality = 0 OR project = 'src1'))")
def tombstone_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """Tombstones of toxic documents: of any source for quality 0, else of src1 only."""
    t = table(spark, sf, "labels").filter("toxic = 1")
    marks = t.select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"), F.when(F.col("quality") == 0, "").otherwise("src1").alias("source_path"))
    return archive.without_deleted(archive_sessions(spark, sf), marks, source="project").select("id")


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def facets_by_event_type(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.facet(table(spark, sf, "events"), "event_type")


@query("""SELECT CASE WHEN GROUPING(o_orderstatus) = 0 THEN 'o_orderstatus' ELSE 'o_orderpriority' END AS facet, coalesce(o_orderstatus, o_orderpriority) AS value, count(*) AS n
FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))""")
def facets_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.facets(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT strftime(min(ts), '%Y-%m-%d') AS first_date, strftime(max(ts), '%Y-%m-%d') AS last_date, count(*) AS n FROM events")
def facet_date_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.date_bounds(table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date")))


PERIODS = """WITH c AS (SELECT {key} AS key, count(*) FILTER ({date} >= TIMESTAMP '{a}' AND {date} < TIMESTAMP '{b}') AS n_first, count(*) FILTER ({date} >= TIMESTAMP '{c}' AND {date} < TIMESTAMP '{d}') AS n_second FROM {table} GROUP BY 1)
SELECT key, n_first, n_second, n_second - n_first AS change, round(CASE WHEN n_first > 0 THEN (n_second - n_first) * 100.0::DOUBLE / n_first END, 6) AS percent FROM c WHERE n_first > 0 OR n_second > 0"""


def within(column: str, start: str, end: str) -> F.Column:
    return (F.col(column) >= F.lit(start).cast("timestamp_ntz")) & (F.col(column) < F.lit(end).cast("timestamp_ntz"))


@query(PERIODS.format(key="o_orderpriority", date="o_orderdate", table="orders", a="1995-01-01", b="1996-01-01", c="1995-07-01", d="1997-01-01"))
def compare_periods_orders(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.compare_periods(table(spark, sf, "orders"), "o_orderpriority", within("o_orderdate", "1995-01-01", "1996-01-01"), within("o_orderdate", "1995-07-01", "1997-01-01"))


@query(PERIODS.format(key="l_returnflag", date="l_shipdate", table="lineitem", a="1993-01-01", b="1994-01-01", c="1997-01-01", d="1998-01-01"))
def compare_periods_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.compare_periods(table(spark, sf, "lineitem"), "l_returnflag", within("l_shipdate", "1993-01-01", "1994-01-01"), within("l_shipdate", "1997-01-01", "1998-01-01"))


@query("""WITH j AS (SELECT d.doc_id, d.doc_id IN (SELECT doc_id FROM labels) AS a, d.doc_id IN (SELECT page_id FROM pages) AS b FROM documents d)
SELECT count(*) AS sessions, count(*) FILTER (a) AS summaries_present, count(*) FILTER (NOT a) AS summaries_missing, count(*) FILTER (b) AS raws_present, count(*) FILTER (NOT b) AS raws_missing FROM j""")
def archive_health(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return analytics.archive_health(docs, table(spark, sf, "labels").select(F.col("doc_id").alias("id")), table(spark, sf, "pages").select(F.col("page_id").alias("id")))


@query(r"SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS tag FROM documents) GROUP BY 1 ORDER BY n DESC, tag LIMIT 10")
def session_stats_top_tags(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.top_tags(table(spark, sf, "documents").select(F.split("text", " ").alias("tags")), "tags")


@query("""WITH c AS (SELECT CAST(o_custkey AS VARCHAR) || 'p' AS project, count(*) AS sessions, strftime(min(o_orderdate), '%Y-%m-%d') AS first_seen, strftime(max(o_orderdate), '%Y-%m-%d') AS last_seen FROM orders GROUP BY 1)
SELECT *, CASE WHEN date_diff('day', CAST(last_seen AS DATE), DATE '1998-08-02') <= 60 THEN 'active' WHEN date_diff('day', CAST(last_seen AS DATE), DATE '1998-08-02') <= 180 THEN 'quiet' ELSE 'dormant' END AS status FROM c""")
def project_activity_status(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.concat(F.col("o_custkey").cast("string"), F.lit("p")).alias("project"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return analytics.project_activity(o, F.lit("1998-08-02").cast("date"), limit=None)


@query("SELECT strftime(ts, '%G-W%V') AS week, event_type AS key, count(*) AS n FROM events GROUP BY 1, 2")
def weekly_digest(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.weekly_digest(table(spark, sf, "events"), "ts", "event_type")


WINDOWS = """WITH a AS (SELECT event_id, user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - 1 AS k FROM b)
SELECT event_id, island, k // {cap} AS chunk, k % {cap} AS place FROM c"""


@query(WINDOWS.format(cap=2147483647))
def gap_windows(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.gap_windows(table(spark, sf, "events"), "user_id", "ts", "event_id", "1 hour", None).select("event_id", "island", "chunk", "place")


@query(WINDOWS.format(cap=5).replace("1 HOUR", "48 HOUR"))
def gap_windows_capped(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.gap_windows(table(spark, sf, "events"), "user_id", "ts", "event_id", "48 hours", 5).select("event_id", "island", "chunk", "place")


@query("SELECT user_id, arg_min(event_type, {'t': ts, 'e': event_id}) AS first_type, arg_max(event_type, {'t': ts, 'e': event_id}) AS last_type, arg_max(value, {'t': ts, 'e': event_id}) AS last_value FROM events GROUP BY 1")
def first_last_per_group(spark: SparkSession, sf: str) -> DataFrame:
    order = F.struct("ts", "event_id")
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", order).alias("first_type"), sessions.last_by("event_type", order).alias("last_type"), sessions.last_by("value", order).alias("last_value"))


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def dedupe_latest(spark: SparkSession, sf: str) -> DataFrame:
    return archive.latest(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "ts")


@query("SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN 'new' ELSE event_type END AS event_type FROM events UNION ALL SELECT -event_id - 1, 'added' FROM events WHERE event_id % 11 = 0")
def upsert_replace(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh event comes again with another type, twice; every eleventh brings an unknown id."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type", F.col("event_id").alias("_pos"))
    again = e.filter("id % 7 = 0")
    new = again.withColumns({"event_type": F.lit("old"), "_pos": F.lit(0).cast("long")}).union(again.withColumns({"event_type": F.lit("new"), "_pos": F.lit(1).cast("long")}))
    new = new.union(e.filter("id % 11 = 0").select(-F.col("id") - 1, F.lit("added"), F.lit(0).cast("long")))
    return archive.upsert(e, new).select("id", "event_type")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'new' WHEN doc_id % 10 IN (1, 2) THEN 'changed' WHEN doc_id % 10 = 3 THEN 'same' WHEN doc_id % 10 = 4 THEN 'changed' ELSE 'same' END AS change FROM documents""")
def change_detection(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot in which tenths of the documents miss, differ by hash, by time, or by size only."""
    d = table(spark, sf, "documents")
    m = F.col("doc_id") % 10
    h = F.sha2(F.col("text"), 256)
    staged = d.select(F.col("doc_id").alias("id"), F.when(m == 2, "").otherwise(h).alias("transcript_hash"), F.lit("2024-01-02").alias("updated_at"), F.octet_length("text").cast("long").alias("source_size_bytes"))
    staged = staged.withColumn("updated_at", F.when(F.col("id") % 10 == 4, "").otherwise(F.col("updated_at")))
    old = d.filter(m != 0).select(
        F.col("doc_id").alias("id"),
        F.when(m == 1, "other").when(m == 4, "").otherwise(h).alias("transcript_hash"),
        F.when(m == 2, "2024-01-01").otherwise("2024-01-02").alias("updated_at"),
        F.when(m.isin(3, 4), F.octet_length("text") + 1).otherwise(F.octet_length("text")).cast("long").alias("source_size_bytes"),
    )
    return archive.change_status(staged, old).select("id", "change")


@query("""WITH m AS (SELECT conv_id, turn, '[' || upper(role[1]) || role[2:] || ']' AS label, role, trim(coalesce(text, '')) AS t FROM conversations)
SELECT conv_id, count(*) AS n_messages, md5(string_agg(label || chr(10) || t, chr(10) || chr(10) ORDER BY turn) FILTER (t <> '')) AS transcript_md5,
sha256(string_agg(t, chr(10) ORDER BY turn) FILTER (t <> '')) AS transcript_hash, CAST(coalesce(sum(strlen(t)) FILTER (role = 'assistant'), 0) // 4 AS BIGINT) AS output_tokens, CAST(sum(strlen(t)) AS BIGINT) AS n_bytes FROM m GROUP BY 1 HAVING sum(strlen(t)) > 0""")
def session_assembly(spark: SparkSession, sf: str) -> DataFrame:
    a = sessions.assemble(table(spark, sf, "conversations"), "conv_id")
    return a.withColumn("transcript_md5", F.md5("transcript")).drop("transcript")


@query("SELECT conv_id, turn, CAST(strlen(text) // 4 AS BIGINT) AS tokens, round(least(100.0, strlen(text)::DOUBLE / 600000 * 100), 9) AS fill_pct FROM conversations")
def token_estimate_fill(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.estimated(table(spark, sf, "conversations"), "text").select("conv_id", "turn", "tokens", F.round("fill_pct", 9).alias("fill_pct"))


@query("SELECT conv_id, count(*) AS n_messages, count(*) FILTER (role = 'assistant') AS n_owner FROM conversations GROUP BY 1 HAVING count(*) < 3 OR count(*) FILTER (role = 'assistant') = 0")
def low_signal_filter(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.low_signal(table(spark, sf, "conversations"), "conv_id")


def raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("session_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES = "l AS (SELECT 'doc-' || doc_id AS session_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS line FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i))"


@query(f"""WITH {SESSIONS}, {LINES}, h AS (SELECT session_id, line_no, len(list_filter(range(1, length(line) + 1), lambda i: {FOLD.format('line')}[i:i+3] = 'anan')) AS n FROM l),
g AS (SELECT session_id, CAST(sum(n) AS BIGINT) AS hits, count(*) AS hit_lines, CAST(min(line_no) AS INTEGER) AS first_line FROM h WHERE n > 0 GROUP BY 1)
SELECT session_id, hits, hit_lines, first_line, date, hit_lines > 20 AS excerpts_truncated FROM g JOIN s ON s.id = session_id ORDER BY date DESC, pos LIMIT 200""")
def raw_grep(spark: SparkSession, sf: str) -> DataFrame:
    return search.raw_grep(raw_lines(spark, sf), archive_sessions(spark, sf), "aNan").select("session_id", "hits", "hit_lines", "first_line", "date", "excerpts_truncated")


@query(f"""WITH {LINES}, h AS (SELECT *, instr({FOLD.format('line')}, 'licensed') AS hit, length(line) AS n, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS k FROM l WHERE contains({FOLD.format('line')}, 'licensed'))
SELECT session_id, CAST(line_no AS INTEGER) AS line_no, substr(line, CAST(greatest(1, least(hit - 96, n - 199)) AS BIGINT), 200) AS excerpt FROM h WHERE k <= 20""")
def raw_grep_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return search.raw_excerpts(raw_lines(spark, sf), "Licensed")


HTML = "regexp_replace(replace(regexp_replace(regexp_replace(html, '<br\\s*/?>|</p>|</div>', chr(10), 'g'), '<[^>]*(>|$)', '', 'g'), '>', ''), '&nbsp;', ' ', 'g')"
for _entity, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    HTML = f"replace({HTML}, '{_entity}', '{_sign}')"


@query(f"SELECT page_id, md5(array_to_string(list_filter(list_transform(string_split({HTML}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS text_md5 FROM pages")
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(T.html_to_text(F.col("html"))).alias("text_md5"))


@query(f"SELECT doc_id, md5({FOLD.format("('ΌΛΟΙ Καλημέρα ϊΰς ' || text)")}) AS folded_md5 FROM documents")
def fold_greek_ascii(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.fold(F.concat(F.lit("ΌΛΟΙ Καλημέρα ϊΰς "), "text"))).alias("folded_md5"))


VECTOR = [((i * 37) % 19 - 9) / 10 for i in range(64)]
DOUBLES = "[" + ", ".join(f"{x}::DOUBLE" for x in VECTOR) + "]"


@query(f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {DOUBLES}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {DOUBLES}) DESC, vec_id LIMIT 12")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return semantic.top_k(table(spark, sf, "embeddings"), VECTOR, 12, tie="vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {DOUBLES}), 6) AS score FROM embeddings WHERE label = 3 ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {DOUBLES}) DESC, vec_id LIMIT 1")
def cosine_scoped(spark: SparkSession, sf: str) -> DataFrame:
    """A limit of 0 still gives one row."""
    e = table(spark, sf, "embeddings")
    return semantic.top_k(e, VECTOR, 0, tie="vec_id", allowed=e.filter("label = 3"), key="vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 6)) AS v FROM embeddings")
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.transform(semantic.l2_normalized(F.col("embedding")), lambda x: T.rounded(x)).alias("v"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0 OR label = 1")
def embedding_staleness(spark: SparkSession, sf: str) -> DataFrame:
    """The store misses each third record and holds another hash for label 1."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("session_id"), F.lit("m").alias("model_name"), F.md5(F.array_join(F.col("embedding").cast("array<string>"), ",")).alias("summary_hash"), "label")
    store = e.filter("session_id % 3 <> 0").withColumn("summary_hash", F.when(F.col("label") == 1, "old").otherwise(F.col("summary_hash")))
    return semantic.stale(e, store).select(F.col("session_id").alias("vec_id"))


@query("SELECT doc_id, source, (k - 1) // 18 AS batch, 'S' || ((k - 1) % 18 + 1) AS label FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k FROM documents)")
def batch_labels(spark: SparkSession, sf: str) -> DataFrame:
    return distill.batches(table(spark, sf, "documents").select("doc_id", "source"), [F.desc("doc_id")], by="source").select("doc_id", "source", "batch", "label")


@query("SELECT doc_id, md5(CASE WHEN length(text) <= 3000 THEN text ELSE left(text, 1200) || chr(10) || '[...snip...]' || chr(10) || right(text, 1800) END) AS windowed_md5, md5(CASE WHEN length(text) > 500 THEN left(text, 500) || '...[truncated]' ELSE text END) AS cut_md5 FROM documents")
def head_tail_window(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.head_tail_chars(F.col("text"))).alias("windowed_md5"), F.md5(T.truncate_chars(F.col("text"), 500)).alias("cut_md5"))


@query("""WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents)
SELECT doc_id, md5(CASE WHEN len(x) <= 4 THEN text ELSE array_to_string(list_concat(x[1:2], ['... (' || (len(x) - 4) || ' lines omitted) ...'], x[-2:]), chr(10)) END) AS lines_md5 FROM t""")
def head_tail_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.head_tail_lines(F.col("text"), 2, 2)).alias("lines_md5"))


@query("SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN replace(replace(text, 'tion', '[REDACTED]'), '[REDACTED]ed', 'x') ELSE text END) AS body_md5, CAST((length(text) - length(replace(text, 'tion', ''))) // 4 AS BIGINT) AS n FROM documents")
def redact_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Two ordered rules for every second document; the second one meets what the first one left."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("text").alias("body"))
    half = d.filter("id % 2 = 0")
    rules = half.select(F.lit(2).cast("long").alias("seq"), F.col("id").alias("session_id"), F.lit("[REDACTED]ed").alias("find"), F.lit("x").alias("replace"))
    rules = rules.union(half.select(F.lit(1).cast("long"), "id", F.lit("tion"), F.lit(archive.DEFAULT_REPLACEMENT)))
    return archive.redacted(d, rules).select(F.col("id").alias("doc_id"), F.md5("body").alias("body_md5"), archive.occurrences(F.col("text"), "tion").alias("n"))


SECRET_SQL = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{label}' END" for label, p in archive.SECRETS)


@query(f"SELECT doc_id, array_to_string(list_filter([{SECRET_SQL}], lambda x: x IS NOT NULL), ',') AS flags FROM documents")
def secret_flags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(archive.secret_flags(F.col("text")), ",").alias("flags"))


NORMAL = "trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH t AS (SELECT doc_id, {NORMAL.format('text')} AS n FROM documents)
SELECT doc_id, array_to_string(list_filter(['The', 'ertion', 'Of the', 'all rights', 'zz'], lambda g: CASE WHEN contains({NORMAL.format('g')}, ' ') THEN contains(n, {NORMAL.format('g')}) ELSE contains(' ' || n || ' ', ' ' || {NORMAL.format('g')} || ' ') END), ',') AS tags FROM t""")
def ground_tags(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.array(*[F.lit(t) for t in ("The", "ertion", "Of the", "all rights", "zz")])
    return table(spark, sf, "documents").select("doc_id", F.array_join(distill.grounded_tags(tags, F.col("text")), ",").alias("tags"))


@query("""WITH i AS (SELECT DISTINCT md5(CAST(doc_id AS VARCHAR)) AS id FROM documents), c AS (SELECT DISTINCT left(md5(CAST(doc_id AS VARCHAR)), CAST(6 + doc_id % 8 AS BIGINT)) AS candidate FROM documents)
SELECT candidate, min(id) AS id FROM c JOIN i ON id = candidate OR (length(candidate) >= 8 AND starts_with(id, candidate)) GROUP BY 1 HAVING count(*) = 1""")
def prefix_resolve(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    ids = d.select(F.md5(F.col("doc_id").cast("string")).alias("id"))
    cands = d.select(F.left(F.md5(F.col("doc_id").cast("string")), (6 + F.col("doc_id") % 8).cast("int")).alias("candidate"))
    return distill.resolved_prefixes(cands, ids)


@query("""WITH i AS (SELECT DISTINCT 'rollout-' || CAST(doc_id AS VARCHAR) AS id FROM documents), c AS (SELECT 'rollout-' || left(CAST(doc_id AS VARCHAR), CAST(1 + doc_id % 4 AS BIGINT)) AS candidate FROM documents UNION SELECT left('rollout-', CAST(doc_id % 9 AS BIGINT)) FROM documents),
n AS (SELECT candidate, count(*) AS n, min(id) AS id, bool_or(id = candidate) AS own FROM c JOIN i ON id = candidate OR (length(candidate) >= 8 AND starts_with(id, candidate)) GROUP BY 1)
SELECT candidate, CASE WHEN own THEN candidate ELSE id END AS id FROM n WHERE own OR n = 1""")
def prefix_resolve_common_start(spark: SparkSession, sf: str) -> DataFrame:
    """All ids start with the same eight characters, as a coding agent's do: many are starts of others, few are unique."""
    d = table(spark, sf, "documents")
    n = F.col("doc_id").cast("string")
    cands = d.select(F.concat(F.lit("rollout-"), F.left(n, (1 + F.col("doc_id") % 4).cast("int"))).alias("candidate"))
    short = d.select(F.left(F.lit("rollout-"), (F.col("doc_id") % 9).cast("int")).alias("candidate"))
    return distill.resolved_prefixes(cands.union(short), d.select(F.concat(F.lit("rollout-"), n).alias("id")))


@query("""WITH h AS (SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id + 1 END AS k FROM events),
a AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 20 MINUTE THEN 1 ELSE 0 END AS f FROM h WINDOW w AS (PARTITION BY k ORDER BY ts, event_id)),
b AS (SELECT *, CAST(sum(f) OVER (PARTITION BY k ORDER BY ts, event_id) AS BIGINT) AS island FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY k, island ORDER BY ts, event_id) - 1 AS p FROM b)
SELECT event_id, island, p // 7 AS chunk, p % 7 AS place FROM c""")
def gap_windows_hot_key(spark: SparkSession, sf: str) -> DataFrame:
    """Half of all rows have one key, which is cut into blocks of time."""
    e = table(spark, sf, "events").withColumn("k", F.when(F.col("event_id") % 2 == 0, 0).otherwise(F.col("user_id") + 1))
    return sessions.gap_windows(e, "k", "ts", "event_id", "20 minutes", 7, block_rows=1000).select("event_id", "island", "chunk", "place")


@query("SELECT event_id FROM events WHERE strftime(ts, '%Y-%m-%dT%H:%M:%S') > '2024-01-15T12'")
def watermark_incremental(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("session_timestamp"), F.date_format("ts", "yyyy-MM-dd").alias("date"))
    return archive.after_watermark(e, "2024-01-15T12").select("event_id")


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src2')")
def consent_filter(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("provider", F.col("source"))
    return archive.consented(d, ["src1", "src2", "src3"], ["src3"]).select("doc_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT event_type AS reason, count(*) AS n FROM events WHERE value < 50 GROUP BY 1")
def skip_counters(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.skip_counts(table(spark, sf, "events"), F.when(F.col("value") < 50, F.col("event_type")))


@query("SELECT count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (trim(coalesce(event_type, '')) = '') AS blank_texts FROM events")
def backup_probe(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.probe(table(spark, sf, "events"), "ts", "event_type")


TITLES = "['Éclair ', 'eclair ', 'ZEBRA ', 'zébra ', 'Ärmel ', 'apple '][1 + doc_id % 6] || doc_id % 70"
ORDERED = f"""WITH s AS (SELECT doc_id, {TITLES} AS title, strip_accents(lower(['eclair', 'eclair', 'zebra', 'zebra', 'armel', 'apple'][1 + doc_id % 6])) AS word, doc_id % 70 AS n, doc_id % 9 AS fill FROM documents),
k AS (SELECT 'title' AS sort_key, doc_id, word AS a, n AS b, 0 AS c FROM s UNION ALL SELECT 'fill', doc_id, '', fill, 0 FROM s UNION ALL SELECT 'tags', doc_id, '', CASE WHEN doc_id % 4 = 0 THEN -1 ELSE n END, 0 FROM s),
t AS (SELECT k.*, CASE WHEN sort_key = 'fill' THEN word ELSE '' END AS d, CASE WHEN sort_key = 'fill' THEN n ELSE 0 END AS e FROM k JOIN s USING (doc_id))
SELECT sort_key, 'up' AS direction, doc_id FROM t QUALIFY row_number() OVER (PARTITION BY sort_key ORDER BY a, b, d, e, doc_id) <= 150
UNION ALL SELECT sort_key, 'down', doc_id FROM t QUALIFY row_number() OVER (PARTITION BY sort_key ORDER BY a DESC, b DESC, d DESC, e DESC, doc_id DESC) <= 150"""


@query(ORDERED)
def sorted_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The first 150 rows by three keys, up and down: accents, cases, numbers in texts, ties."""
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    words = F.array(*[F.lit(w) for w in ("Éclair ", "eclair ", "ZEBRA ", "zébra ", "Ärmel ", "apple ")])
    tags = F.when(i % 4 != 0, F.array(F.concat(F.lit("v"), (i % 70).cast("string"))))
    s = d.select("doc_id", F.concat(words[(i % 6).cast("int")], (i % 70).cast("string")).alias("title"), (i % 9).cast("double").alias("fill_pct"), F.array().cast("array<string>").alias("error_tags"), tags.alias("topic_tags"), i.alias("_pos"))
    pages = [search.sorted_sessions(s, k, down).limit(150).select(F.lit(k).alias("sort_key"), F.lit("down" if down else "up").alias("direction"), "doc_id") for k in ("title", "fill", "tags") for down in (False, True)]
    return reduce(DataFrame.unionByName, pages)


@query("SELECT 'doc-' || doc_id AS id, hits FROM (SELECT doc_id, lang, (length(text) - length(replace(lower(text), 'licensed', ''))) // 8 AS hits FROM documents) WHERE hits > 0 AND lang = 'en'")
def raw_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Of the rows that are loaded, here those of one tool, those that a raw search found something in."""
    loaded = archive_sessions(spark, sf).filter("tool = 'Tool en'")
    return search.raw_scope(loaded, search.raw_groups(raw_lines(spark, sf), "Licensed")).select("id", "hits")


@query("""SELECT 'codex' AS provider, count(*) AS sessions, false AS failed FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'grok', count(DISTINCT conv_id), false FROM conversations UNION ALL SELECT 'viber', 0, true""")
def raw_session_total(spark: SparkSession, sf: str) -> DataFrame:
    """Sources read anew; one of them cannot be."""
    lines = table(spark, sf, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("line_no"), F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("user_message").alias("type"), F.lit("x").alias("message")).alias("payload"))).alias("line"))
    sources = {
        "codex": lambda: agents.session_units(agents.codex_units(lines)),
        "grok": lambda: table(spark, sf, "conversations").select("conv_id").distinct(),
        "viber": lambda: table(spark, sf, "no_such_table"),
    }
    return sweep.raw_total(sources)


@query("""WITH c AS (SELECT DISTINCT user_id AS source, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS begins, event_id % 3 AS size FROM events),
m AS (SELECT source, begins, max(size) AS size FROM c GROUP BY 1, 2), v AS (SELECT *, lead(begins) OVER (PARTITION BY source ORDER BY begins) AS ends FROM m)
SELECT source, begins AS valid_from, size FROM v WHERE begins <= 1704672000 AND (ends IS NULL OR ends > 1704672000)""")
def versions_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """A user's days as versions of a source; what held at one time."""
    from sessionlake.streaming import capture

    copies = table(spark, sf, "events").select(F.col("user_id").alias("source_path"), F.unix_seconds(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("mtime_secs"), (F.col("event_id") % 3).alias("size"))
    return capture.as_of(capture.versions(copies), 1_704_672_000).select(F.col("source_path").alias("source"), "valid_from", "size")


@query("""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {'done': CAST([] AS VARCHAR[]), 'open': x}) AS lines FROM documents),
r AS (SELECT doc_id, list_reduce(lines, lambda s, x: CASE WHEN s.open = '' THEN {'done': s.done, 'open': x.open} WHEN strlen(s.open) + 1 + strlen(x.open) <= 1000 THEN {'done': s.done, 'open': s.open || chr(10) || x.open} ELSE {'done': list_append(s.done, s.open), 'open': x.open} END) AS s FROM l),
c AS (SELECT doc_id, CASE WHEN s.open = '' THEN s.done ELSE list_append(s.done, s.open) END AS chunks FROM r)
SELECT doc_id, CAST(len(chunks) AS INTEGER) AS n_chunks, md5(array_to_string(chunks, chr(1))) AS joined_md5 FROM c""")
def chunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy chunks of whole lines, told apart by a character between them."""
    d = table(spark, sf, "documents").withColumn("chunks", distill.chunk_lines(F.col("text"), 1000))
    return d.select("doc_id", F.size("chunks").alias("n_chunks"), F.md5(F.array_join("chunks", "\x01")).alias("joined_md5"))


@query("""SELECT doc_id, lpad(lower(hex(CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), list_transform(range(0, strlen(text)), lambda i: CAST('0x' || h[2*i+1:2*i+2] AS UHUGEINT))), lambda h, b: (xor(h, b) * CAST(1099511628211 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT)) AS UBIGINT))), 16, '0') AS hash
FROM (SELECT doc_id, text, hex(encode(text)) AS h FROM documents)""")
def fnv1a(spark: SparkSession, sf: str) -> DataFrame:
    """Multiplication wraps at 64 bits."""
    return table(spark, sf, "documents").select("doc_id", T.fnv1a_hex(F.col("text")).alias("hash"))


from sessionlake import queries_backup, queries_phone, queries_sources, queries_sweep, queries_units  # noqa: E402, F401
