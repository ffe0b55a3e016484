"""The registered queries of the corpus operators, with DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm import op01_quotes, op02_bpe, op03_toxicity, op04_anchors, op05_quality, op06_language, op07_suffix, op08_decontaminate, op09_rules, op10_jaccard, op11_collocations, op12_middle, op13_packing
from sessionlake.session import table

VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_quotes.conversations(table(spark, sf_dir, "conversations"))


def conversations_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 1 is for: conversations without quotes, in reply order; a row for each part, with a digest of its messages."""
    parts = op01_quotes.assembled(table(spark, sf_dir, "conversations"))
    return parts.select("conv_id", "part", "n_messages", F.md5(F.to_json("conversation")).alias("conversation_md5"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_bpe.encode(table(spark, sf_dir, "documents"), vocabulary_path())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_anchors.kept_words(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return op05_quality.resample(table(spark, sf_dir, "documents"), good)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_language.identify(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_suffix.spans(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_failed_lines lost_chars".split()
    return op09_rules.assess(table(spark, sf_dir, "documents")).select(*cols)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_jaccard.classes(table(spark, sf_dir, "documents"))


def op11_collocations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_collocations.collocations(table(spark, sf_dir, "documents"))


def op12_middle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_middle.digests(table(spark, sf_dir, "documents"))


def op13_packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_packing.digests(table(spark, sf_dir, "documents"), vocabulary_path(BYTE_VOCABULARY))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_quotes": op1_quotes, "conversations_assembled": conversations_assembled, "op2_bpe": op2_bpe, "op3_toxicity": op3_toxicity, "op4_anchors": op4_anchors, "op5_quality": op5_quality, "op6_language": op6_language, "op7_suffix": op7_suffix_dedup, "op8_decontaminate": op8_decontaminate, "op9_rules": op9_rules, "op10_jaccard": op10_jaccard_join, "op11_collocations": op11_collocations_query, "op12_middle": op12_middle_query, "op13_packing": op13_packing_query}

RULES_SQL = r"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM base),
judged AS (
  SELECT rid, line, length(translate(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '')) AS glyphs,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    length(line) - length(translate(line, '|»›•·', '')) AS n_sep,
    length(line) - length(translate(line, '#*$%&|<>', '')) AS n_sym,
    length(line) - length(replace(line, '!', '')) AS n_loud FROM lines),
failing AS (
  SELECT *, n > 0 AND ((n < 4 AND NOT regexp_matches(line, '[.!?:;…。！？][''"»”’)\]]*[\x20\x09-\x0D]*$'))
      OR NOT regexp_matches(line, '[\p{L}\p{N}]') OR (n_sep >= 3 AND n_sep * 4 >= n) OR (n_sym >= 6 AND n_sym > n)
      OR (n_loud >= 6 AND n_loud * 2 > n) OR (n <= 30 AND (@boilerplate@))) AS failed FROM judged),
by_line AS (
  SELECT rid, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
    count(*) FILTER (failed) AS n_failed_lines, coalesce(sum(glyphs) FILTER (failed), 0) AS lost_chars FROM failing GROUP BY rid),
tokens AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM base),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM tokens),
triples AS (SELECT rid, i, word || chr(10) || lead(word, 1) OVER p || chr(10) || lead(word, 2) OVER p AS t FROM words WINDOW p AS (PARTITION BY rid ORDER BY i)),
repeats AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM triples WHERE t IS NOT NULL) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + d) AS n_repeat_words FROM repeats, (VALUES (0), (1), (2)) AS o(d) GROUP BY rid),
counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(translate(text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(n_failed_lines AS BIGINT) AS n_failed_lines, CAST(lost_chars AS BIGINT) AS lost_chars
  FROM base JOIN tokens USING (rid) JOIN by_line USING (rid) LEFT JOIN covered USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 40 * word_chars AS kept,
  n_failed_lines, lost_chars FROM counts
""".replace("@boilerplate@", " OR ".join("contains(lower(line), '{}')".format(p.replace("'", "''")) for phrases in op09_rules.BOILERPLATE.values() for p in phrases))

ORACLE: dict[str, str] = {"op9_rules": RULES_SQL}

JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM shingles),
flat AS (SELECT doc_id, unnest(s) AS x FROM shingles),
common AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS c FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT p, q FROM common JOIN sizes a ON a.doc_id = p JOIN sizes b ON b.doc_id = q WHERE 100 * c >= 75 * (a.n + b.n - c)),
both_ways AS (SELECT p, q FROM linked UNION SELECT q, p FROM linked),
reach AS (SELECT doc_id, doc_id AS r FROM sizes UNION SELECT reach.doc_id, q FROM reach JOIN both_ways ON p = r)
SELECT doc_id, n AS n_shingles, CAST(min(r) AS BIGINT) AS component_id FROM reach JOIN sizes USING (doc_id) GROUP BY ALL
"""
ORACLE["op10_jaccard"] = JACCARD_SQL

ANCHORS_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
chunks AS (SELECT doc_id, len(w) AS n, c, w[c*200+1:c*200+249] AS part FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 199) // 200)) AS c FROM texts)),
windows AS (SELECT doc_id, c * 200 + k AS i, part[k] AS word, CASE WHEN c * 200 + k + 49 <= n THEN md5(array_to_string(part[k:k+49], ' ')) END AS h FROM (SELECT *, unnest(range(1, least(200, len(part)) + 1)) AS k FROM chunks)),
first AS (SELECT h, min(doc_id) AS f FROM windows WHERE h IS NOT NULL GROUP BY 1),
marked AS (SELECT doc_id, i, word, coalesce(f < doc_id, false) AS r FROM windows LEFT JOIN first USING (h)),
covered AS (SELECT doc_id, i, word, max(r) OVER (PARTITION BY doc_id ORDER BY i ROWS 49 PRECEDING) AS gone FROM marked),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM covered GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (doc_id)
"""

SUFFIX_SQL = r"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
chunks AS (SELECT doc_id, len(x) // 2 AS n, c, x[c*1000+1:c*1000+1198] AS part FROM (SELECT doc_id, x, unnest(range(0, (len(x) + 999) // 1000)) AS c FROM texts)),
strings AS (SELECT doc_id, c * 500 + k AS i, part[2*k+1:2*k+2] AS b, CASE WHEN c * 500 + k + 100 <= n THEN md5(part[2*k+1:2*k+200]) END AS h FROM (SELECT *, unnest(range(0, least(500, len(part) // 2))) AS k FROM chunks)),
first AS (SELECT h, min({'d': doc_id, 'i': i}) AS f FROM strings WHERE h IS NOT NULL GROUP BY 1),
marked AS (SELECT doc_id, i, b, coalesce(f < {'d': doc_id, 'i': i}, false) AS r FROM strings LEFT JOIN first USING (h)),
covered AS (SELECT doc_id, i, b, max(r) OVER (PARTITION BY doc_id ORDER BY i ROWS 99 PRECEDING) AS gone FROM marked),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM covered),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS t FROM runs GROUP BY 1)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256 FROM texts LEFT JOIN kept USING (doc_id)
"""
ORACLE |= {"op4_anchors": ANCHORS_SQL, "op7_suffix": SUFFIX_SQL}

COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i+m-1], ' '))) AS phrase FROM pieces, (VALUES (1), (2), (3), (4)) AS t(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL),
words AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND a >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.a AS l, r.a AS r, (CAST(2000000 AS HUGEINT) * c.a) // (l.a + r.a) AS score FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k+1:c.m], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, a, unnest(list_concat(list_transform(range(1, m), lambda i: array_to_string(w[i:i+1], ' ')), CASE WHEN m = 4 THEN list_transform(range(1, m - 1), lambda i: array_to_string(w[i:i+2], ' ')) ELSE [] END)) AS phrase
  FROM candidates WHERE m > 2),
longest AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longest USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN words USING (lang) WHERE rank <= 2000
"""

MIDDLE_SQL = r"""
WITH drawn AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (
  SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM drawn),
cut AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a+1:b], '') AS m, array_to_string(u[b+1:n], '') AS s FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts
"""
ORACLE |= {"op11_collocations": COLLOCATIONS_SQL, "op12_middle": MIDDLE_SQL}
