"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a seed lexicon and of a lexicon learned from the training labels, hits that show
only after undoing look-alike characters, lexicon hits near second-person words, rates of capitals, shouted words,
exclamation marks and other punctuation, obfuscated words and stretched letters, and the text's length.

Labels are learned only from rows with crc32(doc_id) mod 5 not 0: remainder 1 calibrates, 2 to 4 train. Training uses
a bounded sample of about `max_rows` labelled rows, drawn by a hash of the id. Scoring is a map over all rows.

Defined results: null is an empty text; every row gets a score, empty texts that of an all-zero feature row; without
both labels among the training rows the score is the share of label 1 (0 without labels). Several labels of one
doc_id count as toxic if any is. Repeated rows give a row each; a null doc_id is never held out nor learned from; an
empty table gives an empty result; texts of any length are read whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm import hashing as hs
from sessionlake.llm.op06_language import fold
from sessionlake.llm.op08_decontaminate import plain_words
from sessionlake.session import ensure_checkpoint_dir

MAX_ROWS, LEXICON, MIN_DOCS, MIN_Z = 30_000, 300, 5, 4.0
TREES, DEPTH = 20, 3
NEAR = 5
#: A seed lexicon and second-person words of the four languages.
SEED = """idiot moron stupid dumb fool clown loser trash garbage worthless pathetic disgusting scum ugly hate
dumm dreck trottel abschaum connard imbécile débile ordure estúpido imbécil basura asqueroso""".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta vous votre tú ti usted vosotros".split()
#: Look-alike characters and the letters that they stand for.
LOOKALIKES = dict(zip("013457@$", "oieastas", strict=True))
NAMES = "seed learned hidden near_you capitals shouted exclaims marks mixed stretched log_words".split()


def hashed(words: list[str]) -> np.ndarray:
    found = [plain_words(data, offsets)[0] for _, data, offsets in hs.text_slices(pa.array(words, pa.large_string()))]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, hs.U)


UNDONE = np.arange(256, dtype=np.uint8)
for _sign, _letter in LOOKALIKES.items():
    UNDONE[ord(_sign)] = ord(_letter)


def member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def features(data: np.ndarray, offsets: np.ndarray, seed: np.ndarray, learned: np.ndarray, you: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    words, bounds = plain_words(data, offsets)
    plain, plain_bounds = plain_words(UNDONE[data], offsets)

    def per_doc(flag: np.ndarray, cut: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flag)])[cut]).astype(float)

    in_seed, in_learned = member(words, seed), member(words, learned)
    hidden = np.maximum(per_doc(member(plain, seed) | member(plain, learned), plain_bounds) - per_doc(in_seed | in_learned, bounds), 0)
    hits, told = np.flatnonzero(in_seed | in_learned), np.flatnonzero(member(words, you))
    near = np.zeros(len(words), bool)
    if len(hits) and len(told):
        doc = np.searchsorted(bounds, np.arange(len(words)), side="right") - 1
        right = np.minimum(np.searchsorted(told, hits), len(told) - 1)
        for side in (right, np.maximum(right - 1, 0)):
            near[hits] |= (np.abs(told[side] - hits) <= NEAR) & (doc[told[side]] == doc[hits])
    upper, lower, digit = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122), (data >= 48) & (data <= 57)
    letter, space = upper | lower | (data >= 128), hs.SPACE[data]
    odd = ~letter & ~space
    inner, mixed, stretched, shouted = (np.zeros(len(data), bool) for _ in range(4))
    if len(data) > 2:
        inner[1:-1] = letter[:-2] & letter[2:]
        mixed = inner & (odd | digit) & (data != 39) & (data != 45)
        stretched[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
        shouted[2:] = upper[2:] & upper[1:-1] & upper[:-2]
        begins, ends = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0]
        mixed[begins] = mixed[ends - 1] = False  # what stands beside a text's end is another text
        for k in (begins, np.minimum(begins + 1, len(data) - 1)):
            stretched[k] = shouted[k] = False
    n_words = np.maximum(np.diff(bounds), 1)
    n_bytes = np.maximum(np.diff(offsets), 1)
    rates = [per_doc(x, offsets) / n_bytes for x in (upper, shouted, data == 33, odd & (data != 33), mixed, stretched)]
    out = [per_doc(in_seed, bounds) / n_words, per_doc(in_learned, bounds) / n_words, hidden / n_words, per_doc(near, bounds) / n_words]
    return np.stack([*out, *rates, np.log1p(np.diff(bounds))], axis=1) if n else np.zeros((0, len(NAMES)))


def lexicon(rows: DataFrame, size: int = LEXICON, min_docs: int = MIN_DOCS, min_z: float = MIN_Z) -> np.ndarray:
    """Hashes of the words that mark label 1 most surely, by the z-score of their share of toxic documents; (y, text) in."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.asarray(batch.column(0))
            for row, data, offsets in hs.text_slices(batch.column(1)):
                words, bounds = plain_words(data, offsets)
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                order = np.lexsort((doc, words))
                words, doc = words[order], doc[order]
                new = np.ones(len(words), bool)
                new[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
                words, toxic = words[new], y[row + doc[new]]
                known, inverse = np.unique(words, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(np.bincount(inverse, minlength=len(known)).astype(np.int64)), pa.array(np.bincount(inverse, weights=toxic, minlength=len(known)).astype(np.int64))], names=["word", "docs", "toxic"])

    rate = rows.agg(F.avg("y")).first()[0]
    expected = F.col("docs") * rate
    z = (F.col("toxic") - expected) / F.sqrt(expected * (1 - rate) + 1e-9)
    counts = rows.mapInArrow(count, "word long, docs long, toxic long").groupBy("word").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    top = counts.filter((F.col("docs") >= min_docs) & (z >= min_z)).orderBy(z.desc(), "word").limit(size).collect()
    return np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64))


def featurise(rows: DataFrame, learned: np.ndarray) -> DataFrame:
    """(key, features) of (key, text)."""
    seed, you = hashed(SEED), hashed(SECOND_PERSON)
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in hs.text_slices(batch.column(1)):
                x = features(data, offsets, seed, learned, you)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(x)), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))], names=["key", "features"])

    return rows.mapInArrow(run, f"key {kind}, features array<double>")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    ensure_checkpoint_dir(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("double").alias("y"))
    marks = marks.filter(fold("doc_id", 5) != 0)
    share = max_rows / max(1, marks.count())
    chosen = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    known = texts.join(F.broadcast(chosen), "doc_id").select("y", "text", (fold("doc_id", 5) == 1).alias("calibrates")).repartition(12).checkpoint()
    held = (fold("doc_id", 5) == 0).alias("held_out")
    balance = {(r["calibrates"], r["y"]): r["count"] for r in known.groupBy("calibrates", "y").count().collect()}
    if any(balance.get((c, y), 0) == 0 for c in (False, True) for y in (0.0, 1.0)):
        rate = sum(v for (_, y), v in balance.items() if y) / max(1, sum(balance.values()))
        return texts.select("doc_id", held, F.lit(float(rate)).alias("score"), F.lit(int(rate >= 0.5)).alias("predicted"))
    learned = lexicon(known.filter("NOT calibrates").select("y", "text"))
    keyed = known.select(F.when(F.col("calibrates"), F.col("y") + 2).otherwise(F.col("y")).alias("key"), "text")
    rows = featurise(keyed, learned).select("key", array_to_vector("features").alias("features")).checkpoint()
    trees = GBTClassifier(labelCol="key", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, maxBins=32).fit(rows.filter("key < 2"))
    chance = vector_to_array("probability")[1]
    calibration = trees.transform(rows.filter("key >= 2")).select((F.col("key") - 2).alias("label"), chance.alias("chance"))
    curve = IsotonicRegression(featuresCol="chance").fit(calibration)
    x, y = curve.boundaries.toArray(), curve.predictions.toArray()
    scored = trees.transform(featurise(texts, learned).select("key", array_to_vector("features").alias("features")))
    return calibrate(scored.select(F.col("key").alias("doc_id"), chance.alias("chance")), x, y).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def calibrate(scored: DataFrame, x: np.ndarray, y: np.ndarray) -> DataFrame:
    """score by linear interpolation on the isotonic curve, which is a step function of few boundaries."""

    @F.pandas_udf("double")
    def curve(chance: pd.Series) -> pd.Series:
        return pd.Series(np.interp(chance.to_numpy(), x, y).clip(0, 1))

    return scored.withColumn("score", curve("chance"))
