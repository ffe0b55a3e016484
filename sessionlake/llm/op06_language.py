"""Language identification in two steps: the family first, then one-versus-one linear SVMs between its languages.

Features are hashed byte trigrams of the whole text, square-rooted and scaled to length one. A linear SVM separates
each pair of families, then each pair of languages of the chosen family; the side that wins most duels is taken, ties
go to the larger sum of margins. The score is the product of both steps' logistic margins.

Training uses a bounded sample: about `per_language` rows of each language, drawn by a hash of the id from labelled
rows with crc32(doc_id) mod 3 not 1. Prediction is a map over all rows without a shuffle.

Defined results: `und` with score 0 for null, empty and letterless texts, and if no label was learned; a single
learned language is always predicted, with score 1; rows with a null label are predicted but not learned from; repeated
rows give a row each; an empty table gives an empty result; texts of any length are read whole; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm import hashing as hs
from sessionlake.session import ensure_checkpoint_dir

DIMENSIONS, PER_LANGUAGE, ITERATIONS = 2048, 1000, 20
UNKNOWN = "und"
#: Families of common language codes; other codes are a family of their own each.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af".split(),
    "romance": "fr es it pt ca ro gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz".split(),
    "indic": "hi mr ne bn gu pa ur".split(),
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
LETTER = regex.compile(r"\p{L}")


def fold(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % n


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of hashed trigram weights for each document of a slice."""
    low = hs.LOWER[data].astype(np.int64)
    n = len(offsets) - 1
    out = np.zeros((n, DIMENSIONS), np.float32)
    if len(low) < 3:
        return out
    code = (low[:-2] * 65599 + low[1:-1] * 257 + low[2:]) * 2654435761 >> 7 & DIMENSIONS - 1
    doc = np.searchsorted(offsets, np.arange(len(code)), side="right") - 1
    inside = np.arange(len(code)) + 3 <= offsets[doc + 1]
    counts = np.bincount(doc[inside] * DIMENSIONS + code[inside], minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
    weights = np.sqrt(counts.astype(np.float32))
    return weights / np.maximum(np.sqrt((weights**2).sum(axis=1, keepdims=True)), 1e-9)


def featurise(rows: DataFrame) -> DataFrame:
    """(label, features) of (label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in hs.text_slices(batch.column(1)):
                x = features(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(x)), pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float64).ravel()), DIMENSIONS).cast(pa.list_(pa.float64()))],
                    names=["label", "features"],
                )

    return rows.mapInArrow(run, "label string, features array<double>")


class Duels:
    """One-versus-one linear models between names."""

    def __init__(self, names: list[str]):
        self.names, self.pairs = sorted(names), []

    def fit(self, rows: DataFrame, column: str) -> Duels:
        for a, b in itertools.combinations(self.names, 2):
            pair = rows.filter(F.col(column).isin(a, b)).select((F.col(column) == b).cast("double").alias("y"), "features")
            model = LinearSVC(labelCol="y", maxIter=ITERATIONS, regParam=1e-4, standardization=False).fit(pair)
            self.pairs.append((self.names.index(a), self.names.index(b), model.coefficients.toArray().astype(np.float32), float(model.intercept)))
        return self

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner of each row and the logistic of its narrowest duel."""
        wins, sums, least = (np.zeros((len(x), len(self.names))) for _ in range(3))
        least += 50.0
        for a, b, w, c in self.pairs:
            m = x @ w + c
            for side, margin in ((a, -m), (b, m)):
                wins[:, side] += margin > 0
                sums[:, side] += margin
                least[:, side] = np.minimum(least[:, side], margin)
        best = np.lexsort((sums, wins), axis=1)[:, -1] if len(self.names) > 1 else np.zeros(len(x), int)
        return best, 1 / (1 + np.exp(-2 * least[np.arange(len(x)), best].clip(-30, 30)))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[Duels, dict[str, Duels]]:
    ensure_checkpoint_dir(docs.sparkSession)
    known = docs.filter((fold(id_col, 3) != 1) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    counts = {r["lang"]: r["count"] for r in known.groupBy(F.col(lang_col).alias("lang")).count().collect()}
    if not counts:
        return Duels([]), {}
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000)) / 1_000_000
    share = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(min(1.0, per_language / v))) for k, v in counts.items()))
    sample = featurise(known.filter(draw < share[F.col(lang_col)]).select(F.col(lang_col).alias("label"), F.col(text_col).alias("text")))
    family = {c: FAMILY.get(c, c) for c in counts}
    family_of = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(v)) for k, v in family.items()))
    rows = sample.repartition(8).select("label", family_of[F.col("label")].alias("family"), array_to_vector("features").alias("features")).checkpoint()
    first = Duels(sorted(set(family.values()))).fit(rows, "family")
    return first, {f: Duels([c for c in counts if family[c] == f]).fit(rows, "label") for f in first.names}


def predict(docs: DataFrame, models: tuple[Duels, dict[str, Duels]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    families, languages = models

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in hs.text_slices(batch.column(1)):
                x = features(data, offsets)
                name, score = np.full(len(x), UNKNOWN, dtype=object), np.zeros(len(x))
                if families.names:
                    family, sure = families.decide(x)
                    for k, f in enumerate(families.names):
                        rows = np.flatnonzero(family == k)
                        if len(rows):
                            language, also = languages[f].decide(x[rows])
                            name[rows], score[rows] = np.array(languages[f].names, dtype=object)[language], sure[rows] * also
                texts = batch.column(1).slice(row, len(x))
                for k, text in enumerate(texts):
                    if LETTER.search(text.as_py() or "") is None:
                        name[k], score[k] = UNKNOWN, 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(x)), pa.array(name, pa.string()), pa.array(score.clip(0, 1))], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): trained on two thirds of the ids, predicted for all."""
    found = predict(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
