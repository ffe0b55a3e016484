"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and word pairs of each text are hashed into `buckets` counts. Two bag models with add-one smoothing, one of the
target documents and one of all, give a document's importance log p_target - log p_raw, the sum over its n-grams. The
sample of k documents without replacement, in proportion to importance, is the k largest sums of log importance and
Gumbel noise; the noise depends on the seed and the id alone.

The models are counts over all documents, one array for each task and summed by bucket: their size is fixed. The k-th
key is found by a quantile band and an exact order within it, so no task sorts all keys.

Defined results: texts without words have a null log_weight and are never selected; repeated rows are rows of their
own; ties of keys go to the smaller doc_id, then to all equal rows; an empty table gives an empty result, and an empty target
a model of equal counts; texts of any length are read whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm import hashing as hs
from sessionlake.session import ensure_checkpoint_dir

BUCKETS, FRACTION, SEED = 10_000, 0.5, 17
BROADCAST_ROWS = 500_000


def grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of all words and word pairs of a slice."""
    low = hs.LOWER[data]
    starts, ends, bounds = hs.words(low, offsets)
    words = hs.word_hashes(low, starts, ends)
    pairs, _, at = hs.windows(words, bounds, 2)
    n = len(bounds) - 1
    doc = np.concatenate([np.repeat(np.arange(n), np.diff(bounds)), np.repeat(np.arange(n), np.diff(at))])
    return doc, (np.concatenate([words, pairs]) % hs.U(buckets)).astype(np.int64)


def models(rows: DataFrame, buckets: int) -> np.ndarray:
    """log p_target - log p_raw of each bucket; (is_target, text) in."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            wanted = np.asarray(batch.column(0).cast(pa.int8()))
            for row, data, offsets in hs.text_slices(batch.column(1)):
                doc, bucket = grams(data, offsets, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[wanted[row + doc] > 0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(target), pa.array(raw)], names=["bucket", "target", "raw"])

    sums = rows.mapInArrow(count, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    counts = np.zeros((buckets, 2))
    for r in sums.collect():  # `buckets` rows
        counts[r["bucket"]] = r["target"], r["raw"]
    p = np.log(counts + 1) - np.log(counts.sum(axis=0) + buckets)
    return p[:, 0] - p[:, 1]


def kth_largest(keys: DataFrame, k: int, band: float = 0.002) -> tuple[float, int]:
    """(key, doc_id) of the k-th row by key downwards, then doc_id."""
    n = keys.count()
    while True:
        lo, hi = keys.approxQuantile("key", [max(0.0, 1 - k / n - band), min(1.0, 1 - k / n + band)], band / 4)
        above, inside = keys.agg(F.count_if(F.col("key") > hi), F.count_if(F.col("key").between(lo, hi))).first()
        if above < k <= above + inside:
            break
        band *= 4
        if band > 1:
            lo, hi, above = float("-inf"), float("inf"), 0
            break
    last = keys.filter(F.col("key").between(lo, hi)).orderBy(F.desc("key"), "doc_id").limit(k - above)
    key, doc_id = last.orderBy("key", F.desc("doc_id")).select("key", "doc_id").first()
    return key, doc_id


def resample(
    docs: DataFrame, target: DataFrame, fraction: float = FRACTION, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, log_weight, key, selected) for every row of docs; target holds the ids of target documents."""
    ensure_checkpoint_dir(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = target.select(F.col(id_col).cast("long").alias("doc_id")).distinct().withColumn("is_target", F.lit(True))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    ratio = models(texts.join(wanted, "doc_id", "left").select(F.coalesce("is_target", F.lit(False)), "text"), buckets)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in hs.text_slices(batch.column(1)):
                n = len(offsets) - 1
                doc, bucket = grams(data, offsets, buckets)
                weight, size = np.bincount(doc, weights=ratio[bucket], minlength=n), np.bincount(doc, minlength=n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(weight, mask=size == 0)], names=["doc_id", "log_weight"])

    uniform = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2**53)) + 0.5) / float(2**53)
    keyed = texts.mapInArrow(weigh, "doc_id long, log_weight double").withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))).checkpoint()
    some = keyed.filter("key IS NOT NULL")
    k = round(some.count() * fraction)
    if not k:
        return keyed.withColumn("selected", F.lit(False))
    key, doc_id = kth_largest(some, k)
    chosen = (F.col("key") > key) | (F.col("key") == key) & (F.col("doc_id") <= doc_id)
    return keyed.withColumn("selected", F.coalesce(chosen, F.lit(False)))
