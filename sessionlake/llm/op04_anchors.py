"""Substring dedup with fixed-block anchors: removes words of 50-word windows that a smaller doc_id also has.

Every document is cut into blocks of 25 words that do not overlap; any 50 words hold a whole block. The blocks are the
index. Every rolling window of 25 words of every document probes it. A hit on a block of a smaller document, and a
block that a larger document hits, are anchors; only 50-word windows around anchors can be in two documents.
What a hit is extended to is not found by comparing it, word by word, with the text around the block that it hit: a
passage that stands in many contexts would need that comparison for each of them. Instead every 50-word window around an
anchor (26 of them, from the one that ends with the anchor to the one that begins with it) is hashed as a whole and looked
up among those around all other documents' anchors. The union of the windows that are found is what the extensions would
have reached: the maximal exact repeats of 50 words or more.

Blocks and probes meet in buckets of hashes, as windows do. A slice of documents settles what it can by itself and
sends the rest, so a hot passage costs a few entries for each slice; no pairs of documents are made at any step. Probes
are compared by a part of their hash, which only makes anchors in vain; windows by 128 bits: the hash of their words
and one of their two halves' hashes. Buckets grow in number with the text's bytes.

Defined results: null is an empty text; a document of under 50 words loses nothing; rows with an equal doc_id are one
document (none is smaller), and so are rows without one, after all others; words are kept unchanged and joined by one
space; repeated rows get equal results; an empty table gives an empty result; texts of any length are read whole; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm import first_seen as fs
from sessionlake.llm import hashing as hs
from sessionlake.session import ensure_checkpoint_dir, settled, shards

WINDOW = 50
FOUND = 1
#: Bytes of a probe's hash that are sent. A chance meeting there only makes an anchor that the windows' full hashes
#: refute; six bytes suit corpora of over 10**11 words.
PROBE_BYTES = 5
#: Bytes of text for each bucket.
BUCKET_BYTES = 3_500_000


def probes(data: np.ndarray, offsets: np.ndarray, more: list, block: int) -> fs.Entries:
    """All rolling windows of a block's length; those at multiples of it are the blocks."""
    starts, ends, bounds = hs.words(data, offsets)
    key, first, at = hs.windows(hs.word_hashes(data, starts, ends), bounds, block)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(at))
    return fs.Entries(doc, first - bounds[doc], key)


def extremes(e: fs.Entries, ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each entry: whether it is a block, and its key's smallest document with a block and largest document."""
    is_block = e.at.astype(np.int64) % block == 0
    order = np.argsort(e.key)
    starts = np.flatnonzero(fs.is_first(order, e.key))
    group = np.cumsum(fs.is_first(order, e.key)) - 1
    least = np.minimum.reduceat(np.where(is_block, ids, np.iinfo(np.int64).max)[order], starts)
    most = np.maximum.reduceat(ids[order], starts)
    low, high = np.empty(len(e), np.int64), np.empty(len(e), np.int64)
    low[order], high[order] = least[group], most[group]
    return is_block, low, high, order


def settle_anchors(e: fs.Entries, ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    own = ids[e.doc]
    is_block, low, high, order = extremes(e, own, block)
    known = (low < own) | (is_block & (high > own))
    once = np.zeros(len(e), bool)  # of the smallest block and the largest probe of each key one goes on for the others
    for best in (is_block & (own == low), own == high):
        pick = order[best[order]]
        once[pick[fs.is_first(pick, e.key)]] = True
    return known.astype(np.uint8), ~known | once


def resolve_anchors(e: fs.Entries, block: int) -> np.ndarray:
    is_block, low, high, _ = extremes(e, e.doc, block)
    return ((low < e.doc) | (is_block & (high > e.doc))).astype(np.uint8)


def around(data: np.ndarray, offsets: np.ndarray, more: list, window: int, block: int) -> fs.Entries:
    """The whole windows that hold an anchor."""
    starts, ends, bounds = hs.words(data, offsets)
    hashes = hs.word_hashes(data, starts, ends)
    key, first, at = hs.windows(hashes, bounds, window)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(at))
    place = first - bounds[doc]
    near = np.zeros(len(starts) + 1, np.int32)
    for k, anchors in enumerate(more[0]):
        i = bounds[k] + np.frombuffer(anchors, np.uint32).astype(np.int64)
        np.add.at(near, np.maximum(i - (window - block), bounds[k]), 1)
        np.add.at(near, i + 1, -1)
    pick = np.cumsum(near)[first] > 0
    first, sums = first[pick], hs.prefix_sums(hashes)
    halves = hs.mix(hs.runs(sums, first, first + block) + hs.mix(hs.runs(sums, first + block, first + window)))
    return fs.Entries(doc[pick], place[pick], key[pick], halves)


def settle_windows(e: fs.Entries, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that a smaller document has; of the smallest document's one goes on."""
    own = ids[e.doc]
    order = np.lexsort((own, e.tag, e.key))
    first = fs.is_first(order, e.key, e.tag)
    status, send = np.zeros(len(e), np.uint8), np.zeros(len(e), bool)
    least = own[order[fs.spread(first)]]
    status[order[own[order] > least]] = FOUND
    send[order[own[order] == least]] = True
    return status, send


def resolve_windows(e: fs.Entries) -> np.ndarray:
    return settle_windows(fs.Entries(np.arange(len(e)), e.at, e.key, e.tag), e.doc)[0]


def flags(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, no_id, text_hash, windows): u32 first words of the windows that a smaller document has."""
    ensure_checkpoint_dir(docs.sparkSession)
    buckets, block = shards(docs, "text", BUCKET_BYTES), window // 2
    anchors = settled(fs.verdicts(docs, functools.partial(probes, block=block), functools.partial(settle_anchors, block=block), functools.partial(resolve_anchors, block=block), buckets, key_bytes=PROBE_BYTES))
    chosen = docs.join(anchors, fs.NAMES).select(*fs.NAMES, "text", "at").dropDuplicates(fs.NAMES)
    found = settled(fs.verdicts(chosen, functools.partial(around, window=window, block=block), settle_windows, resolve_windows, buckets))
    return found.select(*fs.NAMES, F.col("at").alias("windows"))


def kept_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of docs; with_text adds the kept text."""
    texts = fs.prepared(docs, id_col, text_col)
    marked = texts.join(flags(texts, window), fs.NAMES, "left").select(fs.given_id(), "text", "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
        for batch in batches:
            out = []
            for doc_id, text, windows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = kept = text.encode().split()  # bytes.split() splits at \x20\x09-\x0D
                if windows:
                    change = np.zeros(len(words) + 1, np.int32)
                    at = np.frombuffer(windows, np.uint32).astype(np.int64)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + window, -1)
                    kept = [words[k] for k in np.flatnonzero(np.cumsum(change)[:-1] == 0)]
                joined = b" ".join(kept)
                out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest()) + ((joined.decode(),) if with_text else ()))
            types = [pa.int64()] * 3 + [pa.string()] * (1 + with_text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
