"""Suffix-array dedup by prefix-free parsing: removes bytes of 100-byte strings that the corpus had before.

A rolling hash of `TRIGGER` bytes marks places that depend on those bytes alone, so equal text is cut alike wherever
it stands. The text between two marks, with the bytes that strings starting there can reach, is a phrase. The
dictionary of phrases and the parse stand for all suffixes.

1. Dictionary and parse. Sorting the parse by (mark, phrase, document, place) brings equal phrases together: of each
   phrase all occurrences but the first only start strings that were there before, and the first one is the
   dictionary's. A string without a mark is a phrase of its own. Phrases whose mark is met once hold no repeat.
2. Suffix arrays. Where a mark has several phrases, their strings may still be equal in part. The dictionary's phrases
   are sorted twice for each mark: by what follows it (the order of the parse's suffixes that begin with the mark, as
   far as 100-byte strings reach) and by what stands before it, read backwards (the order of the phrases' own
   suffixes), with the lengths of the prefixes that neighbours share. A string that starts d bytes before the mark is
   equal in two phrases if they share d bytes to the left and 100 - d to the right: the two arrays' runs at those
   depths combine into the strings' places in corpus order. Here bytes are compared, not hashes.
3. A mark with more than MANY phrases, such as one near the end of a passage that a third of all documents share, would
   be one task's group. Its strings are spread by their own hashes instead, each slice sending a string once.
4. All strings that occur earlier, by document and place, are removed, and their maximal runs counted.

Buckets grow in number with the text's bytes. Phrases are equal if their 64-bit hashes and those of their marks are;
strings in step 3 are compared by 128 bits.

Defined results: null is an empty text; texts under 100 bytes lose nothing; rows with equal doc_id and text get equal
results; null ids are one id after all others; an empty table gives an empty result; texts of any length are read
whole; other columns, whatever their names, are ignored by `spans` and kept by `dedup`, which decodes what is left and
drops cut characters.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm import first_seen as fs
from sessionlake.llm import hashing as hs
from sessionlake.session import ensure_checkpoint_dir, settled, shards

LENGTH, TRIGGER, EVERY = 100, 24, 16
#: States of a phrase: it was there before; its mark has several phrases, or more than MANY; it is met again as it is.
LATER, EDGE, REPEATED, HOT = 1, 2, 3, 4
#: Phrases of one mark that a task sorts; any number gives the same result.
MANY = 4096
#: Bytes of text for each bucket.
BUCKET_BYTES = 8_000_000


def phrases(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, first start, last start, mark, sums) of the phrases that start strings of `length` bytes, in text order."""
    sums = hs.prefix_sums(hs.BYTE_VALUES[data])
    n = len(data)
    start_of, end_of = offsets[:-1], offsets[1:]
    place = np.arange(max(n - TRIGGER + 1, 0))
    marks = np.flatnonzero((hs.runs(sums, place, place + TRIGGER) >> hs.U(17)) % hs.U(EVERY) == 0)
    doc = np.searchsorted(offsets, marks, side="right") - 1
    inside = (marks + TRIGGER <= end_of[doc]) & (end_of[doc] - start_of[doc] >= length) if len(marks) else np.zeros(0, bool)
    marks, doc = marks[inside], doc[inside]
    before = np.concatenate([[-1], marks[:-1]])
    before = np.where(np.concatenate([[-1], doc[:-1]]) == doc, before, -1)
    lo = np.maximum(np.maximum(before + 1, marks - (length - TRIGGER)), start_of[doc])
    hi = np.minimum(marks, end_of[doc] - length)
    some = lo <= hi  # else no string starts there, but the mark counts as seen
    bare = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(end_of - start_of >= length)
    np.add.at(bare, start_of[long], 1)
    np.add.at(bare, end_of[long] - length + 1, -1)
    np.add.at(bare, lo[some], -1)
    np.add.at(bare, hi[some] + 1, 1)
    alone = np.flatnonzero(np.cumsum(bare)[:n] > 0)
    lo, hi, mark = np.concatenate([lo, alone]), np.concatenate([hi, alone]), np.concatenate([marks, np.full(len(alone), -1)])
    doc = np.concatenate([doc, np.searchsorted(offsets, alone, side="right") - 1])
    order = np.argsort(lo, kind="stable")
    return doc[order], lo[order], hi[order], mark[order], sums


def ordinals(doc: np.ndarray, n: int) -> np.ndarray:
    return np.arange(len(doc)) - np.searchsorted(doc, np.arange(n))[doc]


def parse(data: np.ndarray, offsets: np.ndarray, more: list, length: int) -> fs.Entries:
    doc, lo, hi, mark, sums = phrases(data, offsets, length)
    tag = hs.mix(hs.runs(sums, lo, hi + length) + hs.mix((hi - lo).astype(hs.U) << hs.U(32) | np.where(mark < 0, 1 << 20, mark - lo).astype(hs.U)))
    key = np.where(mark < 0, tag, hs.runs(sums, np.maximum(mark, 0), np.where(mark < 0, 0, mark + TRIGGER)))
    return fs.Entries(doc, ordinals(doc, len(offsets) - 1), key, tag)


def settle_phrases(e: fs.Entries, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal phrases in a slice only the first is sent; an odd tag says that its mark was met again in the slice."""
    own = ids[e.doc]
    order = np.lexsort((e.at, own, e.tag, e.key))
    first = fs.is_first(order, e.key, e.tag)
    head = order[fs.spread(first)]
    later = (own[order] > own[head]) | (own[order] == own[head]) & (e.at[order] > e.at[head])
    status, send = np.zeros(len(e), np.uint8), np.zeros(len(e), bool)
    status[order[later]] = LATER
    send[order[first]] = True
    group = np.cumsum(fs.is_first(order, e.key))
    many = np.bincount(group)[group] > 1
    tag = e.tag & ~hs.U(1)
    tag[order[many]] |= hs.U(1)
    e.tag = tag
    return status, send


def resolve_phrases(e: fs.Entries, many_phrases: int) -> np.ndarray:
    many, tag = (e.tag & hs.U(1)).astype(bool), e.tag >> hs.U(1)
    order = np.lexsort((e.at, e.doc, tag, e.key))
    new_key, new_tag = fs.is_first(order, e.key), fs.is_first(order, e.key, tag)
    head = order[fs.spread(new_tag)]
    later = (e.doc[order] > e.doc[head]) | (e.doc[order] == e.doc[head]) & (e.at[order] > e.at[head])
    group = np.cumsum(new_key) - 1
    tags = np.bincount(group, weights=new_tag)[group]
    seen = (np.bincount(group)[group] > 1) | (np.bincount(group, weights=many[order])[group] > 0)
    status = np.zeros(len(e), np.uint8)
    status[order] = np.where(later, LATER, np.where(tags > many_phrases, HOT, np.where(tags > 1, EDGE, np.where(seen, REPEATED, 0))))
    return status


def edges(data: np.ndarray, offsets: np.ndarray, found: list, length: int, kind: int) -> tuple[np.ndarray, ...]:
    """(document, first start, last start, mark, sums) of the dictionary's phrases of a kind, without the strings that hold
    a mark which the corpus has once; found: each document's places and states."""
    doc, lo, hi, mark, sums = phrases(data, offsets, length)
    status = np.zeros(len(doc), np.uint8)
    base = np.searchsorted(doc, np.arange(len(offsets)))
    for k, (at, flags) in enumerate(zip(*found, strict=True)):
        if at:
            where = base[k] + np.frombuffer(at, np.uint32).astype(np.int64)
            np.maximum.at(status, where, np.frombuffer(flags, np.uint8))
    once = np.where((status == 0) & (mark >= 0), np.arange(len(doc)), len(doc))
    coming = np.minimum.accumulate(once[::-1])[::-1] if len(doc) else once
    limit = np.append(np.where(mark >= 0, mark, 0), np.iinfo(np.int64).max // 2)[coming] + TRIGGER - length - 1
    limit = np.where(np.append(doc, -1)[coming] == doc, limit, np.iinfo(np.int64).max // 2)
    hi = np.minimum(hi, limit)
    pick = np.flatnonzero((status == kind) & (hi >= lo))
    return doc[pick], lo[pick], hi[pick], mark[pick], sums


CONTEXTS = [("mark", pa.int64()), ("doc_id", pa.int64()), ("no_id", pa.bool_()), ("text_hash", pa.int64()), ("place", pa.int32()), ("before", pa.int32()), ("least", pa.int32()), ("bytes", pa.binary())]
CONTEXTS_SQL = "mark long, doc_id long, no_id boolean, text_hash long, place int, before int, least int, bytes binary"
STARTS = [("doc_id", pa.int64()), ("no_id", pa.bool_()), ("text_hash", pa.int64()), ("at", pa.binary())]
STARTS_SQL = "doc_id long, no_id boolean, text_hash long, at binary"


def contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The dictionary's phrases of marks that have several: the bytes before and after the mark that their strings reach.

    Strings start `least` to `before` bytes before the mark, which stands at `place`.
    """
    for batch in batches:
        names = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]]
        for row, data, offsets in hs.text_slices(batch.column(3)):
            n = len(offsets) - 1
            doc, lo, hi, mark, sums = edges(data, offsets, [c.slice(row, n).to_pylist() for c in batch.columns[4:]], length, EDGE)
            if len(doc):
                key = hs.runs(sums, mark, mark + TRIGGER).view(np.int64)
                ends = np.cumsum(hi - lo + length)
                at = np.arange(ends[-1]) + np.repeat(lo - ends + (hi - lo + length), hi - lo + length)
                cut = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(data[at].tobytes())])
                place, before, least = (x.astype(np.int32) for x in (mark - offsets[doc], mark - lo, mark - hi))
                yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(c[row + doc]) for c in names], pa.array(place), pa.array(before), pa.array(least), cut], names=[c for c, _ in CONTEXTS])


def suffix_order(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A suffix array: the order of byte rows within groups, and the bytes that each shares with the one before it (0: another group)."""
    words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    words[:, : rows.shape[1]] = rows
    order = np.lexsort((*words.view(">u8").astype(np.uint64).T[::-1], group))
    same = np.zeros((len(rows), rows.shape[1] + 1), bool)  # the last column stays unequal
    same[1:, :-1] = rows[order][1:] == rows[order][:-1]
    shared = np.argmin(same, axis=1)
    shared[1:][group[order][1:] != group[order][:-1]] = 0
    return order, shared


def met_before(mark: np.ndarray, rank: np.ndarray, before: np.ndarray, least: np.ndarray, text: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, d) of the strings, d bytes before the mark, that a phrase of smaller rank has as well."""
    n, reach = len(mark), length - TRIGGER
    left, right = np.zeros((n, reach), np.uint8), np.zeros((n, length), np.uint8)
    for k, (b, t) in enumerate(zip(before.tolist(), text, strict=True)):
        left[k, :b] = np.frombuffer(t, np.uint8, b)[::-1]
        right[k, : len(t) - b] = np.frombuffer(t, np.uint8, len(t) - b, b)[:length]
    by_right, to_right = suffix_order(mark, right)
    by_left, to_left = suffix_order(mark, left)
    run_right, run_left = np.empty(n, np.int64), np.empty(n, np.int64)
    phrase, depth = [], []
    for d in range(reach + 1):
        own = np.flatnonzero((least <= d) & (d <= before))
        if len(own) < 2:
            continue
        run_right[by_right] = np.cumsum(to_right < length - d)
        run_left[by_left] = np.cumsum(to_left < d) if d else 0
        _, string = np.unique(run_right[own] * (n + 1) + run_left[own], return_inverse=True)
        first = np.full(string.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, string, rank[own])
        later = own[rank[own] > first[string]]
        phrase.append(later)
        depth.append(np.full(len(later), d))
    return (np.concatenate(phrase), np.concatenate(depth)) if phrase else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def sort_contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(document, first bytes) of the strings that a bucket's other phrases have earlier."""
    table = pa.Table.from_batches(batches, schema=pa.schema(CONTEXTS))
    if not table.num_rows:
        return
    mark, ids, no_id, hashes, place, before, least = (c.to_numpy() for c in table.columns[:7])
    order = np.lexsort((place, hashes, ids, no_id))
    rank = np.empty(len(order), np.int64)
    # rows of one id with other texts are judged by place alone
    rank[order] = np.cumsum(np.concatenate([[True], (ids[order][1:] != ids[order][:-1]) | (no_id[order][1:] != no_id[order][:-1])])) << 32
    rank += place
    phrase, d = met_before(mark, rank, before, least, table.column(7).to_pylist(), length)
    if not len(phrase):
        return
    start = place[phrase] - d
    order = np.lexsort((start, hashes[phrase], ids[phrase], no_id[phrase]))
    phrase, start = phrase[order], start[order].astype(np.uint32)
    new = np.flatnonzero(fs.is_first(np.arange(len(phrase)), ids[phrase], no_id[phrase], hashes[phrase]))
    ends = np.append(new[1:], len(phrase))
    at = pa.array([start[a:b].tobytes() for a, b in zip(new, ends, strict=True)], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(c[phrase[new]]) for c in (ids, no_id, hashes)] + [at], names=[c for c, _ in STARTS])


def hot_strings(data: np.ndarray, offsets: np.ndarray, more: list, length: int) -> fs.Entries:
    """The strings of first phrases whose mark has more than MANY, as hashes of the whole and of its halves."""
    doc, lo, hi, _, sums = edges(data, offsets, more, length, HOT)
    counts = hi - lo + 1
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)
    own, half = np.repeat(doc, counts), length // 2
    halves = hs.mix(hs.runs(sums, start, start + half) + hs.mix(hs.runs(sums, start + half, start + length)))
    return fs.Entries(own, start - offsets[own], hs.runs(sums, start, start + length), halves)


def settle_strings(e: fs.Entries, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = ids[e.doc]
    order = np.lexsort((e.at, own, e.tag, e.key))
    first = fs.is_first(order, e.key, e.tag)
    head = order[fs.spread(first)]
    status, send = np.zeros(len(e), np.uint8), np.zeros(len(e), bool)
    status[order[(own[order] > own[head]) | (own[order] == own[head]) & (e.at[order] > e.at[head])]] = LATER
    send[order[first]] = True
    return status, send


def resolve_strings(e: fs.Entries) -> np.ndarray:
    return settle_strings(fs.Entries(np.arange(len(e)), e.at, e.key, e.tag), e.doc)[0]


def removed_mask(data: np.ndarray, phrase_at: bytes | None, phrase_status: bytes | None, string_at: list[bytes] | None, length: int) -> np.ndarray:
    change = np.zeros(len(data) + 1, np.int32)
    if phrase_at:
        _, lo, hi, _, _ = phrases(data, np.array([0, len(data)]), length)
        later = np.frombuffer(phrase_at, np.uint32)[np.frombuffer(phrase_status, np.uint8) == LATER]
        later = later[lo[later] <= hi[later]]
        np.add.at(change, lo[later], 1)
        np.add.at(change, hi[later] + length, -1)
    if string_at is not None and len(string_at):
        at = np.frombuffer(b"".join(string_at), np.uint32).astype(np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + length, -1)
    return np.cumsum(change)[:-1] > 0


def having(found: DataFrame, status: int) -> DataFrame:
    return found.filter(F.expr(f"locate(chr({status}), cast(status as string)) > 0"))


def flags(docs: DataFrame, length: int, many: int = MANY) -> DataFrame:
    """(doc_id, no_id, text_hash, phrase_at, phrase_status, string_at) of documents that lose bytes; string_at: a list of packed places."""
    ensure_checkpoint_dir(docs.sparkSession)
    buckets = shards(docs, "text", BUCKET_BYTES)
    by_phrase = settled(fs.verdicts(docs, functools.partial(parse, length=length), settle_phrases, functools.partial(resolve_phrases, many_phrases=many), buckets))
    chosen = lambda kind: docs.join(having(by_phrase, kind), fs.NAMES).select(*fs.NAMES, "text", "at", "status").dropDuplicates(fs.NAMES)
    sent = chosen(EDGE).mapInArrow(functools.partial(contexts, length=length), CONTEXTS_SQL).repartition(buckets, "mark")
    strings = settled(sent.mapInArrow(functools.partial(sort_contexts, length=length), STARTS_SQL))
    if not having(by_phrase, HOT).isEmpty():
        hot = fs.verdicts(chosen(HOT), functools.partial(hot_strings, length=length), settle_strings, resolve_strings, buckets)
        strings = strings.union(settled(hot.select(*fs.NAMES, "at")))
    by_string = strings.groupBy(*fs.NAMES).agg(F.collect_list("at").alias("string_at"))
    first = having(by_phrase, LATER).select(*fs.NAMES, F.col("at").alias("phrase_at"), F.col("status").alias("phrase_status"))
    return first.join(by_string, fs.NAMES, "full")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, many: int = MANY) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs."""
    texts = fs.prepared(docs, id_col, text_col)
    marked = texts.join(flags(texts, length, many), fs.NAMES, "left").select(fs.given_id(), "text", "phrase_at", "phrase_status", "string_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, *found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                gone = n = 0
                if any(f is not None for f in found):
                    data = np.frombuffer(raw, np.uint8)
                    mask = removed_mask(data, *found, length)
                    raw, gone, n = data[~mask].tobytes(), int(mask.sum()), int(np.count_nonzero(mask[1:] & ~mask[:-1]) + mask[0])
                out.append((doc_id, len(raw) + gone, gone, n, hashlib.sha256(raw).hexdigest()))
            types = [pa.int64()] * 4 + [pa.string()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with repeated bytes removed from the text column; cut characters go, and a null text stays null."""
    found = flags(fs.prepared(docs, id_col, text_col), length)
    doc_id, text = F.col(f"d.{id_col}").cast("long"), F.col(f"d.{text_col}").cast("string")
    own = [F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), F.xxhash64(F.coalesce(text, F.lit("")))]

    @F.pandas_udf("string")
    def cut(text: pd.Series, phrase_at: pd.Series, phrase_status: pd.Series, string_at: pd.Series) -> pd.Series:
        def one(t: str | None, at: bytes | None, status: bytes | None, strings: list[bytes] | None) -> str | None:
            if not isinstance(t, str) or at is None and strings is None:
                return t
            data = np.frombuffer(t.encode(), np.uint8)
            return data[~removed_mask(data, at, status, strings, length)].tobytes().decode(errors="ignore")

        return pd.Series([one(*r) for r in zip(text, phrase_at, phrase_status, string_at, strict=True)], dtype=object)

    same = [c == F.col(f"f.{name}") for c, name in zip(own, fs.NAMES, strict=True)]
    joined = docs.alias("d").join(found.alias("f"), same, "left")
    left = cut(text, "f.phrase_at", "f.phrase_status", "f.string_at").alias(text_col)
    return joined.select(*[left if c == text_col else F.col(f"d.{c}") for c in docs.columns])
