"""An exchange that finds, for packed entries of documents, which of them the corpus has elsewhere.

A task reads documents in slices of about two megabytes. A slice sends its entries (hash, tag, document, place) to
buckets of hashes as packed arrays: a few bytes an entry and no row for each. What a slice can decide by itself it
does not send, so a passage that a third of all documents share costs an entry for each slice, not for each document.
A bucket's verdicts return to the slice, which gives one row for each document that has any.

Slices are numbered by partition and order of reading; an input that is read again after a lost executor must come in
the same order, as files and shuffled tables do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm import hashing as hs

PACKED = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("head", pa.binary()), ("keys", pa.binary()), ("tags", pa.binary()), ("docs", pa.binary()), ("at", pa.binary()), ("status", pa.binary())])
PACKED_SQL = "bucket int, slice long, head binary, keys binary, tags binary, docs binary, at binary, status binary"
#: What names a document: doc_id is 0 where no_id says that it is null.
NAMES = ["doc_id", "no_id", "text_hash"]
FLAGS_SQL = "doc_id long, no_id boolean, text_hash long, at binary, status binary"
SLICE_ROWS = 60_000
#: Low bytes of a tag that are sent: tags are compared within a key only.
TAG_BYTES = 8


class Entries:
    """Parallel arrays: document (row in its slice, or id in a bucket), place in it, key, and a tag that refines the key."""

    def __init__(self, doc: np.ndarray, at: np.ndarray, key: np.ndarray, tag: np.ndarray | None = None):
        self.doc, self.at, self.key, self.tag = doc, at, key, key if tag is None else tag
        self.tagged = tag is not None

    def __len__(self) -> int:
        return len(self.doc)


def planes(a: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number, byte plane by byte plane: slowly growing numbers then compress well."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(packed: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(packed) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(packed, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def ranks(ids: np.ndarray, no_id: np.ndarray) -> np.ndarray:
    """Places of the ids in order, equal for equal ids; documents without an id come last, all as one."""
    _, place = np.unique(ids, return_inverse=True)
    return np.where(no_id, len(ids), place.astype(np.int64))


def packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PACKED.types, strict=True)], schema=PACKED)


def verdicts(
    docs: DataFrame,
    extract: Callable[[np.ndarray, np.ndarray, list], Entries],
    settle: Callable[[Entries, np.ndarray], tuple[np.ndarray, np.ndarray]],
    resolve: Callable[[Entries], np.ndarray],
    buckets: int,
    key_bytes: int = 8,
) -> DataFrame:
    """(doc_id, no_id, text_hash, at, status) of each document with a verdict; at: u32 places, status: u8, in order of place.

    docs: doc_id, no_id, text_hash, text and more columns, which extract gets by row. extract(bytes, offsets, more)
    makes a slice's entries; settle(entries, ranks of the ids) gives (status, send): verdicts that the slice can reach
    alone and which entries others need; resolve(entries with ranks) gives the status of a bucket's entries (0: none).
    Where rows of one document differ, the least status of a place holds.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(first, SLICE_ROWS)
                ids, no_ids, hashes = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:3])
                for row, data, offsets in hs.text_slices(batch.column(3)):
                    n = len(offsets) - 1
                    more = [c.slice(row, n).to_pylist() for c in batch.columns[4:]]
                    entries = extract(data, offsets, more)
                    if not len(entries):
                        continue
                    me, serial = (part << 32) | serial, serial + 1
                    own, no_id = ids[row : row + n], no_ids[row : row + n]
                    status, needed = settle(entries, ranks(own, no_id))
                    local = np.flatnonzero(status)
                    out = [(me % buckets, me, np.stack([own, no_id, hashes[row : row + n]]).tobytes(), b"", b"", planes(entries.doc[local], 2), planes(entries.at[local], 4), status[local].astype(np.uint8).tobytes())]
                    rest = np.flatnonzero(needed)
                    bucket = (entries.key[rest] >> hs.U(40)) % hs.U(buckets)
                    order = rest[np.argsort(bucket, kind="stable")]
                    cut = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
                    for k in np.flatnonzero(np.diff(cut)):
                        e = order[cut[k] : cut[k + 1]]
                        used, doc = np.unique(entries.doc[e], return_inverse=True)
                        head = planes(used, 2) + planes(own[used], 8) + np.packbits(no_id[used]).tobytes()
                        tags = planes(entries.tag[e], TAG_BYTES) if entries.tagged else b""
                        out.append((int(k), me, head, planes(entries.key[e] >> hs.U(64 - 8 * key_bytes), key_bytes), tags, planes(doc, 2), planes(entries.at[e], 4), None))
                    yield packed_rows(out)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices, heads, parts, base = [], [], [], 0
        for batch in batches:
            for _, me, head, keys, tags, doc, at, status in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if status is not None:
                    yield packed_rows([(0, me, head, b"", b"", doc, at, status)])
                    continue
                n = 8 * len(head) // 81  # ten bytes and a bit for each document
                heads.append((from_planes(head[: 2 * n], 2), from_planes(head[2 * n : 10 * n], 8).astype(np.int64), np.unpackbits(np.frombuffer(head[10 * n :], np.uint8), count=n).astype(bool)))
                key = from_planes(keys, key_bytes)
                parts.append((base + from_planes(doc, 2).astype(np.int64), from_planes(at, 4), key, from_planes(tags, TAG_BYTES) if tags else key, np.full(len(key), len(slices), np.int32)))
                slices.append(me)
                base += n
        if not parts:
            return
        columns = [list(c) for c in zip(*parts, strict=True)]
        parts.clear()
        place, at, key, tag, source = (np.concatenate(columns.pop(0)) for _ in range(5))
        used, ids, no_id = (np.concatenate(c) for c in zip(*heads, strict=True))
        status = resolve(Entries(ranks(ids, no_id)[place], at, key, tag))
        found = np.flatnonzero(status)
        cut = np.searchsorted(source[found], np.arange(len(slices) + 1))
        for k in np.flatnonzero(np.diff(cut)):
            e = found[cut[k] : cut[k + 1]]
            yield packed_rows([(0, slices[k], b"", b"", b"", planes(used[place[e]], 2), planes(at[e], 4), status[e].astype(np.uint8).tobytes())])

    def gather(table: pa.Table) -> pa.Table:
        heads, docs_in, ats, statuses = (table.column(c).to_pylist() for c in ("head", "docs", "at", "status"))
        ids, no_id, hashes = np.frombuffer(next(h for h in heads if h), np.int64).reshape(3, -1)
        doc = np.concatenate([from_planes(d, 2) for d in docs_in]).astype(np.int64)
        at = np.concatenate([from_planes(a, 4) for a in ats])
        status = np.concatenate([np.frombuffer(s, np.uint8) for s in statuses])
        order = np.lexsort((at, doc))
        doc, at, status = doc[order], at[order].astype(np.uint32), status[order]
        used, first = np.unique(doc, return_index=True)
        ends = np.append(first, len(doc))[1:]  # none where a slice has no verdict
        return pa.table(
            {
                "doc_id": ids[used],
                "no_id": no_id[used].astype(bool),
                "text_hash": hashes[used],
                "at": pa.array([at[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()),
                "status": pa.array([status[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()),
            }
        )

    sent = docs.mapInArrow(send, PACKED_SQL).repartition(buckets, "bucket")
    flags = sent.mapInArrow(judge, PACKED_SQL).groupBy("slice").applyInArrow(gather, FLAGS_SQL)
    # rows of one document may have verdicts that others of it lack, as slices send what is equal once
    found = flags.groupBy(*NAMES).agg(F.collect_set(F.concat("at", "status")).alias("found"))
    return found.mapInArrow(united, FLAGS_SQL)


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document all places with a verdict, with the least status of each."""
    for batch in batches:
        at, status = [], []
        for found in batch.column(3).to_pylist():
            cut = [len(f) // 5 * 4 for f in found]
            a, s = b"".join(f[:k] for f, k in zip(found, cut, strict=True)), b"".join(f[k:] for f, k in zip(found, cut, strict=True))
            if len(found) > 1:
                places, marks = np.frombuffer(a, np.uint32), np.frombuffer(s, np.uint8)
                order = np.lexsort((marks, places))
                order = order[is_first(order, places)]
                a, s = places[order].tobytes(), marks[order].tobytes()
            at.append(a)
            status.append(s)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(at, pa.binary()), pa.array(status, pa.binary())], names=[*NAMES, "at", "status"])


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, no_id, text_hash, text: equal ids with equal texts are one document, with other texts they are judged by place.

    Null ids count as one id that is greater than all others.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("no_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def given_id() -> Column:
    """The id of a prepared document as it came: null where it had none."""
    return F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id")


def is_first(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Whether each sorted row differs from the row before it in any column."""
    out = np.ones(len(order), bool)
    if len(order):
        out[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    return out


def spread(firsts: np.ndarray) -> np.ndarray:
    """For each sorted row the row where its group began."""
    return np.maximum.accumulate(np.where(firsts, np.arange(len(firsts)), 0))
