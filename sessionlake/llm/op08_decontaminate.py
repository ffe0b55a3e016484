"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

A document is contaminated by an item of n words if some window of n words is within d = floor(edit_rate * n) word
edits of it. Words are lower-cased (A-Z) and lose ASCII punctuation at both ends.

1. Gate, without loss: of an item cut into d + 1 pieces, d edits leave one piece whole. Only item-sized windows around
   a verbatim piece go on.
2. The CGK random walk embeds a window: at step j the current word is written out, and a random bit of (j, word) tells
   whether to move on. Windows at a small edit distance have embeddings at a small Hamming distance. Each of `walks`
   embeddings is sampled at `bits` places, many times; places are those that almost every walk reaches before the
   window's end. A window that meets any item's samples in any table is a candidate. The number of tables follows from
   `recall`: if embeddings of pairs at the allowed distance agree in a share `agreement` of their places, `tables` of
   them miss a pair with probability (1 - agreement ** bits) ** (walks * tables). Tests measure recall against an
   exhaustive search.
3. Each candidate is verified by its exact word edit distance, in a band of the allowed edits.

The items are a fixed query set: they are packed once and sent to all workers, in blocks of `block` items, which
bounds what a worker holds; every block meets every document. No document is shuffled. Windows wait until a number of
words has come together, so long items need no more memory than short ones.

Defined results: null and empty texts match nothing; items that are null or have no words match nothing; repeated
rows and ids give the same result for each; a document without an id is known by its text, with a null doc_id; empty
tables give empty results; texts and items of any length are read whole; other columns, whatever their names, are
ignored by `find` and kept by `decontaminate`.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm import hashing as hs

EDIT_RATE, WALKS, BITS, BLOCK = 0.2, 8, 3, 20_000
#: Target recall among the windows that pass the gate, and the least share of places in which embeddings of a true pair agree.
RECALL, AGREEMENT = 0.999, 0.3
#: Words of windows that wait to be embedded together, and pairs that are verified together.
WAITING_WORDS, PAIRS = 400_000, 20_000
PUNCTUATION = np.isin(np.arange(256), [c for c in range(0x21, 0x7F) if not chr(c).isalnum()])
GATE_BITS = 22


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of normalised words, and each document's bounds among them."""
    data = hs.LOWER[data]
    starts, ends, bounds = hs.words(data, offsets)
    sums = hs.prefix_sums(hs.BYTE_VALUES[data])
    live = np.flatnonzero(PUNCTUATION[data[ends - 1]]) if len(ends) else np.zeros(0, int)
    while len(live):
        ends[live] -= 1
        live = live[ends[live] > starts[live]]
        live = live[PUNCTUATION[data[ends[live] - 1]]]
    live = np.flatnonzero(ends > starts)
    live = live[PUNCTUATION[data[starts[live]]]]
    while len(live):
        starts[live] += 1
        live = live[PUNCTUATION[data[starts[live]]]]
    full = ends > starts
    return hs.runs(sums, starts[full], ends[full]), np.concatenate([[0], np.cumsum(full)])[bounds]


def edits_allowed(n: int, edit_rate: float) -> int:
    return int(n * edit_rate + 1e-9)


def tables_for(recall: float, agreement: float, walks: int, bits: int) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agreement**bits) / walks))


class Items:
    """The packed benchmark: words, gate pieces and LSH tables of a block of items."""

    def __init__(self, ids: list[int], texts: list[str], edit_rate: float, walks: int, tables: int, bits: int):
        self.edit_rate, self.walks, self.tables, self.bits = edit_rate, walks, tables, bits
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        grouped: dict[int, list[tuple[int, np.ndarray]]] = {}
        for row, data, offsets in hs.text_slices(pa.array(texts, pa.large_string())):
            hashes, bounds = plain_words(data, offsets)
            for k in range(len(bounds) - 1):
                grouped.setdefault(int(bounds[k + 1] - bounds[k]), []).append((row + k, hashes[bounds[k] : bounds[k + 1]]))
        grouped.pop(0, None)
        for n, found in grouped.items():
            words = np.stack([w for _, w in found])
            self.by_length[n] = (np.array([ids[k] for k, _ in found], np.int64), words)
            d = edits_allowed(n, edit_rate)
            size = n // (d + 1)
            for p in range(d + 1):
                at = p * n // (d + 1)
                sums = [hs.runs(hs.prefix_sums(w), np.array([at]), np.array([at + size]))[0] for w in words]
                pieces.setdefault(size, []).extend((int(h), n, at) for h in sums)
        self.gates = {}
        for size, found in pieces.items():
            rows = sorted(set(found))
            hashes = np.array([h for h, _, _ in rows], hs.U)
            self.gates[size] = (hashes, np.array([n for _, n, _ in rows]), np.array([at for _, _, at in rows]), gate_bits(hashes))
        self.sampled = {n: self.samples(n) for n in self.by_length}
        self.lsh = {n: [(np.sort(k), np.argsort(k, kind="stable")) for k in self.keys(words)] for n, (_, words) in self.by_length.items()}

    def samples(self, n: int) -> np.ndarray:
        """(walk, table, bit): the places at which embeddings of n words are sampled, before the end of nearly every walk."""
        steps = min(3 * n, max(self.bits, int(2 * n - 3 * math.sqrt(n / 2))))
        rng = np.random.default_rng(n)
        return np.stack([rng.permuted(np.tile(np.arange(steps), (self.tables, 1)), axis=1)[:, : self.bits] for _ in range(self.walks)])

    def keys(self, windows: np.ndarray) -> Iterator[np.ndarray]:
        """The samples of the windows' CGK embeddings, table by table; windows: words of one length, a row each."""
        n, places = windows.shape[1], self.sampled[windows.shape[1]]
        padded = np.concatenate([windows, np.zeros((len(windows), 1), hs.U)], axis=1)
        rows, steps = np.arange(len(windows)), int(places.max()) + 1
        for walk in range(self.walks):
            seeds = np.random.default_rng(walk).integers(0, 2**63, steps, dtype=np.int64).astype(hs.U)
            embedded = np.empty((steps, len(windows)), hs.U)
            at = np.zeros(len(windows), np.int64)
            for j in range(steps):
                word = embedded[j] = padded[rows, at]
                at = np.minimum(at + (hs.mix(word ^ seeds[j]) >> hs.U(63)).astype(np.int64), n)
            for table in places[walk]:
                key = np.zeros(len(windows), hs.U)
                for place in table:
                    key = hs.mix(key * hs.U(hs.BASE) + embedded[place])
                yield key

    def candidates(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (window, item row among those of its length) pairs that meet in a table."""
        n = windows.shape[1]
        width, found = len(self.by_length[n][0]), np.zeros(0, np.int64)
        for keys, (known, order) in zip(self.keys(windows), self.lsh[n], strict=True):
            lo, hi = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
            hit = np.flatnonzero(hi > lo)
            counts = (hi - lo)[hit]
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo[hit], counts)
            found = np.union1d(found, np.repeat(hit, counts) * width + order[at])
        return found // width, found % width

    def verified(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item id, distance) of the candidates within the allowed edits."""
        n = windows.shape[1]
        names, words = self.by_length[n]
        w, i = self.candidates(windows)
        most = edits_allowed(n, self.edit_rate)
        distance = np.concatenate([edit_distances(windows[w[k : k + PAIRS]], words[i[k : k + PAIRS]], most) for k in range(0, len(w), PAIRS)] or [np.zeros(0, np.int64)])
        good = np.flatnonzero(distance <= most)
        return w[good], names[i[good]], distance[good]


def gate_bits(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << GATE_BITS, bool)
    out[(hashes & hs.U((1 << GATE_BITS) - 1)).astype(np.int64)] = True
    return out


def edit_distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Word edit distances of rows of equal length, or most + 1 where they are larger: one dynamic program over all rows,
    in the band of |i - j| <= most."""
    rows, n = a.shape
    band, far = 2 * most + 1, most + 1
    last = np.full((band + 2, rows), far, np.int64)  # cell k + 1 is column i + k - most; a wall on either side
    last[most + 1 : 2 * most + 2] = np.arange(most + 1)[:, None]
    for i in range(1, n + 1):
        new = np.full((band + 2, rows), far, np.int64)
        for k in range(max(0, most - i), min(band, n - i + most + 1)):
            j = i + k - most
            if j == 0:
                new[k + 1] = i
                continue
            new[k + 1] = np.minimum(np.minimum(last[k + 2], new[k]) + 1, last[k + 1] + (a[:, i - 1] != b[:, j - 1]))
        last = new
    return np.minimum(last[most + 1], far)


#: key: the doc_id, or where it is null (no_id) a hash of the text.
FOUND = "key long, no_id boolean, item_id long, distance int, first_word long, n_windows long"


def near_pieces(items: Items, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, starts, documents) of the item-sized windows around verbatim pieces, within documents."""
    low, sums = hs.U((1 << GATE_BITS) - 1), hs.prefix_sums(hashes)
    wanted: dict[int, list[np.ndarray]] = {}
    for size, (known, lengths, places, bitmap) in items.gates.items():
        first = np.arange(max(len(hashes) - size + 1, 0))
        windows = hs.runs(sums, first, first + size)
        near = np.flatnonzero(bitmap[(windows & low).astype(np.int64)])
        lo, hi = np.searchsorted(known, windows[near], "left"), np.searchsorted(known, windows[near], "right")
        counts = hi - lo
        gate = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)
        start = np.repeat(near, counts) - places[gate]
        for n in np.unique(lengths[gate]):
            wanted.setdefault(int(n), []).append(np.unique(start[lengths[gate] == n]))
    for n, starts in wanted.items():
        d = edits_allowed(n, items.edit_rate)
        at = np.unique(np.unique(np.concatenate(starts))[:, None] + np.arange(-d, d + 1))
        at = at[(at >= 0) & (at + n <= len(hashes))]
        doc = np.searchsorted(bounds, at, side="right") - 1
        whole = at + n <= bounds[doc + 1]
        yield n, at[whole], doc[whole]


def search(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    waiting: dict[int, list[tuple[np.ndarray, ...]]] = {}

    def flush(n: int) -> Iterator[pa.RecordBatch]:
        windows, keys, no_id, places = (np.concatenate(c) for c in zip(*waiting.pop(n), strict=True))
        w, item, distance = items.verified(windows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[w]), pa.array(no_id[w]), pa.array(item), pa.array(distance.astype(np.int32)), pa.array(places[w]), pa.array(np.ones(len(w), np.int64))],
            names=["key", "no_id", "item_id", "distance", "first_word", "n_windows"],
        )

    for batch in batches:
        keys, no_id = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:2])
        for row, data, offsets in hs.text_slices(batch.column(2)):
            hashes, bounds = plain_words(data, offsets)
            for n, at, doc in near_pieces(items, hashes, bounds):
                step = max(1, WAITING_WORDS // n)
                for lo in range(0, len(at), step):
                    a, d = at[lo : lo + step], doc[lo : lo + step]
                    waiting.setdefault(n, []).append((hashes[a[:, None] + np.arange(n)], keys[row + d], no_id[row + d], a - bounds[d]))
                    if sum(x[0].size for x in waiting[n]) >= WAITING_WORDS:
                        yield from flush(n)
            while sum(x[0].size for found in waiting.values() for x in found) > 8 * WAITING_WORDS:
                yield from flush(max(waiting, key=lambda n: sum(x[0].size for x in waiting[n])))
    for n in list(waiting):
        yield from flush(n)


def document_key(id_col: str, text_col: str) -> dict[str, Column]:
    doc_id = F.col(f"d.{id_col}").cast("long")
    return {"key": F.coalesce(doc_id, F.xxhash64(F.col(f"d.{text_col}").cast("string"))), "no_id": doc_id.isNull()}


def found(
    docs: DataFrame, items: DataFrame, edit_rate: float = EDIT_RATE, walks: int = WALKS, bits: int = BITS, recall: float = RECALL, agreement: float = AGREEMENT,
    block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(key, no_id, item_id, distance, first_word, n_windows): as find, by document_key."""
    texts = docs.alias("d").select(*[c.alias(name) for name, c in document_key(id_col, text_col).items()], F.col(text_col).cast("string").alias("text"))
    known = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text IS NOT NULL AND item_id IS NOT NULL")
    blocks, out, tables = max(1, -(-known.count() // block)), None, tables_for(recall, agreement, walks, bits)
    for k in range(blocks):
        rows = known.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").toArrow()
        packed = Items(rows["item_id"].to_pylist(), rows["text"].to_pylist(), edit_rate, walks, tables, bits)
        part = texts.mapInArrow(functools.partial(search, items=packed), FOUND)
        out = part if out is None else out.union(part)
    best = F.min(F.struct("distance", "first_word"))
    return out.groupBy("key", "no_id", "item_id").agg(best.alias("b"), F.sum("n_windows").alias("n_windows")).select(
        "key", "no_id", "item_id", F.col("b.distance").alias("distance"), F.col("b.first_word").alias("first_word"), "n_windows"
    )


def find(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, distance, first_word, n_windows): the best window of each contaminated document and item."""
    doc_id = F.when(~F.col("no_id"), F.col("key")).alias("doc_id")
    return found(docs, items, **options).select(doc_id, "item_id", "distance", "first_word", "n_windows")


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the documents in which an item was found."""
    key = document_key(options.get("id_col", "doc_id"), options.get("text_col", "text"))
    hit = found(docs, items, **options).select("key", "no_id").distinct()
    return docs.alias("d").join(hit.alias("h"), (key["key"] == F.col("h.key")) & (key["no_id"] == F.col("h.no_id")), "left_anti")
