"""N-gram Jaccard join: T-occurrence search by DivideSkip over a sharded inverted index, and the classes its links form.

Two sets of n and m shingles with Jaccard similarity 0.75 or more share at least 3/7 * (n + m) of them, and so at least
T = ceil(0.75 * n). The search of a set in a shard of others orders the shard's inverted lists of its shingles by
length, merges all but the L longest while counting occurrences, keeps the rows that occur T - L times or more, and
probes the L long lists for those by binary search (DivideSkip chooses L). The counts are whole overlaps, so the
required overlap decides each link without another look at the sets.

1. Texts are hashed once. A document with more than n - T shingles that no other document has can have no partner.
   Those are found by one exchange of packed hashes, each once for each slice of documents (pre-aggregated, so a
   shingle in a third of all documents is a third of the slices, not of the rows).
2. The index is sharded by likeness: of several min-hashes of a set, its home is the one that most sets share. Homes are
   cut into shards of bounded size, each with one set of the home that the others of a near-copy group link to. Every
   shard searches its own sets, which joins most near copies into classes.
3. What may be left are links between classes of different shards. Two linked sets share one of their n - T + 1
   shortest lists, at places that leave enough shingles after them. If that is a short list, it is the key by which they
   meet. If it is a long one, all they share is in long lists, as the paragraphs of a template are, and one shared
   paragraph says little: shingles that the same sets have become one weighted token, and the key is a combination of as
   many tokens as two linked sets surely share. Keys with several classes are found by grouped minima and maxima, and
   each set of a smaller class is searched in the other shards that its keys name, once in each. No link is lost: this
   step covers all pairs of different classes, those in different shards of one home included.

Equal sets are one node throughout, so a group of copies costs one row each and no pairs. Classes are connected
components of the links.

Defined results: null text and text without words have n_shingles 0 and their own doc_id as component_id; one to four
words are one shingle; repeated rows and equal doc_ids are rows of their own; a null doc_id is the least
of no class, and the component_id of a class that has no other is null; columns other than the two are ignored; an
empty table gives an empty result; texts of any length are read whole.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm import hashing as hs
from sessionlake.llm.components import components
from sessionlake.session import ensure_checkpoint_dir, settled, shards

WORDS, PERCENT = 5, 75
#: Shingles in more documents than LONG count as long lists; the most frequent LONG_LISTS of them are ranked by length.
#: The ranking only orders lists: any value gives the same links.
LONG, LONG_LISTS = 8, 200_000
#: Min-hashes of a set, of which the most shared one is its home. Any number gives the same links.
HOMES = 8
#: A shard holds sets of about so many shingles together.
SHARD_SHINGLES = 1 << 18
#: DivideSkip's weight of a probe against a merged entry.
MU = 0.01
#: Keys of combinations of so many tokens are made as long as there are no more of them. Any number gives the same links.
MAX_KEYS = 40
#: Bytes of text for each bucket of the first exchange.
BUCKET_BYTES = 5_000_000
#: Bytes of a shingle's hash that are sent to count its documents. A chance meeting there only keeps a document in the
#: search that could have been left out; six bytes suit corpora of over 10**11 shingles.
PRINT_BYTES = 5
#: Documents of a slice; owners from here on stand for so many documents of a slice less this number, at most 5 535.
SLICE_ROWS = SEVERAL = 60_000
KEY = ["_id", "_no_id", "_hash"]


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted within it, and the documents' bounds among them."""
    data = hs.LOWER[data]
    starts, ends, bounds = hs.words(data, offsets)
    hashes = hs.word_hashes(data, starts, ends)
    shingles, _, at = hs.windows(hashes, bounds, words)
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(len(counts)), np.diff(at))
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        whole = hs.runs(hs.prefix_sums(hashes), bounds[short], bounds[short + 1])
        shingles, doc = np.concatenate([shingles, whole]), np.concatenate([doc, short])
    order = np.lexsort((shingles, doc))
    shingles, doc = shingles[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingles[1:] != shingles[:-1])
    shingles, doc = shingles[new], doc[new]
    return shingles, np.searchsorted(doc, np.arange(len(counts) + 1))


def set_keys(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 63-bit key for each set: equal sets have equal keys."""
    sums = np.concatenate([np.zeros(1, hs.U), np.cumsum(hs.mix(shingles ^ hs.U(hs.BASE)))])
    return (hs.mix(sums[at[1:]] - sums[at[:-1]] + hs.mix(np.diff(at).astype(hs.U))) >> hs.U(1)).astype(np.int64)


def rows(schema: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


PACKED = [("bucket", pa.int32()), ("slice", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())]
HEADER, OWNED, HEAVY = 0, 1, 2


def pack(batches: Iterator[pa.RecordBatch], words: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Slices of documents: a header each, and for each bucket the slice's distinct shingles with their owner, if it is one."""
    part, serial = TaskContext.get().partitionId(), 0
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE_ROWS):
            texts = batch.column(3).slice(lo, SLICE_ROWS)
            names = np.stack([c.slice(lo, SLICE_ROWS).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:3]])
            for row, data, offsets in hs.text_slices(texts):
                shingles, at = shingle_sets(data, offsets, words)
                n = np.diff(at)
                keys = np.where(n > 0, set_keys(shingles, at), -1)
                me, serial = (part << 32) | serial, serial + 1
                _, same, inverse = np.unique(keys, return_index=True, return_inverse=True)
                own = np.isin(np.arange(len(n)), same)  # copies within a slice are one set
                doc = np.repeat(np.arange(len(n)), n)
                keep = own[doc]
                first, index, counts = np.unique(shingles[keep], return_index=True, return_counts=True)
                owner = np.where(counts == 1, doc[keep][index], np.minimum(SEVERAL + counts, 0xFFFF)).astype(np.uint16)
                bucket = (first >> hs.U(32)) % hs.U(buckets)
                order = np.lexsort((owner, bucket))
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                out = [(me % buckets, me, HEADER, np.stack([*names[:, row : row + len(n)], keys, n, same[inverse]]).tobytes(), b"")]
                for k in np.flatnonzero(np.diff(cut)):
                    at_k = order[cut[k] : cut[k + 1]]
                    out.append((int(k), me, OWNED, short_prints(first[at_k]), owner[at_k].tobytes()))
                yield rows(PACKED, list(zip(*out, strict=True)))


def short_prints(shingles: np.ndarray) -> bytes:
    """The leading PRINT_BYTES bytes of each hash."""
    return np.ascontiguousarray(shingles.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :PRINT_BYTES]).tobytes()


def long_prints(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // PRINT_BYTES, 8), np.uint8)
    out[:, :PRINT_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, PRINT_BYTES)
    return out.reshape(-1).view(">u8").astype(np.uint64)


def count_unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over all slices' shingles of a bucket: for each slice and owner the number that nobody else has; and the longest lists."""
    slices, prints, owners, which = [], [], [], []
    for batch in batches:
        for _, me, kind, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == HEADER:
                yield rows(PACKED, [[0], [me], [HEADER], [a], [b]])
            else:
                which.append(len(slices))
                slices.append(me)
                prints.append(long_prints(a))
                owners.append(np.frombuffer(b, np.uint16))
    if not slices:
        return
    sizes = [len(p) for p in prints]
    prints, owner, source = np.concatenate(prints), np.concatenate(owners), np.repeat(np.arange(len(slices), dtype=np.int32), sizes)
    order = np.argsort(prints)
    prints = prints[order]
    starts = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
    counts = np.diff(np.concatenate([starts, [len(prints)]]))
    alone = order[starts[counts == 1]]
    alone = alone[owner[alone] < SEVERAL]
    counts = np.add.reduceat(np.where(owner < SEVERAL, 1, owner.astype(np.int64) - SEVERAL)[order], starts)  # of documents
    place = source[alone].astype(np.int64) << 16 | owner[alone]
    place, n = np.unique(place, return_counts=True)
    cut = np.searchsorted(place >> 16, np.arange(len(slices) + 1))
    full = [k for k in range(len(slices)) if cut[k] < cut[k + 1]]
    if full:
        packed = [[(place[cut[k] : cut[k + 1]] & 0xFFFF).astype(np.uint16).tobytes(), n[cut[k] : cut[k + 1]].astype(np.uint32).tobytes()] for k in full]
        yield rows(PACKED, [[0] * len(full), [slices[k] for k in full], [OWNED] * len(full), [p[0] for p in packed], [p[1] for p in packed]])
    long = np.flatnonzero(counts > LONG)
    if len(long):
        long = long[np.argsort(-counts[long], kind="stable")][:LONG_LISTS]
        yield rows(PACKED, [[0], [-1], [HEAVY], [prints[starts[long]].tobytes()], [counts[long].astype(np.int64).tobytes()]])


def assemble(table: pa.Table) -> pa.Table:
    """The documents of a slice, with the number of shingles that are theirs alone."""
    kinds = table.column("kind").to_pylist()
    a, b = table.column("a"), table.column("b")
    ids, no_id, hashes, keys, n, first = np.frombuffer(a[kinds.index(HEADER)].as_py(), np.int64).reshape(6, -1)
    unique = np.zeros(len(ids), np.int64)
    for k in range(len(kinds)):
        if kinds[k] == OWNED:
            unique[np.frombuffer(a[k].as_py(), np.uint16)] += np.frombuffer(b[k].as_py(), np.uint32)
    return pa.table({"doc_id": pa.array(ids, mask=no_id.astype(bool)), "text_hash": hashes, "node": keys, "n": n, "n_unique": unique[first]})


def heaviest(packed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The LONG_LISTS most frequent shingles and their counts: a bounded table."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int64)), pa.array(np.frombuffer(b, np.int64))], names=["shingle", "docs"])

    table = packed.filter(F.col("kind") == HEAVY).select("a", "b").mapInArrow(unpack, "shingle long, docs long")
    top = table.orderBy(F.desc("docs"), "shingle").limit(LONG_LISTS).toArrow()
    prints = np.asarray(top["shingle"].combine_chunks()).astype(np.int64).view(np.uint64)
    order = np.argsort(prints)
    return prints[order], np.asarray(top["docs"].combine_chunks())[order]


SETS = [("node", pa.int64()), ("n", pa.int64()), ("n_short", pa.int64()), ("shingles", pa.list_(pa.int64())), ("homes", pa.list_(pa.int64()))]
SETS_SQL = "node long, n long, n_short long, shingles array<long>, homes array<long>"


def make_sets(batches: Iterator[pa.RecordBatch], words: int, long: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Whole sets of candidate documents, short lists first, with their min-hashes; (text, node) in."""
    prints, docs = long
    mask = hs.U((1 << 64) - (1 << 8 * (8 - PRINT_BYTES)))
    seeds = hs.mix(np.arange(1, HOMES + 1, dtype=hs.U) * hs.U(hs.BASE))
    for batch in batches:
        nodes = np.asarray(batch.column(1))
        for row, data, offsets in hs.text_slices(batch.column(0)):
            shingles, at = shingle_sets(data, offsets, words)
            keys = set_keys(shingles, at)
            length = np.zeros(len(shingles), np.int64)
            if len(prints):
                near = np.minimum(np.searchsorted(prints, shingles & mask), len(prints) - 1)
                length = np.where(prints[near] == shingles & mask, docs[near], 0)
            out = []
            for k in np.flatnonzero(keys == nodes[row : row + len(keys)]):
                own = shingles[at[k] : at[k + 1]]
                homes = [hs.mix(own ^ seed).min() for seed in seeds]
                out.append((keys[k], len(own), int((length[at[k] : at[k + 1]] == 0).sum()), own[np.lexsort((own, length[at[k] : at[k + 1]]))].view(np.int64), np.array(homes, hs.U).view(np.int64)))
            if out:
                yield rows(SETS, list(zip(*out, strict=True)))


class Shard:
    """An inverted index over the sets of a shard, and the classes of its sets as links are found."""

    def __init__(self, percent: int):
        self.percent, self.parts, self.into = percent, [], {}
        self.found: list[tuple[int, int]] = []
        self.asked, self.known = False, None

    def add(self, node: np.ndarray, component: np.ndarray, sizes: np.ndarray, shingles: np.ndarray) -> None:
        self.parts.append((node, component, sizes, shingles))

    def build(self) -> None:
        self.node, self.component, self.sizes, shingles = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts.clear()
        self.shingles, self.at = shingles, np.concatenate([[0], np.cumsum(self.sizes)])
        row = np.repeat(np.arange(len(self.node)), self.sizes)
        order = np.lexsort((row, shingles))
        ordered = shingles[order]
        start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        self.known, self.start, self.rows = ordered[start], np.append(start, len(ordered)), row[order]
        self.places = np.repeat(np.arange(len(start)), np.diff(self.start)) * len(self.node) + self.rows  # (list, row), sorted

    def occurring(self, query: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The rows among `others` (a mask) whose sets have the required overlap with the query."""
        n = len(query)
        least = int(needed(np.int64(n), self.percent))
        near = np.minimum(np.searchsorted(self.known, query), len(self.known) - 1)
        lists = near[self.known[near] == query]
        if len(lists) < least:
            return np.zeros(0, np.int64)
        length = self.start[lists + 1] - self.start[lists]
        lists, length = lists[order := np.argsort(length)], length[order]
        n_long = min(least - 1, int(least / (MU * math.log2(length[-1] + 1) + 1)))
        cut = len(lists) - n_long
        ends = np.cumsum(length[:cut])
        merged = self.rows[np.arange(ends[-1]) + np.repeat(self.start[lists[:cut]] - ends + length[:cut], length[:cut])]
        counts = np.bincount(merged, minlength=len(self.node))
        rows = np.flatnonzero((counts >= least - n_long) & others)
        if not len(rows):
            return rows
        counts = counts[rows]
        for lo in range(0, n_long, width := max(1, 1_000_000 // len(rows))):
            probe = (lists[cut + lo : cut + lo + width, None] * len(self.node) + rows).ravel()
            at = np.minimum(np.searchsorted(self.places, probe), len(self.places) - 1)
            counts = counts + (self.places[at] == probe).reshape(-1, len(rows)).sum(axis=0)
        return rows[100 * counts >= self.percent * (n + self.sizes[rows] - counts)]

    def root(self, component: int) -> int:
        while component in self.into:
            component = self.into[component]
        return component

    def search(self, node: int, component: int, query: np.ndarray) -> None:
        """Links of one set to the nearest row of each class that it is linked with and not yet in."""
        component = self.root(component)
        others = self.component != component
        if not others.any():
            return
        rows = self.occurring(query, others)
        for other, first in zip(*np.unique(self.component[rows], return_index=True), strict=True):
            self.found.append((int(node), int(self.node[rows[first]])))
            self.into[int(other)] = component
            self.component[self.component == other] = component

    def ask(self, node: np.ndarray, component: np.ndarray, sizes: np.ndarray, shingles: np.ndarray) -> None:
        if not self.asked and self.parts:
            self.build()
        self.asked = True
        if self.known is None:  # a part of a home may have no sets of its own
            return
        at = np.concatenate([[0], np.cumsum(sizes)])
        for k in range(len(node)):
            self.search(node[k], int(component[k]), shingles[at[k] : at[k + 1]])

    def links(self) -> list[tuple[int, int]]:
        """All links; of a shard that no other sets were searched in, those among its own sets."""
        if not self.asked:
            self.build()
            for k in range(len(self.node)):
                self.search(self.node[k], int(self.component[k]), self.shingles[self.at[k] : self.at[k + 1]])
        return self.found


def search_shards(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(src, dst) in different classes; rows come by shard and whether they are a query."""
    shard, key = None, None

    def done() -> Iterator[pa.RecordBatch]:
        if shard and (found := shard.links()):
            yield rows([("src", pa.int64()), ("dst", pa.int64())], list(zip(*found, strict=True)))

    for batch in batches:
        where, query, node, component = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:4])
        lists = batch.column(4)
        at = np.asarray(lists.offsets).astype(np.int64)
        shingles, at = lists.values.to_numpy()[at[0] : at[-1]], at - at[0]
        change = np.flatnonzero((where[1:] != where[:-1]) | (query[1:] != query[:-1])) + 1
        cuts = [0, *change.tolist(), len(where)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if key != where[lo]:
                yield from done()
                shard, key = Shard(percent), where[lo]
            (shard.ask if query[lo] else shard.add)(node[lo:hi], component[lo:hi].copy(), np.diff(at[lo : hi + 1]), shingles[at[lo] : at[hi]])
    yield from done()


def searched(sets: DataFrame, dealt: DataFrame, percent: int) -> DataFrame:
    """Links (src, dst) that the shards find; dealt: (shard, query, node, component)."""
    rows_in = dealt.join(sets.select("node", "shingles"), "node").select("shard", "query", "node", "component", "shingles")
    ordered = rows_in.repartition("shard").sortWithinPartitions("shard", "query", "node")
    return ordered.mapInArrow(functools.partial(search_shards, percent=percent), "src long, dst long")


def settle_shards(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, n, shard) of every set, and (shard, node) of shards of several: a home is cut by size, and its first set is in all of its shards."""
    each = sets.select("node", "n", F.explode("homes").alias("home"))
    popular = each.groupBy("home").agg(F.count("*").alias("sets"))
    home = settled(each.join(popular, "home").groupBy("node", "n").agg(F.max(F.struct("sets", "home"))["home"].alias("home")))
    sizes = home.groupBy("home").agg(F.sum("n").alias("size"), F.count("*").alias("sets"), F.min("node").alias("first"))
    sizes = sizes.select("home", "sets", "first", F.ceil(F.col("size") / SHARD_SHINGLES).cast("int").alias("parts"))
    shard = lambda part: F.xxhash64("home", part)
    placed = settled(home.join(sizes, "home").select("node", "n", shard(F.pmod(F.xxhash64("node"), "parts").cast("int")).alias("shard"), "home", "sets", "parts", "first"))
    shared = placed.filter("sets > 1")
    firsts = shared.filter("node = first AND parts > 1").select(F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), shard)).alias("shard"), "node")
    return placed.select("node", "n", "shard"), shared.select("shard", "node").unionByName(firsts).distinct()


def token_keys(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(node, key, asks): keys of combinations of tokens, of one token up to as many as leave at most MAX_KEYS keys.

    Rows in: node, n, and its tokens (size of the list, name, weight) in the order that all sets have. Of a linked set of
    another class the first k common tokens are among the shortest prefix whose rest, together with the k - 1 heaviest
    tokens of the prefix, weighs less than the required overlap. A set asks with its longest combinations only, and is
    found by shorter ones where the other set has none as long.
    """
    for batch in batches:
        nodes, sizes, tokens = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        out_node, out_key, out_asks = [], [], []
        for node, n, own in zip(nodes, sizes, tokens, strict=True):
            least = int(needed(np.int64(n), percent))
            names, weight = [t["token"] for t in own], [t["weight"] for t in own]
            left, end, ranked = sum(weight), 0, []
            levels: list[list[tuple[int, ...]]] = []
            while left >= least or levels:
                k = len(levels) + 1
                heavy = lambda: sum(ranked[max(0, end - k + 1) :]) if k > 1 else 0  # noqa: B023, E731
                while end < len(own) and left + heavy() >= least and (k == 1 or math.comb(end, k) <= MAX_KEYS):
                    left -= weight[end]
                    bisect.insort(ranked, weight[end])
                    end += 1
                if left + heavy() >= least or k > 1 and math.comb(end, k) > MAX_KEYS:
                    break
                levels.append(list(itertools.combinations(range(end), k)))
            for k, level in enumerate(levels, 1):
                for chosen in level:
                    digest = hashlib.blake2b(b"".join(int(names[i]).to_bytes(8, "little", signed=True) for i in chosen), digest_size=8)
                    out_node.append(node)
                    out_key.append(int.from_bytes(digest.digest(), "little", signed=True))
                    out_asks.append(k == len(levels))
        yield rows([("node", pa.int64()), ("key", pa.int64()), ("asks", pa.bool_())], [out_node, out_key, out_asks])


def short_keys(sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, cap, shard, class, asks): the shingles of short lists among a set's n - T + 1 shortest; cap: what a partner's size can be."""
    T = F.ceil(F.col("n") * percent / 100)
    prefix = F.least((F.col("n") - T + 1).cast("int"), F.col("n_short").cast("int"))
    posted = known.join(sets.select("node", "n_short", "shingles"), "node").select("node", "n", "shard", "class", F.posexplode(F.slice("shingles", F.lit(1), prefix)).alias("i", "key"))
    # a partner of m shingles needs (n - i) * (100 + percent) >= percent * (n + m), as i shingles before are not shared
    return posted.select("key", "node", "n", (F.floor((F.col("n") - F.col("i")) * (100 + percent) / percent) - F.col("n")).alias("cap"), "shard", "class", F.lit(True).alias("asks"))


def long_keys(sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, cap, shard, class, asks) for sets whose common shingles with others may all be in long lists.

    Shingles that the same sets have, as those of a paragraph that many texts hold, are one token. Lists of one class are
    left out, as no set of another class has them.
    """
    T = F.ceil(F.col("n") * percent / 100)
    able = known.join(sets.select("node", "n_short", "shingles"), "node").filter(F.col("n") - F.col("n_short") >= T)
    # the first shingle that two linked sets share is among the first n - T + 1 of both
    first = able.select("node", "class", F.explode(F.slice("shingles", F.col("n_short").cast("int") + 1, (F.col("n") - T + 1 - F.col("n_short")).cast("int"))).alias("shingle"))
    meeting = first.groupBy("shingle").agg(F.min("class").alias("a"), F.max("class").alias("z")).filter("a <> z")
    able = able.join(settled(first.join(meeting, "shingle").select("node").distinct()), "node", "left_semi")
    posted = able.select("node", "class", F.explode(F.slice("shingles", F.col("n_short").cast("int") + 1, F.col("n").cast("int"))).alias("shingle"))
    name = F.struct(F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum"))
    lists = posted.groupBy("shingle").agg(F.min("class").alias("a"), F.max("class").alias("z"), name["size"].alias("size"), name["sum"].alias("sum")).filter("a <> z")
    lists = lists.select("shingle", "size", F.xxhash64("size", "sum").alias("token"))
    tokens = posted.select("node", "shingle").join(lists, "shingle").groupBy("node", "size", "token").agg(F.count("*").alias("weight"))
    grouped = tokens.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("size", "token", "weight"))).alias("tokens"))
    keys = known.select("node", "n").join(grouped, "node").mapInArrow(functools.partial(token_keys, percent=percent), "node long, key long, asks boolean")
    return keys.join(known, "node").select("key", "node", "n", F.floor(F.col("n") * 100 / percent).alias("cap"), "shard", "class", "asks")


def distant(sets: DataFrame, shard: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Which sets have to be searched in which shards besides: (shard, query, node, component), with the shards' own sets."""
    sizes = label.groupBy("component").agg(F.count("*").alias("members"))
    known = settled(label.join(sizes, "component").join(shard, "node").select("node", "n", "shard", F.struct("members", "component").alias("class")))
    posted = short_keys(sets, known, percent).unionByName(long_keys(sets, known, percent))
    lists = posted.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("z"), F.min("shard").alias("b"), F.max("shard").alias("y"), F.min("n").alias("least"), F.max("cap").alias("most"))
    mixed = lists.filter("a <> z AND b <> y").select("key", "least", "most")
    fits = settled(posted.join(mixed, "key").filter("cap >= least AND n <= most").drop("least", "most"))
    # of each shard, what another set needs to know to ask there; sets that don't ask by a key are asked by those that do
    there = fits.groupBy("key", F.col("shard").alias("to")).agg(F.max("class").alias("high"), F.max(F.when(~F.col("asks"), F.col("class"))).alias("silent"), F.min("class").alias("low"), F.min("n").alias("smallest"), F.max("cap").alias("widest"))
    asking = fits.filter("asks").join(there, "key").filter("to <> shard AND cap >= smallest AND n <= widest")
    asking = asking.filter("class < high OR (silent IS NOT NULL AND (low <> class OR high <> class))")
    queries = asking.select(F.col("to").alias("shard"), "node", F.col("class.component").alias("component")).distinct()
    queries = settled(queries.select("shard", F.lit(True).alias("query"), "node", "component"))
    index = known.join(queries.select("shard").distinct(), "shard", "left_semi").select("shard", F.lit(False).alias("query"), "node", F.col("class.component").alias("component"))
    return index.unionByName(queries)


def joined(label: DataFrame, new: DataFrame) -> DataFrame:
    """Classes (node, component) after new links: components of the classes, not of the nodes."""
    a = label.select(F.col("node").alias("src"), F.col("component").alias("a"))
    b = label.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    pairs = settled(new.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")).filter("src <> dst").distinct())
    if pairs.isEmpty():
        return label
    merged = components(pairs).select(F.col("node").alias("component"), F.col("component").alias("into"))
    return settled(label.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component")))


def names(id_col: str, text_col: str) -> list[Column]:
    """What names a document: its id, 0 where it is null, whether it is null, and a hash of its text."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return [F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), F.xxhash64(text)]


def grouped(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, component, n_shingles, component_id) for every row of docs; component: a node's key, -1 without words."""
    ensure_checkpoint_dir(docs.sparkSession)
    buckets = shards(docs, text_col, BUCKET_BYTES)
    texts = docs.select(*[c.alias(n) for c, n in zip(names(id_col, text_col), ("doc_id", "no_id", "text_hash"), strict=True)], F.col(text_col).cast("string").alias("text"))
    schema = "bucket int, slice long, kind int, a binary, b binary"
    packed = texts.mapInArrow(functools.partial(pack, words=words, buckets=buckets), schema)
    counted = settled(packed.repartition(buckets, "bucket").mapInArrow(count_unique, schema))
    table = settled(counted.filter(F.col("kind") != HEAVY).groupBy("slice").applyInArrow(assemble, "doc_id long, text_hash long, node long, n long, n_unique long"))
    enough = F.col("n") - F.ceil(F.col("n") * percent / 100)
    hopeful = table.filter((F.col("n") > 0) & (F.col("n_unique") <= enough)).groupBy("node").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text_hash")).alias("d"))
    chosen = texts.join(hopeful.select("node", "d.*"), ["doc_id", "no_id", "text_hash"]).select("text", "node")
    sets = settled(chosen.mapInArrow(functools.partial(make_sets, words=words, long=heaviest(counted)), SETS_SQL).dropDuplicates(["node"]))
    label = sets.select("node", F.col("node").alias("component"))
    shard, shared = settle_shards(sets)
    near = shared.select("shard", F.lit(False).alias("query"), "node", F.col("node").alias("component"))
    label = joined(label, settled(searched(sets, near, percent)))
    label = joined(label, settled(searched(sets, distant(sets, shard, label, percent), percent)))
    smallest = table.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    linked = label.join(smallest, "node").groupBy("component").agg(F.min("first").alias("least"))
    least = smallest.join(label, "node", "left").join(linked, "component", "left").select("node", "component", F.coalesce("least", "first").alias("component_id"))
    component = F.coalesce("component", "node").alias("component")
    return table.join(least, "node", "left").select("doc_id", "text_hash", component, F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs; see the module's notes."""
    return grouped(docs, id_col, text_col, words, percent).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each class: of the document with the smallest id, and of rows with that id the one with the smallest text.

    A document without an id comes after all others. Documents without words are a class each: those of one id, and
    every row without an id.
    """
    found = settled(grouped(docs, id_col, text_col, words, percent).filter("doc_id <=> component_id"))
    no_id = F.col("doc_id").isNull()
    single = F.when(no_id & (F.col("n_shingles") == 0), F.lit(True)).otherwise(F.lit(False))
    members = found.groupBy(F.coalesce("doc_id", F.lit(0)).alias("_id"), no_id.alias("_no_id"), F.col("text_hash").alias("_hash"), F.col("component").alias("_class"), single.alias("_single")).count()
    sizes = members.groupBy("_class", "_id", "_no_id").agg(F.sum("count").alias("_rows"))
    members = settled(members.join(sizes, ["_class", "_id", "_no_id"]).withColumn("_single", F.expr("_single OR _rows = 1")))
    named = docs.select(*[c.alias(k) for c, k in zip(names(id_col, text_col), KEY, strict=True)], F.struct(*docs.columns).alias("row"))
    kept = named.join(members.filter("_single"), KEY, "left_semi").select("row.*")
    several = members.filter("NOT _single").select(*KEY, "_class")
    if several.isEmpty():
        return kept
    least = F.min(F.struct(*[F.col("row")[c].alias(c) for c in [text_col, *[c for c in docs.columns if c != text_col]]]))
    again = named.join(several, KEY).groupBy("_class", "_id", "_no_id").agg(least.alias("row"))
    return kept.unionByName(again.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
