"""Phrase collocation mining on depth-limited count tries.

1. A shard, some megabytes of documents, counts its phrases in a trie of depth four: at each word the path of the words
   from there to the end of the piece, at most four, is one step down. A shard knows its trie as sorted distinct paths
   with counts; a word is a number in the sorted dictionary of the shard, one dictionary for all languages.
2. The trie is serialised in that order: for each path how many words it shares with the path before, the words that are
   new, and its count. It is sent in ranges of prefixes, each with the part of the dictionary that it uses. The limits of
   the ranges are quantiles of sampled paths, so a first word or pair that is everywhere is cut into several ranges; the
   sample decides about the balance only, not about any result.
3. A range merges the sorted runs of all shards. A node whose phrases lie in more than one range is a prefix of a limit;
   for these few nodes each shard sends its whole count to every range that touches them, so all counts of a range are
   those of the corpus. Walking down the merged trie gives each frequent node with the counts of its left parts.
4. A node's suffix link leads to the phrase without its first word, which may be in another range: one join for each
   depth follows the links and gives the counts of all right parts.

Counts are exact: words are compared as strings between shards (within a shard by 64-bit hashes of language and word),
nothing is pruned before the corpus-wide count, and scores are computed on decimals. Memory follows from the bytes of a
shard and of a range, not from the corpus. Only phrases that reach min_count anywhere are rows.

Defined results: a null text is an empty text; a null lang is `und`; repeated rows and equal ids count each; ties of the
score are broken as the ranking says, so no two phrases are equal; an empty table gives an empty result; other columns,
whatever their names, are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm import hashing as hs
from sessionlake.session import ensure_checkpoint_dir, settled

DEPTH, MIN_COUNT, SCALE, COVERED_PERCENT, TOP = 4, 30, 2_000_000, 80, 2000
#: Bytes of text of a shard, and for each range.
SHARD_BYTES, RANGE_BYTES = 8_000_000, 8_000_000
#: Sampled paths for each range, and one of how many words of a sampled text is sampled.
SAMPLED, EVERY = 64, 40
#: Rows that go to a Python worker at once: a shard's part of a range has some hundred kilobytes.
BATCH_ROWS = 64
#: The bytes of [.,;:!?\x0A-\x0D], which end a piece, and of [\x20\x09].
ENDS = np.isin(np.arange(256), [*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D])
BREAKS = ENDS | np.isin(np.arange(256), [0x20, 0x09])

PACKED = pa.schema([("range", pa.int32()), ("langs", pa.list_(pa.string())), ("words", pa.string()), ("shared", pa.binary()), ("steps", pa.binary()), ("counts", pa.binary()), ("edges", pa.binary())])
PACKED_SQL = "range int, langs array<string>, words string, shared binary, steps binary, counts binary, edges binary"
NODES = pa.schema([("lang", pa.string()), ("depth", pa.int32()), ("phrase", pa.string()), ("a", pa.int64()), ("lefts", pa.list_(pa.int64()))])
NODES_SQL = "lang string, depth int, phrase string, a long, lefts array<long>"
#: A path: up to four keys "lang<tab>word", filled up with empty strings, which come before all words.
Path = tuple[str, ...]


class Paths:
    """Sorted distinct paths as four columns of word numbers (0: the piece has ended) with their counts."""

    def __init__(self, columns: list[np.ndarray], counts: np.ndarray):
        self.columns, self.counts = columns, counts
        self.sums = np.concatenate([[0], np.cumsum(counts)])

    def __len__(self) -> int:
        return len(self.counts)

    @classmethod
    def merged(cls, columns: list[np.ndarray], counts: np.ndarray | None, base: int) -> Paths:
        """Equal paths added up. Stable sorting makes use of runs that are sorted already: a merge of all runs at once.

        The list of columns is emptied on the way, so that a task holds each of them for as long as it is needed only.
        """
        if not len(columns[0]):
            return cls(list(columns), np.zeros(0, np.int64))
        code, seen = None, []
        while columns:
            pair = columns.pop(0).astype(np.int64)
            pair *= base
            pair += columns.pop(0)
            values, place = np.unique(pair, return_inverse=True)
            del pair
            seen.append(values)
            if code is None:
                code = place.reshape(-1)
            else:
                code *= len(values)
                code += place.reshape(-1)
            del place
        if counts is None:
            code.sort()
        else:
            order = np.argsort(code, kind="stable")
            code, counts = code[order], counts[order]
            del order
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        total = np.diff(first, append=len(code)) if counts is None else np.add.reduceat(counts, first)
        head, tail = np.divmod(code[first], len(seen[1]))
        del code
        head, tail = seen[0][head], seen[1][tail]
        return cls([c.astype(np.int32) for c in (head // base, head % base, tail // base, tail % base)], total.astype(np.int64))

    def locate(self, numbers: list[tuple[int, bool]]) -> tuple[int, list[int]]:
        """(the first path not before a limit, counts of the limit's one- to three-word prefixes); numbers: of its words, and whether they are here."""
        low, high, counts = 0, len(self), [0] * (DEPTH - 1)
        for d, (number, known) in enumerate(numbers):
            column = self.columns[d][low:high]
            a = low + int(np.searchsorted(column, number, "left"))
            if not known:
                return a, counts
            high = low + int(np.searchsorted(column, number, "right"))
            low = a
            if d < DEPTH - 1 and number:
                counts[d] = int(self.sums[high] - self.sums[low])
        return low, counts


def numbered(limit: Path, keys: list[str]) -> list[tuple[int, bool]]:
    """A limit's words as numbers of a sorted dictionary; where a word is missing, the number of the next one."""
    out = []
    for key in limit:
        if not key:
            out.append((0, True))
            continue
        at = bisect.bisect_left(keys, key)
        out.append((at + 1, at < len(keys) and keys[at] == key))
    return out


class Occurrences:
    """The words of a run of documents: where they are, their hashes, and whether the next word is in the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: list[str]):
        self.data = hs.LOWER[data]
        self.starts, self.ends, bounds = hs.words(self.data, offsets, BREAKS)
        self.langs = langs
        self.doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(bounds))
        salts = {lang: int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little") for lang in set(langs)}
        salt = np.array([salts[lang] for lang in langs], hs.U)
        self.hashes = hs.mix(hs.word_hashes(self.data, self.starts, self.ends) ^ salt[self.doc]) if len(self.doc) else np.zeros(0, hs.U)
        piece = np.cumsum(ENDS[self.data])[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        self.joined = np.zeros(len(self.doc), bool)
        self.joined[:-1] = (piece[1:] == piece[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.starts, self.ends = self.starts.astype(np.int32), self.ends.astype(np.int32)

    def key(self, k: int) -> str:
        return f"{self.langs[self.doc[k]]}\t{self.data[self.starts[k] : self.ends[k]].tobytes().decode()}"


def columns_of(numbers: np.ndarray, joined: np.ndarray) -> list[np.ndarray]:
    """For each word the numbers of it and of the next three in its piece."""
    out, reach = [numbers], np.ones(len(numbers), bool)
    for d in range(1, DEPTH):
        reach = reach & np.concatenate([joined[d - 1 :], np.zeros(d - 1, bool)])[: len(numbers)]
        ahead = np.concatenate([numbers[d:], np.zeros(d, numbers.dtype)])[: len(numbers)]
        out.append(np.where(reach, ahead, 0))
    return out


class Shard:
    """The count trie of some documents."""

    def __init__(self, parts: list[Occurrences]):
        _, first, inverse = np.unique(np.concatenate([p.hashes for p in parts]), return_index=True, return_inverse=True)
        at = np.cumsum([0, *(len(p.hashes) for p in parts)])
        of = np.searchsorted(at, first, "right") - 1
        keys = [parts[p].key(k) for p, k in zip(of.tolist(), (first - at[of]).tolist(), strict=True)]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.keys = [keys[k] for k in order]
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(1, len(keys) + 1)
        joined = np.concatenate([p.joined for p in parts])
        parts.clear()
        numbers = rank[inverse.reshape(-1)].astype(np.int32)
        del inverse, first, of
        self.paths = Paths.merged(columns_of(numbers, joined), None, len(keys) + 1)

    def serialised(self, limits: list[Path]) -> Iterator[tuple]:
        """A row for each range that the shard has something of."""
        places = [self.paths.locate(numbered(limit, self.keys)) for limit in limits]
        none = (0, [0] * (DEPTH - 1))
        for k, (low, high) in enumerate(zip([none, *places], [*places, (len(self.paths), none[1])], strict=True)):
            edges = np.array(low[1] + high[1], np.int64)
            if low[0] == high[0] and not edges.any():
                continue
            columns = [c[low[0] : high[0]] for c in self.paths.columns]
            used = np.unique(np.concatenate(columns))
            used = used[used > 0]
            langs, words, last = [], [], None
            for n in used.tolist():
                lang, _, word = self.keys[n - 1].rpartition("\t")
                if lang != last:
                    langs.append(lang)
                    words.append("")
                    last = lang
                words.append(word)
            local = [np.where(c > 0, np.searchsorted(used, c) + 1, 0) for c in columns]
            same = np.ones(len(columns[0]), bool)
            shared = np.zeros(len(columns[0]), np.uint8)
            for c in local[:-1]:
                same[1:] &= c[1:] == c[:-1]
                same[:1] = False
                shared += same
            steps = b"".join(packed_planes(c[shared <= d]) for d, c in enumerate(local))
            yield (k, langs, "\n".join(words), shared.tobytes(), steps, packed_planes(self.paths.counts[low[0] : high[0]]), edges.tobytes())


def packed_planes(a: np.ndarray) -> bytes:
    """Numbers below 2**32, byte plane by byte plane."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(packed: bytes, at: int, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").reshape(-1).astype(np.int64)


def tries(batches: Iterator[pa.RecordBatch], limits: list[Path]) -> Iterator[pa.RecordBatch]:
    parts: list[Occurrences] = []
    size = 0

    def done() -> Iterator[pa.RecordBatch]:
        for row in Shard(parts).serialised(limits):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, PACKED.types, strict=True)], schema=PACKED)

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for row, data, offsets in hs.text_slices(batch.column(1)):
            parts.append(Occurrences(data, offsets, langs[row : row + len(offsets) - 1]))
            size += len(data)
            if size >= SHARD_BYTES:
                yield from done()
                size = 0
    if parts:
        yield from done()


def unpacked(shared: bytes, steps: bytes, counts: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """The four columns of a serialised trie, and its counts."""
    kept, columns, at = np.frombuffer(shared, np.uint8), [], 0
    for d in range(DEPTH):
        new = kept <= d
        n = int(new.sum())
        columns.append(from_planes(steps, at, n)[np.cumsum(new) - 1] if len(kept) else np.zeros(0, np.int64))
        at += 4 * n
    return columns, from_planes(counts, 0, len(kept))


class Range:
    """The merged trie of a range of prefixes."""

    def __init__(self, index: int, limits: list[Path]):
        self.low = limits[index - 1] if index else None
        self.high = limits[index] if index < len(limits) else None
        self.columns: list[list[np.ndarray]] = []
        self.counts: list[np.ndarray] = []
        self.keys: list[str] = [key for limit in (self.low, self.high) if limit for key in limit if key]
        self.bases: list[tuple[int, int]] = []
        self.edges = np.zeros(2 * (DEPTH - 1), np.int64)

    def add(self, langs: list[str], words: str, shared: bytes, steps: bytes, counts: bytes, edges: bytes) -> None:
        begin, runs, lang = len(self.keys), iter(langs), ""
        for word in words.split("\n") if words or langs else []:
            if word:
                self.keys.append(lang + word)
            else:
                lang = next(runs) + "\t"
        columns, n = unpacked(shared, steps, counts)
        self.columns.append([c.astype(np.int32) for c in columns])
        self.counts.append(n)
        self.bases.append((begin, len(self.keys)))
        self.edges += np.frombuffer(edges, np.int64)

    def nodes(self, min_count: int) -> Iterator[tuple[str, int, str | None, int, list[int] | None]]:
        """(lang, depth, phrase, count, counts of its left parts) of frequent nodes, and (lang, 0, null, words, null)."""
        encoded = pa.array(self.keys, pa.string()).dictionary_encode()
        keys = encoded.dictionary.to_pylist()
        order = sorted(range(len(keys)), key=keys.__getitem__)
        keys = [keys[k] for k in order]
        rank = np.zeros(len(keys), np.int64)
        rank[order] = np.arange(1, len(keys) + 1)
        number = (rank[encoded.indices.to_numpy()] if len(keys) else rank).astype(np.int32)
        for columns, (a, b) in zip(self.columns, self.bases, strict=True):
            own = np.concatenate([[0], number[a:b]]).astype(np.int32)
            columns[:] = [own[c] for c in columns]
        self.keys.clear()
        merged = [np.concatenate([run[d] for run in self.columns]) for d in range(DEPTH)]
        self.columns.clear()
        counts = np.concatenate(self.counts)
        self.counts.clear()
        paths = Paths.merged(merged, counts, len(keys) + 1)
        langs = {}
        for k, n in zip(*(x.tolist() for x in sums_by(paths.columns[0], paths.counts)), strict=True):
            lang = keys[k - 1].rpartition("\t")[0]
            langs[lang] = langs.get(lang, 0) + n
        for lang, n in langs.items():
            yield lang, 0, None, n, None
        # what the limits' prefixes count in the whole corpus
        whole: dict[tuple[int, ...], int] = {}
        owned: list[tuple[int, ...]] = []
        elsewhere: set[tuple[int, ...]] = set()
        for limit, counts in ((self.low, self.edges[: DEPTH - 1]), (self.high, self.edges[DEPTH - 1 :])):
            if limit is None:
                continue
            numbers = tuple(n for n, _ in numbered(limit, keys))
            for d in range(1, DEPTH):
                if numbers[d - 1]:
                    whole[numbers[:d]] = int(counts[d - 1])
                    if any(numbers[d:]):  # else it is the limit itself, which begins a range
                        if limit is self.high:
                            owned.append(numbers[:d])
                        else:
                            elsewhere.add(numbers[:d])
        low = tuple(n for n, _ in numbered(self.low, keys)) if self.low else ()
        totals: list[np.ndarray] = []
        starts: list[np.ndarray] = []
        change = np.zeros(len(paths), bool)
        change[:1] = True
        here: set[tuple[int, ...]] = set()
        for d, column in enumerate(paths.columns):
            change[1:] |= column[1:] != column[:-1]
            starts.append(np.flatnonzero(change))
            totals.append(np.add.reduceat(paths.counts, starts[d]) if len(paths) else np.zeros(0, np.int64))
            for prefix, n in whole.items():
                if len(prefix) == d + 1:
                    a, b = 0, len(paths)
                    for c, v in zip(paths.columns, prefix, strict=False):
                        a, b = a + int(np.searchsorted(c[a:b], v, "left")), a + int(np.searchsorted(c[a:b], v, "right"))
                    if a < b:
                        here.add(prefix)
                        totals[d][np.searchsorted(starts[d], a)] = n
            frequent = np.flatnonzero((totals[d] >= min_count) & (column[starts[d]] > 0))
            at = starts[d][frequent]
            lefts = [totals[e][np.searchsorted(starts[e], at, "right") - 1] for e in range(d)]
            numbers = [c[at].tolist() for c in paths.columns[: d + 1]]
            for row in zip(totals[d][frequent].tolist(), *(x.tolist() for x in lefts), *numbers, strict=True):
                path = row[d + 1 :]
                if path not in elsewhere:
                    yield self.node(keys, path, row[0], list(row[1 : d + 1]))
        for prefix in owned:
            if prefix not in here and prefix not in elsewhere and whole[prefix] >= min_count and prefix + (0,) * (DEPTH - len(prefix)) >= low:
                yield self.node(keys, prefix, whole[prefix], [whole[prefix[:e]] for e in range(1, len(prefix))])

    @staticmethod
    def node(keys: list[str], path: tuple[int, ...], count: int, lefts: list[int]) -> tuple[str, int, str, int, list[int]]:
        words = [keys[k - 1].rpartition("\t") for k in path]
        return words[0][0], len(path), " ".join(w for _, _, w in words), count, lefts


def sums_by(numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the counts of each of some sorted numbers."""
    first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])) if len(numbers) else np.zeros(0, np.int64)
    return numbers[first], np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)


def merge_ranges(batches: Iterator[pa.RecordBatch], limits: list[Path], min_count: int) -> Iterator[pa.RecordBatch]:
    """Frequent nodes of each range; rows come by range."""
    index, merging = None, None

    def done() -> Iterator[pa.RecordBatch]:
        rows = []
        for row in merging.nodes(min_count):
            rows.append(row)
            if len(rows) >= 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), NODES.types, strict=True)], schema=NODES)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), NODES.types, strict=True)], schema=NODES)

    for batch in batches:
        for k in range(batch.num_rows):
            own, *rest = (c[k].as_py() for c in batch.columns)
            if own != index:
                if merging is not None:
                    yield from done()
                index, merging = own, Range(own, limits)
            merging.add(*rest)
    if merging is not None:
        yield from done()


def sampled_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every fortieth word's path of some texts."""
    for batch in batches:
        langs, out = batch.column(0).to_pylist(), []
        for row, data, offsets in hs.text_slices(batch.column(1)):
            words = Occurrences(data, offsets, langs[row : row + len(offsets) - 1])
            for k in range(0, len(words.doc), EVERY):
                path = [words.key(k)]
                while len(path) < DEPTH and words.joined[k]:
                    k += 1
                    path.append(words.key(k))
                out.append(path + [""] * (DEPTH - len(path)))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], names=["path"])


def range_limits(texts: DataFrame) -> list[Path]:
    """Quantiles of sampled paths: one range for every RANGE_BYTES of text, at least as many as Spark's shuffles have."""
    size, count = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    ranges = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // RANGE_BYTES))
    wanted = SAMPLED * ranges
    share = max(1, int((size or 0) / (6.5 * EVERY * wanted)))  # of one in so many texts
    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    sample = sorted(tuple(r["path"]) for r in some.mapInArrow(sampled_paths, "path array<string>").collect())
    return sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, depth, phrase, a, lefts) of all phrases of one to four words with a >= min_count; depth 0: a lang's words."""
    ensure_checkpoint_dir(docs.sparkSession)
    lang, text = F.col(lang_col).cast("string"), F.col(text_col).cast("string")
    texts = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    limits = range_limits(texts)
    packed = texts.mapInArrow(functools.partial(tries, limits=limits), PACKED_SQL)
    dealt = packed.repartitionById(len(limits) + 1, F.col("range")).sortWithinPartitions("range")
    return settled(dealt.mapInArrow(functools.partial(merge_ranges, limits=limits, min_count=min_count), NODES_SQL), BATCH_ROWS)


def with_rights(nodes: DataFrame) -> DataFrame:
    """The candidates with the counts of their right parts, longest first, along suffix links: one join for each depth."""
    longer = nodes.filter("depth = 1").select("lang", "phrase", "a", F.array().cast("array<long>").alias("rights"))
    out = None
    for depth in range(2, DEPTH + 1):
        linked = longer.select("lang", F.col("phrase").alias("link"), F.concat(F.array("a"), "rights").alias("rights"))
        here = nodes.filter(F.col("depth") == depth).withColumn("link", F.expr("substring(phrase, instr(phrase, ' ') + 1)"))
        found = settled(here.join(linked, ["lang", "link"]).select("lang", "depth", "phrase", "a", "lefts", "rights"))
        longer = found
        out = found if out is None else out.unionByName(found)
    return out


def contained(depth: Column) -> Column:
    """The phrases of two words or more inside a candidate."""
    words = F.split("phrase", " ")
    pairs = F.transform(F.sequence(F.lit(1), depth - 1), lambda i: F.array_join(F.slice(words, i, 2), " "))
    triples = F.when(depth == DEPTH, F.transform(F.sequence(F.lit(1), depth - 2), lambda i: F.array_join(F.slice(words, i, 3), " "))).otherwise(F.array())
    return F.array_distinct(F.concat(pairs, triples))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two to four words."""
    nodes = frequent_phrases(docs, lang_col, text_col, min_count)
    words = nodes.filter("depth = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    candidates = with_rights(nodes)
    score = f"CAST((CAST(a AS DECIMAL(20, 0)) * {SCALE}) DIV (lefts[k - 1] + rights[k - 1]) AS LONG)"
    cuts = F.expr(f"transform(sequence(1, depth - 1), k -> struct({score} AS score, k AS k, lefts[k - 1] AS l, rights[k - 1] AS r))")
    scored = candidates.withColumn("cut", F.array_min(cuts)).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    longer = candidates.filter("depth > 2").select("lang", F.explode(contained(F.col("depth"))).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(f"longest IS NULL OR 100 * longest < {COVERED_PERCENT} * a")
    place = F.expr("row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)")
    ranked = kept.withColumn("rank", place).filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
