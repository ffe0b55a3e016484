"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of its documents' tokens. Every window of 2048 tokens visits the queues in order; a visit adds
the queue's share of the window to its deficit counter and serves as many whole tokens as the counter holds, which cuts
documents where they have to be. What is left of a counter is carried to the next window. The counters are those of a
binary tree over the queues: at each node the left part has a counter and the right part gets what the left one leaves.
So the served tokens of a window always add up to the whole window, no counter ever owes tokens that it has served, and
a queue is never further from its share than the tree has levels above it, however many windows there are.

A counter after w windows is the remainder of w shares, so a task knows the counters with which any window begins
without looking at the windows before: it finds the window that its first token falls into, by the counters there, and
goes on from window to window. Tokens are made once, kept in the checkpoint folder, and never shuffled by
sequence; what is exchanged are sums for each partition and queue, added up in two levels.

Targets are the sources' shares of all tokens, or given by the caller. When a queue runs dry, the others go on by their
own targets (a new phase); what is left in the end, and sources without a target, is packed by shares of what is left.
The last tokens, too few for a window, fill sequences whose lengths are powers of two, which need no padding.

Defined results: a null text is an empty text, which is the end mark alone; a null source is a queue of its own; a null
doc_id stays null; repeated rows are packed as rows of their own; an empty table gives an empty result; other columns,
whatever their names, are ignored; texts of any length are read whole. A window costs a step for each of its sources, so
sources are meant to be few against 2048. Queues follow the order of the input's partitions, and of rows in them.
"""

from __future__ import annotations

import bisect
import functools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.llm.op02_bpe import byte_alphabet
from sessionlake.session import ensure_checkpoint_dir, settled

WINDOW, END_ID = 2048, 1
#: The pattern that splits text before merges, as the vocabulary's pre-tokenizer has it (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Partitions whose sums are added up together before the sums of such groups are.
GROUP = 1024
#: Token ids in one batch between tasks and Spark.
BATCH_IDS = 4_000_000


def tokenizer(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by a vocabulary file (tokenizers JSON, byte-level BPE), special tokens included.

    Merges that are ordered as their ids allow the faster of two libraries with equal ids; other files take the file's own.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    made = [vocab[a + b] for a, b in merges]
    pre = spec["pre_tokenizer"]
    plain = (pre["type"], pre.get("add_prefix_space"), pre.get("use_regex"), spec["normalizer"]) == ("ByteLevel", False, True, None)
    if made == sorted(made) and len(vocab) == len(merges) + 256 and plain:
        import tiktoken

        bytes_of = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(bytes_of[c] for c in token): i for token, i in vocab.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: encoding.encode_to_numpy(text, allowed_special="all")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return lambda text: np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)


TOKENS = pa.schema([("part", pa.int64()), ("queue", pa.string()), ("doc_id", pa.int64()), ("at", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
TOKENS_SQL = "part long, queue string, doc_id long, at long, doc_tokens long, ids binary"
_tokenizers: dict[str, Callable[[str], np.ndarray]] = {}


def tokenized(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Each document's ids and its place among the tokens that its source has in this partition."""
    if path not in _tokenizers:
        _tokenizers[path] = tokenizer(path)
    encode, part, end = _tokenizers[path], TaskContext.get().partitionId(), np.array([end_id], np.uint32)
    served: dict[str | None, int] = {}
    rows, size = [], 0
    for batch in batches:
        for doc_id, queue, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            ids = np.concatenate([encode(text.as_py() or ""), end])
            packed = ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"\0" + ids.astype("<u4").tobytes()
            at = served.get(queue, 0)
            served[queue] = at + len(ids)
            rows.append((part, queue, doc_id, at, len(ids), packed))
            size += len(ids)
            if size > BATCH_IDS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TOKENS.types, strict=True)], schema=TOKENS)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TOKENS.types, strict=True)], schema=TOKENS)


def unpacked(packed: bytes) -> np.ndarray:
    """Ids of two bytes each; an odd length says that four bytes follow the first."""
    return np.frombuffer(packed, "<u4", offset=1) if len(packed) & 1 else np.frombuffer(packed, "<u2").astype("<u4")


@dataclass
class Phase:
    """Windows in which the same queues are served, and how far each queue had been served before."""

    first: int  # window
    windows: int  # whole ones
    tokens: int  # of all its windows, the last of which may be short
    paths: dict[str | None, list[tuple[int, int, bool]]]  # from the root: weight of the left part, of both, and whether the queue is on the right
    weights: dict[str | None, int]
    total: int
    begun: dict[str | None, int]

    def served(self, queue: str | None, window: int, size: int) -> int:
        """Tokens of a queue in the phase's first windows."""
        t = min(window * size, self.tokens)
        for left, both, right in self.paths[queue]:
            t = t - t * left // both if right else t * left // both
        return t

    def visit(self, queue: str | None, window: int, size: int) -> tuple[int, int]:
        """(tokens that the queues before it serve in a window, tokens that it serves itself)."""
        t, u, others = min(window * size, self.tokens), min((window + 1) * size, self.tokens), 0
        for left, both, right in self.paths[queue]:
            a, b = t * left // both, u * left // both
            if right:
                others += b - a
                t, u = t - a, u - b
            else:
                t, u = a, b
        return others, u - t


def tree_paths(queues: list, weights: dict, above: list[tuple[int, int, bool]]) -> dict[str | None, list[tuple[int, int, bool]]]:
    """The path to each queue in a tree that is cut, at each node, where the weights of its parts differ least."""
    if len(queues) == 1:
        return {queues[0]: above}
    total, left, best = sum(weights[q] for q in queues), 0, (None, 0, 0)
    for k, q in enumerate(queues[:-1], 1):
        left += weights[q]
        if best[0] is None or abs(total - 2 * left) < best[0]:
            best = (abs(total - 2 * left), k, left)
    _, k, left = best
    return tree_paths(queues[:k], weights, [*above, (left, total, False)]) | tree_paths(queues[k:], weights, [*above, (left, total, True)])


class Schedule:
    """Which window, and which place in it, each token of each queue goes to."""

    def __init__(self, supply: dict[str | None, int], targets: dict[str | None, float] | None = None, size: int = WINDOW):
        self.size, self.phases = size, []
        left = {q: n for q, n in sorted(supply.items(), key=lambda kv: (kv[0] is not None, kv[0] or "")) if n}
        self.queues, served, window = list(left), dict.fromkeys(left, 0), 0
        weights = {q: round(targets.get(q, 0) * 10**9) for q in left} if targets is not None else {}
        active = [q for q in left if weights.get(q, 0) > 0]
        while active:
            phase = self.phase(active, weights, window, served, sum(left.values()) + size)
            fits = [self.longest(phase, q, left[q]) for q in active]
            phase.windows = min(fits)
            phase.tokens = phase.windows * size
            if phase.windows:
                self.phases.append(phase)
                window += phase.windows
                for q in active:
                    n = phase.served(q, phase.windows, size)
                    left[q] -= n
                    served[q] += n
            active = [q for q, n in zip(active, fits, strict=True) if n > min(fits)]
        rest = [q for q in left if left[q]]
        if rest:
            tokens = sum(left[q] for q in rest)
            phase = self.phase(rest, left, window, served, tokens)
            phase.windows = tokens // size
            self.phases.append(phase)
        self.by_queue = {q: [p for p in self.phases if q in p.paths] for q in self.queues}
        self.begins = {q: [p.begun[q] for p in own] for q, own in self.by_queue.items()}

    @staticmethod
    def phase(queues: list, weights: dict, window: int, served: dict, tokens: int) -> Phase:
        own = {q: weights[q] for q in queues}
        return Phase(window, 0, tokens, tree_paths(queues, own, []), own, sum(own.values()), {q: served[q] for q in queues})

    def longest(self, phase: Phase, queue: str | None, supply: int) -> int:
        """The most windows that a queue can serve its share of."""
        low, high = 0, phase.tokens // self.size
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if phase.served(queue, middle, self.size) <= supply else (low, middle - 1)
        return low

    def window_of(self, phase: Phase, queue: str | None, x: int) -> int:
        """The window of the phase in which a queue serves its token x."""
        levels, each = len(phase.paths[queue]) + 2, phase.weights[queue] * self.size
        first = max(0, (x - levels) * phase.total // each - 1)
        last = max(0, (x + levels) * phase.total // each) + 2
        while first < last:
            middle = (first + last) // 2
            first, last = (first, middle) if phase.served(queue, middle + 1, self.size) > x else (middle + 1, last)
        return first

    def serve(self, queue: str | None, first: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(sequence, place in it, tokens) of n tokens of a queue from its token `first` on."""
        size = self.size
        for phase, begun in list(zip(self.by_queue[queue], self.begins[queue], strict=True))[bisect.bisect_right(self.begins[queue], first) - 1 :]:
            x = first - begun
            here = min(n, phase.served(queue, phase.windows + 1, size) - x)
            n, first = n - here, first + here
            sparse = size * phase.weights[queue] < phase.total
            w = self.window_of(phase, queue, x)
            taken = x - phase.served(queue, w, size)
            while here:
                others, own = phase.visit(queue, w, size)
                k = min(own - taken, here)
                if k:
                    yield from self.placed(phase.first + w, others + taken, k, min(size, phase.tokens - w * size))
                here, x, taken, w = here - k, x + k, 0, w + 1
                if here and sparse:  # less than a token a window: on to the one with the next
                    w = self.window_of(phase, queue, x)
            if not n:
                return

    def placed(self, window: int, at: int, k: int, tokens: int) -> Iterator[tuple[int, int, int]]:
        """A run of a window: of a short window, over its sequences, whose lengths are powers of two."""
        if tokens == self.size:
            yield window, at, k
            return
        begin = 0
        for bit in range(tokens.bit_length() - 1, -1, -1):
            if tokens >> bit & 1:
                end = begin + (1 << bit)
                here = min(k, end - at)
                if at < end and here > 0:
                    yield window, at - begin, here
                    at, k = at + here, k - here
                window, begin = window + 1, end


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_SQL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cut(batches: Iterator[pa.RecordBatch], schedule: Schedule) -> Iterator[pa.RecordBatch]:
    """Pieces of documents; rows in: queue, first token in its queue, doc_id, doc_tokens, ids."""

    def made(rows: list[tuple], ids: list[np.ndarray]) -> pa.RecordBatch:
        doc_id, start, length, tokens, sequence, offset = zip(*rows, strict=True)
        data = np.concatenate(ids)
        ends = np.concatenate([[0], np.cumsum(np.array(length, np.int64) * 4)]).astype(np.int32)
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        columns = [pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), packed]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in (tokens, sequence, offset))], schema=PIECES)

    rows, ids, size = [], [], 0
    for batch in batches:
        queues, firsts, names, counts = (batch.column(k).to_pylist() for k in range(4))
        for queue, first, doc_id, n, packed in zip(queues, firsts, names, counts, batch.column(4), strict=True):
            ids.append(unpacked(packed.as_py()))
            size += n
            start = 0
            for sequence, offset, length in schedule.serve(queue, first, n):
                rows.append((doc_id, start, length, n, sequence, offset))
                start += length
            if size > BATCH_IDS:
                yield made(rows, ids)
                rows, ids, size = [], [], 0
    if rows:
        yield made(rows, ids)


def pieces(
    docs: DataFrame,
    path: str,
    targets: dict[str | None, float] | None = None,
    size: int = WINDOW,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, start, length, ids (little-endian u32), doc_tokens, sequence_id, offset: each token of docs in one piece."""
    ensure_checkpoint_dir(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.col(text_col).cast("string"))
    tokens = settled(chosen.mapInArrow(functools.partial(tokenized, path=path, end_id=end_id), TOKENS_SQL))
    sums = tokens.groupBy("part", "queue").agg(F.sum("doc_tokens").alias("n")).withColumn("group", F.floor(F.col("part") / GROUP))
    sums = settled(sums)
    groups = sums.groupBy("queue", "group").agg(F.sum("n").alias("all"))
    groups = groups.withColumn("base", F.coalesce(F.sum("all").over(Window.partitionBy("queue").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    supply = {r["queue"]: int(r["n"]) for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    schedule = Schedule(supply, targets, size)
    own = sums.join(groups.select(F.col("queue").alias("q"), F.col("group").alias("g"), "base"), F.expr("queue <=> q AND group = g"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("queue", "group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = own.withColumn("first", F.col("base") + within).groupBy("part").agg(F.collect_list(F.struct("queue", "first")).alias("firsts"))
    placed = tokens.join(first, "part").select("queue", (F.filter("firsts", lambda f: f["queue"].eqNullSafe(F.col("queue")))[0]["first"] + F.col("at")).alias("first"), "doc_id", "doc_tokens", "ids")
    return placed.mapInArrow(functools.partial(cut, schedule=schedule), PIECES_SQL)


def sequences(cuts: DataFrame) -> DataFrame:
    """sequence_id, tokens, ids (little-endian u32) and pieces (doc_id, start, length) of each sequence, in order."""
    ordered = cuts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("p"))
    joined = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    return ordered.select("sequence_id", (F.octet_length(joined) / 4).cast("long").alias("tokens"), joined.alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"], x["start"], x["length"])).alias("pieces"))


def digests(docs: DataFrame, path: str, **options) -> DataFrame:
    """The pieces with a checksum instead of their ids."""
    return pieces(docs, path, **options).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
