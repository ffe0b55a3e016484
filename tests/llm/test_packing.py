"""op13: every token in one place, windows in their proportions, and the tokens those of the public library."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sessionlake.llm import op13_packing as op
from sessionlake.llm.queries import BYTE_VOCABULARY, vocabulary_path

PATH = vocabulary_path(BYTE_VOCABULARY)
TEXT = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab 's\n\t  12é<|endoftext|>")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_tokens(text):
    assert op.tokenizer_of_tests(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


LIBRARY = Tokenizer.from_file(PATH)
op.tokenizer_of_tests = op.tokenizer(PATH)


def test_other_vocabularies_take_their_own_library():
    path = vocabulary_path()
    assert op.tokenizer(path)("Hello there, wörld").tolist() == Tokenizer.from_file(path).encode("Hello there, wörld", add_special_tokens=False).ids


def check_schedule(supply, targets, size):
    """Each queue's tokens, served in runs of any length, fill sequences without a gap; windows keep to the shares."""
    schedule = op.Schedule(supply, targets, size)
    rng = random.Random(str(supply))
    places, mixes = {}, {}
    for queue, n in supply.items():
        at = 0
        while at < n:
            k = min(n - at, rng.choice([1, 2, 7, 50, 5000]))
            got = list(schedule.serve(queue, at, k))
            assert sum(g[2] for g in got) == k and all(g[2] > 0 for g in got)
            for sequence, offset, length in got:
                places.setdefault(sequence, []).append((offset, length))
                mixes.setdefault(sequence, {}).setdefault(queue, 0)
                mixes[sequence][queue] += length
            at += k
    total = sum(supply.values())
    sizes = {}
    for sequence, runs in places.items():
        end = 0
        for offset, length in sorted(runs):
            assert offset == end
            end += length
        sizes[sequence] = end
    assert sorted(places) == list(range(len(places)))
    short = [n for n in sizes.values() if n != size]
    assert sum(sizes.values()) == total and all(n & (n - 1) == 0 for n in short) and len(short) == bin(total % size).count("1")
    return schedule, mixes


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from(["a", "b", "c", "d", None]), st.integers(0, 3000), min_size=1), st.sampled_from([16, 64]), st.sampled_from([None, {"a": 0.5, "b": 0.5}, {"a": 0.9, "c": 0.05, None: 0.05}, {"z": 1.0}]))
def test_schedule(supply, size, targets):
    schedule, mixes = check_schedule(supply, targets, size)
    for phase in schedule.phases:
        for queue, path in phase.paths.items():
            share = size * phase.weights[queue] / phase.total
            for window in range(phase.windows):
                assert abs(mixes[phase.first + window].get(queue, 0) - share) < 2 * len(path) + 1e-6
            # and the deficits don't grow, however many windows there are
            assert all(abs(phase.served(queue, w, size) - w * share) <= len(path) + 1e-6 for w in range(phase.windows + 1))


def test_tiny_and_huge_queues():
    """A queue with a token in a million windows is found without walking them."""
    schedule = op.Schedule({"a": 10**16, "b": 3}, None, 2048)
    places = [list(schedule.serve("b", k, 1)) for k in range(3)]
    assert [len(p) for p in places] == [1, 1, 1] and places[1][0][0] > 10**12
    assert sum(length for _, _, length in schedule.serve("a", 10**15, 10_000)) == 10_000
    assert list(schedule.serve("b", 0, 3)) == [p[0] for p in places]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, start int").repartition(4)


def test_pieces(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(2)
    words = ["the", "Über", " <|endoftext|> ", "12", "\n", "☃", "lorem"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 30, 300]))), rng.choice(["hot", "hot", "b", "c", None]), 1) for i in range(150)]
    rows += [(150, None, "b", 1), (3, rows[3][1], rows[3][2], 1), (None, "no id", "d", 1), (151, "long " * 30_000, "c", 1)]
    want = {}
    for i, text, _, _ in rows:
        want.setdefault(i, []).append(np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids + [op.END_ID], "<u4"))
    for targets in (None, {"hot": 0.2, "b": 0.8}):
        got = op.pieces(frame(spark, rows), PATH, targets).collect()
        by_id, sequences = {}, {}
        for r in got:
            assert len(r["ids"]) == 4 * r["length"] > 0
            by_id.setdefault(r["doc_id"], []).append(r)
            sequences.setdefault(r["sequence_id"], []).append(r)
        for i, whole in want.items():
            whole_bytes = sorted(b.tobytes() for b in whole)
            parts = sorted(by_id[i], key=lambda r: r["start"])
            assert sum(r["length"] for r in parts) == sum(len(w) for w in whole)
            if len(whole) == 1:
                assert b"".join(bytes(r["ids"]) for r in parts) == whole_bytes[0] and {r["doc_tokens"] for r in parts} == {len(whole[0])}
        total = sum(len(w) for ws in want.values() for w in ws)
        sizes = []
        for rs in sequences.values():
            end = 0
            for r in sorted(rs, key=lambda r: r["offset"]):
                assert r["offset"] == end
                end += r["length"]
            sizes.append(end)
        assert sum(sizes) == total and all(n == op.WINDOW or n & (n - 1) == 0 for n in sizes) and len(sizes) == total // op.WINDOW + bin(total % op.WINDOW).count("1")
    out = op.sequences(op.pieces(frame(spark, rows), PATH)).collect()
    assert sum(r["tokens"] for r in out) == total and all(len(r["ids"]) == 4 * r["tokens"] for r in out)
    digests = op.digests(frame(spark, rows[:40]), PATH).collect()
    whole = {r["doc_id"]: r for r in digests if r["length"] == r["doc_tokens"]}
    assert len(whole) > 5 and all(r["ids_crc32"] == zlib.crc32(want[i][0].tobytes()) for i, r in whole.items() if i != 3)


@pytest.mark.parametrize("rows", [[], [(1, None, None, 1)]])
def test_few_rows(spark, tmp_path, rows):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    got = op.digests(frame(spark, rows), PATH).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1, zlib.crc32(np.array([1], "<u4").tobytes()), 1, 0, 0)][: len(rows)]
