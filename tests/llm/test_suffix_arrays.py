"""The suffix arrays of op7 against brute force: contexts of a mark, hot marks, odd columns, and corpora with and without repeats."""

import random

import numpy as np
import pytest
from test_operators import brute_bytes, sha

from sessionlake.llm import op04_anchors, op07_suffix
from sessionlake.llm import hashing as hs

SCHEMA = "doc_id long, text string, _id long, _no_id string, _hash int, phrase_at int, phrase_status int, string_at int, at int, status int"


def test_suffix_order():
    rng = random.Random(1)
    rows = np.array([[rng.choice(b"ab\0") for _ in range(11)] for _ in range(300)], np.uint8)
    group = np.array([rng.randrange(3) for _ in range(300)], np.uint64)
    order, shared = op07_suffix.suffix_order(group, rows)
    keys = [(int(group[k]), bytes(rows[k])) for k in order]
    assert keys == sorted(keys)
    for (g, a), (h, b), n in zip(keys, keys[1:], shared[1:], strict=False):
        assert n == (0 if g != h else next((k for k in range(11) if a[k] != b[k]), 11))


def test_met_before_matches_brute_force():
    rng = random.Random(2)
    length, reach = op07_suffix.LENGTH, op07_suffix.LENGTH - op07_suffix.TRIGGER
    base = bytes(rng.choice(b"abc") for _ in range(400))
    marks, ranks, before, least, texts = [], [], [], [], []
    for k in range(60):  # few distinct bytes, so contexts share much
        b, e = rng.randrange(reach + 1), rng.randrange(4)
        text = bytearray(base[200 - b : 200 + length])
        if rng.random() < 0.8:
            text[rng.randrange(len(text))] = rng.choice(b"abc")
        least.append(min(e, b))
        marks.append(k % 2)
        ranks.append(k * 7 % 60)
        before.append(b)
        texts.append(bytes(text[: b + length - least[-1]]))
    phrase, d = op07_suffix.met_before(np.array(marks), np.array(ranks), np.array(before), np.array(least), texts, length)
    seen = {}
    for k in sorted(range(60), key=lambda k: ranks[k]):
        for x in range(least[k], before[k] + 1):
            seen.setdefault((marks[k], x, texts[k][before[k] - x : before[k] - x + length]), k)
    want = {(k, x) for k in range(60) for x in range(least[k], before[k] + 1) if seen[marks[k], x, texts[k][before[k] - x : before[k] - x + length]] != k}
    assert len(want) > 100 and set(zip(phrase.tolist(), d.tolist(), strict=True)) == want


def corpus(n):
    """A passage in many contexts, cut anywhere, with copies inside documents."""
    rng = random.Random(4)
    prose = lambda k: "".join(rng.choice("aehinorst é") for _ in range(k))
    hot, rows = prose(260), []
    for i in range(n):
        a, b = sorted(rng.sample(range(261), 2))
        rows.append((i * 7 % n, f"{prose(rng.randint(0, 200))}{hot[a:] if i % 2 else hot[:b]}{prose(rng.randint(0, 90))}{hot[a:b]}"))
    return rows


@pytest.mark.parametrize("many", [1, 3, 4096])
def test_hot_marks(spark, tmp_path, many):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = corpus(60)
    want = brute_bytes(rows)
    docs = spark.createDataFrame([(i, t, *[0] * 2, *[1] * 6) for i, t in rows], SCHEMA.replace("_no_id string", "_no_id int")).repartition(7)
    got = op07_suffix.spans(docs, many=many).collect()
    assert sum(w[1] for w in want.values()) > 3000
    assert all((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (*want[r["doc_id"]][:3], sha(want[r["doc_id"]][3])) for r in got)
    if many == 1:
        cut = op07_suffix.dedup(docs)
        assert cut.columns == docs.columns
        assert {r["doc_id"]: r["text"] for r in cut.collect()} == {i: w[3].decode(errors="ignore") for i, w in want.items()}
        assert {tuple(r)[2:] for r in cut.collect()} == {(0, 0, 1, 1, 1, 1, 1, 1)}


@pytest.mark.parametrize("n", [1, 20])
def test_without_repeats(spark, tmp_path, n):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(5)
    rows = [(i, " ".join(f"{rng.random():.9f}" for _ in range(90))) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["n_removed"] for r in op07_suffix.spans(docs).collect()] == [0] * n
    assert [(r["n_words"], r["n_removed"]) for r in op04_anchors.kept_words(docs).collect()] == [(90, 0)] * n
    assert sorted(map(tuple, op07_suffix.dedup(docs).collect())) == rows


def test_powers_are_inverse():
    up, down = hs.powers(100)
    assert ((up * down) == 1).all()
