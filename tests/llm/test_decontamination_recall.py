"""op8 against exhaustive search: edit distances, the tables' recall, and whole documents with edits of every kind."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sessionlake.llm import hashing as hs
from sessionlake.llm import op08_decontaminate as d


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, words, edits, vocab):
    w = list(words)
    for _ in range(edits):
        kind, k = rng.randrange(3), rng.randrange(len(w))
        if kind == 0:
            w[k] = rng.choice(vocab)
        elif kind == 1:
            w.insert(k, rng.choice(vocab))
        elif len(w) > 1:
            del w[k]
    return w


@pytest.mark.parametrize("n", [1, 2, 5, 9, 24])
def test_edit_distances(n):
    rng = random.Random(n)
    a = [[rng.randrange(5) for _ in range(n)] for _ in range(80)]
    b = [(edited(rng, x, rng.randrange(4), range(5)) + x)[:n] for x in a]
    for most in range(n // 2 + 1):
        got = d.edit_distances(np.array(a, np.uint64), np.array(b, np.uint64), most)
        assert got.tolist() == [min(distance(x, y), most + 1) for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("n", [8, 15, 30, 60, 119])
def test_recall_of_the_tables(n):
    """Pairs at the allowed distance meet in a table as often as the target says."""
    rng = random.Random(n)
    vocab = [f"w{k}" for k in range(2000)]
    items = [[rng.choice(vocab) for _ in range(n)] for _ in range(300)]
    most = d.edits_allowed(n, d.EDIT_RATE)
    copies = [(edited(rng, w, most, vocab) + [rng.choice(vocab) for _ in range(n)])[:n] for w in items]
    packed = d.Items(list(range(300)), [" ".join(w) for w in items], d.EDIT_RATE, d.WALKS, d.tables_for(d.RECALL, d.AGREEMENT, d.WALKS, d.BITS), d.BITS)
    rows = packed.by_length[n][0]
    words = np.stack([d.plain_words(*next(hs.text_slices(pa.array([" ".join(w)])))[1:])[0] for w in copies])
    w, i = packed.candidates(words)
    met = set(zip(w.tolist(), rows[i].tolist(), strict=True))
    true = [k for k in range(300) if distance(items[k], copies[k]) <= most]
    assert len(true) > 100
    assert sum((k, k) in met for k in true) >= 0.99 * len(true)
    assert len(met) < 300 * 20  # of 90 000 pairs


def test_whole_documents(spark):
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(1500)]
    items = [(k, [rng.choice(vocab) for _ in range(rng.choice([1, 4, 7, 12, 25, 40]))]) for k in range(40)]
    docs = []
    for k in range(120):
        text = [rng.choice(vocab) for _ in range(150)]
        if k % 4:
            w = items[k % 40][1]
            at = rng.randrange(100)
            text[at : at + len(w)] = edited(rng, w, rng.randrange(d.edits_allowed(len(w), d.EDIT_RATE) + 2), vocab)
        docs.append((k, text))
    want = {}
    for k, text in docs:
        for i, w in items:
            n = len(w)
            best = min((distance(text[s : s + n], w) for s in range(len(text) - n + 1)), default=99)
            if best <= d.edits_allowed(n, d.EDIT_RATE):
                want[k, i] = best
    frame = spark.createDataFrame([(k, " ".join(t), "x", 1) for k, t in docs], "doc_id long, text string, key string, no_id int").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in d.find(frame, bench).collect()}
    assert len(want) > 80 and set(got) <= set(want)
    assert len(got) >= 0.99 * len(want) and all(got[p] == want[p] for p in got)
    left = d.decontaminate(frame, bench)
    assert left.columns == frame.columns and {r["doc_id"] for r in left.collect()} == {k for k, _ in docs} - {k for k, _ in got}
