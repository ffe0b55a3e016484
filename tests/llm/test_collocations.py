"""op11 against brute force, with shards and ranges of any size."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionlake.llm import op11_collocations as op

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, min_count=30, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        best = {}
        for p, a in candidates.items():
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            best[p] = (score, a, counts[p[:k]], counts[p[k:]])
        inside = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        kept = [(s, a, " ".join(p), left, right) for p, (s, a, left, right) in best.items() if 100 * inside[p] < 80 * a or not inside[p]]
        kept.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, k + 1, p, a, left, right, n[lang], s) for k, (s, a, p, left, right) in enumerate(kept[:top])]
    return sorted(out)


def corpus(seed, docs=150, vocab=14):
    rng = random.Random(seed)
    words = ["the", "THE", "of", "Über", "é☃", "a.b"] + [f"w{i}" for i in range(vocab)]
    hot = "of the w1 w2 w3 of the w1"
    rows = [(None, "the of the of"), ("en", None), ("en", ""), ("x\ty", "p q " * 40), ("x", "p q\tr " * 40), ("en", " .,\n\x0b;"), ("en\n", "a b c d e " * 35)]
    for _ in range(docs):
        text = []
        for _ in range(rng.randint(0, 40)):
            text.append(hot if rng.random() < 0.1 else rng.choice(words))
            text.append(rng.choice([" ", " ", " ", "\t", ", ", ".\n", "  "]))
        rows.append((rng.choice(["en", "en", "de", None]), "".join(text)))
    return rows


def run(spark, tmp_path, rows, **options):
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    frame = spark.createDataFrame([(lang, text, 1) for lang, text in rows], "lang string, text string, phrase int").repartition(3)
    return sorted(tuple(r[c] for c in COLUMNS) for r in op.collocations(frame, **options).collect())


@pytest.mark.parametrize("shard,ranges,every", [(8_000_000, 8_000_000, 40), (300, 200, 3), (2000, 60, 1), (1, 30, 1)])
def test_against_brute_force(spark, tmp_path, monkeypatch, shard, ranges, every):
    monkeypatch.setattr(op, "SHARD_BYTES", shard)
    monkeypatch.setattr(op, "RANGE_BYTES", ranges)
    monkeypatch.setattr(op, "EVERY", every)
    rows = corpus(shard)
    for least in (30, 4):
        want = brute(rows, least)
        assert run(spark, tmp_path, rows, min_count=least) == want and len(want) > 20


def test_the_top_and_ties(spark, tmp_path):
    rows = [("en", f"b{i} c{i}, " * 30) for i in range(9)] + [("en", "same words here today. " * 31), ("de", "ein wort. " * 29)]
    want = brute(rows, top=4)
    assert run(spark, tmp_path, rows, top=4) == want and [w[2] for w in want] == ["same words here today", "b0 c0", "b1 c1", "b2 c2"]


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []) == [] and run(spark, tmp_path, [("en", None), (None, " ")]) == []


def test_products_beyond_64_bits(spark):
    """A phrase's count times two million may pass 64 bits."""
    nodes = spark.createDataFrame([("en", 2, "a b", 9 * 10**15, [10**16]), ("en", 1, "b", 10**16 - 1, []), ("en", 1, "a", 10**16, []), ("en", 0, None, 10**17, None)], "lang string, depth int, phrase string, a long, lefts array<long>")
    cand = op.with_rights(nodes)
    assert [tuple(r) for r in cand.select("a", "lefts", "rights").collect()] == [(9 * 10**15, [10**16], [10**16 - 1])]
    whole = op.frequent_phrases
    try:
        op.frequent_phrases = lambda *a: nodes
        row = op.collocations(None).first()
    finally:
        op.frequent_phrases = whole
    assert row["score"] == 2_000_000 * 9 * 10**15 // (2 * 10**16 - 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "."]), max_size=12), min_size=1, max_size=8), st.integers(0, 10**6))
def test_ranges_are_the_whole(docs, seed):
    """Nodes of all ranges, whatever their limits, are those of one range; limits may be words that nobody uses."""
    rng = random.Random(seed)
    shards = []
    for text in docs:
        data = np.frombuffer(" ".join(text).encode(), np.uint8)
        shards.append(op.Shard([op.Occurrences(data, np.array([0, len(data)]), ["x"])]))
    keys = ["x\ta", "x\tb", "x\tc", "x\tbb", "w\tz"]
    limits = set()
    for _ in range(rng.randint(0, 5)):
        n = rng.randint(1, 4)
        limits.add(tuple(rng.choice(keys) for _ in range(n)) + ("",) * (4 - n))
    limits = sorted(limits)

    def nodes(limits):
        ranges = {}
        for s in shards:
            for index, *rest in s.serialised(limits):
                ranges.setdefault(index, op.Range(index, limits)).add(*rest)
        return [n for r in ranges.values() for n in r.nodes(2)]

    whole, parts = nodes([]), nodes(limits)
    of = lambda rows: sorted((*r[:4], tuple(r[4])) for r in rows if r[1])
    assert of(parts) == of(whole)
    assert sum(r[3] for r in parts if not r[1]) == sum(r[3] for r in whole if not r[1]) == sum(w != "." for d in docs for w in d)
