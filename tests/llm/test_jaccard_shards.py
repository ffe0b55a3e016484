"""op10 against brute force where homes are cut into many shards, and its search against plain set overlaps."""

import random

import numpy as np
import pytest
from test_operators import brute_classes

from sessionlake.llm import op10_jaccard as j


def corpus(seed, groups=6, copies=14):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aehinorst") for _ in range(4)) for _ in range(900)]
    hot = [rng.choice(vocab) for _ in range(60)]
    texts = []
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([9, 40, 120]))] + (hot if g % 2 else [])
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    texts += [" ".join(hot + [rng.choice(vocab) for _ in range(k)]) for k in range(1, 40)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("size", [1 << 18, 400, 60])
def test_shards_of_any_size(spark, tmp_path, monkeypatch, size):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    monkeypatch.setattr(j, "SHARD_SHINGLES", size)
    rows = corpus(size)
    want = brute_classes(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert 10 < len({c for _, c in want.values()}) < len(rows) - 20 and got == want


@pytest.mark.parametrize("mu", [0.0, 0.01, 1.0, 100.0])
def test_divide_skip(mu, monkeypatch):
    """However many lists are long, the rows are those with the required overlap."""
    monkeypatch.setattr(j, "MU", mu)
    rng = random.Random(3)
    base = rng.sample(range(10_000), 80)
    sets = [np.array(rng.sample(base, rng.randint(50, 80)) + rng.sample(range(10_000, 20_000), rng.randint(0, 12)), np.int64) for _ in range(120)]
    shard = j.Shard(75)
    shard.add(np.arange(120), np.arange(120), np.array([len(s) for s in sets]), np.concatenate(sets))
    shard.build()
    hits = 0
    for k, s in enumerate(sets):
        others = np.arange(120) != k
        rows = shard.occurring(s, others)
        want = [i for i in range(120) if i != k and 100 * len(set(s) & set(sets[i])) >= 75 * len(set(s) | set(sets[i]))]
        assert rows.tolist() == want
        hits += len(want)
    assert 50 < hits < 120 * 119
