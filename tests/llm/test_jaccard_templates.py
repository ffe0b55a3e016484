"""op10 on texts made of shared paragraphs: few searches beside the shards' own, and no link lost."""

import random

import pytest
from test_operators import brute_classes

from sessionlake.llm import op10_jaccard as j


def templates(n, paragraphs=200, each=6, words=55, seed=1, edited=0):
    """Texts of `each` of some paragraphs; the last `edited` are earlier ones with a few other words."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aehinorstdlu") for _ in range(5)) for _ in range(3000)]
    pool = [[rng.choice(vocab) for _ in range(words)] for _ in range(paragraphs)]
    texts = [sum(rng.sample(pool, each), []) for _ in range(n - edited)]
    for k in range(edited):
        w = list(texts[k * 3 % len(texts)])
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


def prepared(spark, tmp_path, rows):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("size,keys", [(1 << 18, 40), (3000, 40), (3000, 1), (700, 10)])
def test_links_among_templates(spark, tmp_path, monkeypatch, size, keys):
    """Whatever the size of shards and the number of tokens in a key."""
    monkeypatch.setattr(j, "SHARD_SHINGLES", size)
    monkeypatch.setattr(j, "MAX_KEYS", keys)
    rows = templates(240, paragraphs=24, edited=60, words=20, seed=size + keys)
    want = brute_classes(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.classes(prepared(spark, tmp_path, rows)).collect()}
    assert len(rows) - 90 < len({c for _, c in want.values()}) < len(rows) - 10 and got == want


@pytest.mark.parametrize("size", [1 << 18, 1 << 13])
def test_searches_grow_with_the_texts(spark, tmp_path, monkeypatch, size):
    """Sets that are sent to other shards: at most four for each document, in proportion to the documents."""
    monkeypatch.setattr(j, "SHARD_SHINGLES", size)
    sent = {}
    whole = j.distant

    def counted(*args):
        out = whole(*args)
        sent[n] = out.filter("query").count()
        return out

    monkeypatch.setattr(j, "distant", counted)
    for n in (1000, 2000):
        assert j.classes(prepared(spark, tmp_path, templates(n))).count() == n
    assert all(sent[n] <= 4 * n for n in sent) and sent[2000] <= max(2000, 2.2 * sent[1000]), sent
