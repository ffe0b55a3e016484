"""Operators and stages on a batch in which one document, or two, have no id."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import brute_bytes, brute_classes, sha

import corpus_pipeline
from sessionlake.llm import op04_anchors, op07_suffix, op08_decontaminate, op10_jaccard

LAST = 1 << 40  # stands for null in the brute force: after all others


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(11)
    vocab = ["".join(rng.choice("aehinorst") for _ in range(rng.randint(3, 9))) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    hot, base = prose(90), prose(200)
    out = [(i, f"{prose(40)} {hot} {prose(40)}.") for i in range(8)] + [(i, f"{base} {prose(5)}.") for i in range(8, 14)]
    return [*out[:3], (None, f"{prose(30)} {hot} {prose(20)}."), *out[3:], (0, out[0][1])]


@pytest.fixture(scope="module")
def docs(spark, pairs, tmp_path_factory):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return spark.createDataFrame(pairs, "doc_id long, text string").coalesce(1).checkpoint()


def given(pairs):
    return {LAST if i is None else i: t for i, t in pairs}


def by_id(rows):
    return {LAST if r["doc_id"] is None else r["doc_id"]: r for r in rows}


def test_anchors_without_an_id(docs, pairs):
    words = {i: t.encode().split() for i, t in given(pairs).items()}
    first, want = {}, {}
    for i in sorted(words):
        gone = set()
        for k in range(len(words[i]) - 49):
            if first.setdefault(tuple(words[i][k : k + 50]), i) < i:
                gone.update(range(k, k + 50))
        want[i] = (len(gone), sha(b" ".join(w for k, w in enumerate(words[i]) if k not in gone)))
    got = op04_anchors.kept_words(docs).collect()
    assert len(got) == len(pairs) and want[LAST][0] >= 90
    assert {i: (r["n_removed"], r["kept_sha256"]) for i, r in by_id(got).items()} == want


def test_suffix_without_an_id(docs, pairs):
    want = brute_bytes(given(pairs).items())
    got = op07_suffix.spans(docs).collect()
    assert len(got) == len(pairs) and want[LAST][1] > 300
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in by_id(got).items()} == {i: (*w[:3], sha(w[3])) for i, w in want.items()}
    assert {i: r["text"].encode() for i, r in by_id(op07_suffix.dedup(docs).collect()).items()} == {i: w[3] for i, w in want.items()}


def test_jaccard_without_an_id(spark, docs, pairs):
    text = dict(pairs)[8]
    alone = "nobody else has " + " ".join(f"w{k}" for k in range(40))
    more = [(None, text + " end"), (None, alone), (None, alone + " w40"), (None, ""), (None, None), (3, "")]
    frame = spark.createDataFrame([*pairs, *more], "doc_id long, text string").coalesce(1)
    want = brute_classes([*((LAST if i is None else i, t) for i, t in pairs), (LAST + 1, text + " end"), (LAST + 2, alone), (LAST + 3, alone + " w40"), (LAST + 4, "")])
    kept = lambda c: None if c >= LAST else c
    got = sorted(((r["n_shingles"], r["component_id"]) for r in op10_jaccard.classes(frame).collect()), key=str)
    copies = [(*want[0][:1], 0), (0, None), (0, 3)]
    assert got == sorted([*((n, kept(c)) for n, c in want.values()), *copies], key=str)
    left = [(r["doc_id"], r["text"]) for r in op10_jaccard.representatives(frame).collect()]
    assert sorted(left, key=str) == sorted([*pairs[:9], next(p for p in pairs if p[0] == 8), (None, alone), (None, ""), (None, None), (3, "")], key=str)


def test_decontamination_without_an_id(spark, pairs):
    rng = random.Random(4)
    item = " ".join(f"item{rng.randrange(10**6)}" for _ in range(20))
    rows = [(0, dict(pairs)[1]), (1, f"{dict(pairs)[2]} {item} end"), (None, f"lead {item} end"), (None, dict(pairs)[3]), (2, f"{item} {item}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(7, item), (9, None)], "item_id long, text string")
    assert sorted(((r["doc_id"], r["item_id"], r["distance"], r["first_word"]) for r in op08_decontaminate.find(docs, items).collect()), key=str) == sorted(
        [(1, 7, 0, len(dict(pairs)[2].split())), (None, 7, 0, 1), (2, 7, 0, 0)], key=str
    )
    assert sorted(((r["doc_id"], r["text"]) for r in op08_decontaminate.decontaminate(docs, items).collect()), key=str) == sorted([rows[0], rows[3]], key=str)


def test_stages_without_an_id(spark, pairs, tmp_path):
    item = "benchmark item " + " ".join(f"part{k}" for k in range(20))
    marked = [(i, f"{t[:-1]} {item}." if i == 5 else t) for i, t in pairs]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in marked], "doc_id long, text string, n_chars long").coalesce(1)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = sorted(((LAST if i is None else i, t) for i, t in set(marked) if i is None or i < 9))
    cut = {i: w[3].decode() for i, w in brute_bytes(near).items()}
    want = {"quality_rules": marked, "near_duplicates": near, "repeated_bytes": cut.items(), "decontamination": [(i, t) for i, t in cut.items() if i != 5]}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name in want:
            plain = [(LAST if r["doc_id"] is None else r["doc_id"], r["text"]) for r in docs.collect()]
            assert sorted(plain) == sorted((LAST if i is None else i, t) for i, t in want[name]), name
            assert docs.filter(F.col("n_chars") != F.char_length("text")).isEmpty()
    assert sorted(by_id(docs.collect())) == sorted(set(cut) - {5})
