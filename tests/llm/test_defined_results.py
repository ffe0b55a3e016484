"""Null, empty, long and repeated texts, empty tables, and columns whose names clash, for every operator and for the pipeline."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import brute_bytes, brute_classes, sha

import corpus_pipeline
from sessionlake.llm import op02_bpe, op03_toxicity, op04_anchors, op05_quality, op06_language, op07_suffix, op08_decontaminate, op09_rules, op10_jaccard
from sessionlake.llm.queries import RULES_SQL, vocabulary_path

CLASH = "d h f found key no_id doc no_doc _judged _judged_ kept base_failed clean_text n_words _id _no_id _hash phrase_at string_at at status node home class shingle label features score".split()


@pytest.fixture(scope="module", autouse=True)
def shared(spark, tmp_path_factory):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def clashing(frame):
    return frame.withColumns({c: F.lit(f"own {c}") for c in CLASH})


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    text = " ".join(f"wörd{rng.randrange(900)}" for _ in range(120)) + "."
    rows = [(1, text), (1, text), (2, text + " End."), (3, None), (4, ""), (5, " \n "), (6, f"{text}\nAll rights reserved."), (7, " ".join(f"x{k}" for k in range(30_000))), (None, text)]
    return clashing(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")).checkpoint()


def operators(docs):
    bench = docs.sparkSession.createDataFrame([(1, "nothing has this item in it at all"), (2, None), (3, "")], "item_id long, text string")
    labels = docs.sparkSession.createDataFrame([(1, 1), (6, 0)], "doc_id long, toxic int")
    return {
        "op2": lambda d: op02_bpe.encode(d, vocabulary_path()),
        "op3": lambda d: op03_toxicity.score(d, labels),
        "op4": op04_anchors.kept_words,
        "op5": lambda d: op05_quality.resample(d, d.filter("doc_id = 1").select("doc_id")),
        "op6": op06_language.identify,
        "op7": op07_suffix.spans,
        "op9": op09_rules.assess,
        "op10": op10_jaccard.classes,
        "op8": lambda d: op08_decontaminate.decontaminate(d, bench),
    }


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_a_row_for_each_row(docs, name):
    run = operators(docs)[name]
    found = run(docs)
    assert sorted((r["doc_id"] for r in found.select("doc_id").collect()), key=str) == sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=str)
    assert run(docs.limit(0)).count() == 0


@pytest.mark.parametrize("keep", [op09_rules.clean, op07_suffix.dedup, op10_jaccard.representatives])
def test_columns_are_kept(docs, keep):
    out = keep(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = out.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASH)
    assert keep(docs.limit(0)).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    vocab = ["".join(rng.choice("aehinorstü") for _ in range(rng.randint(3, 8))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    shared, item = prose(40), " ".join([w for w in vocab if w.isascii()][:20])
    texts = [None, "", "short text", "spam " * 90]
    for k in range(40):
        t = prose(rng.randint(60, 160))
        texts.append(f"{t}\nhome | about | shop | cart\n{shared}" if k % 3 == 0 else f"{t} {item.upper()} {prose(30)}" if k % 7 == 1 else t)
        if k % 5 == 0:
            texts += [texts[-1], " ".join(w if j else "changed" for j, w in enumerate(texts[-1].split(" ")))]
    rows = [(i * 37 % len(texts), t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT doc_id, text FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({RULES_SQL}) WHERE kept").fetchall()}
    clean = sorted((i, "\n".join(x for x in t.split("\n") if not x.startswith("home |"))) for i, t, *_ in rows if i in kept)
    classes = brute_classes(clean)
    alone = [(i, t) for i, t in clean if classes[i][1] == i]
    cut = {i: w[3].decode(errors="ignore") for i, w in brute_bytes(alone).items()}
    left = {i: t for i, t in cut.items() if item not in t.lower()}
    assert len(rows) > len(clean) > len(alone) > len(left) > 10 and any(cut[i] != t for i, t in alone)
    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.no_truncation()
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in left.items()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: (len(ids), sha(" ".join(map(str, ids)).encode())) for i, ids in want.items()}


def test_pipeline_of_an_empty_table(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
