"""Rows with an equal id and text lose the same bytes, whichever of them a slice sends."""

import random

import numpy as np
import pyarrow as pa
from test_operators import brute_bytes, sha

from sessionlake.llm import first_seen as fs
from sessionlake.llm import op07_suffix, op10_jaccard


def test_verdicts_of_one_document_are_united():
    packed = lambda at, status: np.array(at, np.uint32).tobytes() + bytes(status)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "no_id": [False, False], "text_hash": [5, 6], "found": [[packed([1, 4], [1, 1]), packed([1, 2, 9], [2, 1, 3])], [packed([7], [2])]]})
    out = next(fs.united(iter([batch]))).to_pylist()
    assert [(np.frombuffer(r["at"], np.uint32).tolist(), list(r["status"])) for r in out] == [([1, 2, 4, 9], [1, 1, 1, 3]), ([7], [2])]


def test_suffix_of_repeated_rows(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("aehinorst") for _ in range(6)) for _ in range(n))
    early, slices = [], []
    for k in range(12):  # a repeat within the text, and one of a smaller document in another slice
        other, own = prose(60), prose(40)
        early.append((k, f"{prose(10)} {other} {prose(10)}"))
        slices += [(100 + k, f"{own} {prose(9)} {other} {prose(9)} {own}")] * 2
    docs = spark.createDataFrame(early, "doc_id long, text string").coalesce(1).union(spark.createDataFrame(slices, "doc_id long, text string").coalesce(1))
    want = brute_bytes({*early, *slices})
    got = op07_suffix.spans(docs).collect()
    assert len(got) == 36 and all(want[i][1] > 500 for i in range(100, 112))
    assert all((r["n_removed"], r["n_spans"], r["kept_sha256"]) == (*want[r["doc_id"]][1:3], sha(want[r["doc_id"]][3])) for r in got)


def test_unrelated_texts_of_one_id_are_kept(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (1, b + " b40"), (3, b)], "doc_id long, text string")
    assert sorted(map(tuple, op10_jaccard.representatives(docs).collect())) == [(1, a), (1, b)]
