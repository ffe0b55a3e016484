"""Threads over node tables and nested content of any depth, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sessionlake.sources import exports, nested


def plain_thread(conv):
    mapping = conv["mapping"]
    at = conv.get("current_node")
    if at not in mapping:
        at = next((k for k in sorted(mapping) if "parent" in mapping[k] and mapping[k]["parent"] is None), next(iter(sorted(mapping)), None))
    out = []
    while at in mapping and at not in out:
        out.append(at)
        at = mapping[at].get("parent")
    return out[::-1]


def test_threads(spark):
    rng = random.Random(5)
    convs = []
    for c in range(40):
        names = [f"n{i:02d}" for i in range(rng.randint(1, 14))]
        rng.shuffle(names)
        mapping = {}
        for n in names:
            node = {"message": {"author": {"role": "user"}, "content": {"content_type": "text", "parts": [n]}}}
            kind = rng.random()
            if kind < 0.75:
                node["parent"] = rng.choice(names)
            elif kind < 0.85:
                node["parent"] = None
            elif kind < 0.9:
                node["parent"] = "gone"
            mapping[n] = node
        convs.append({"id": f"c{c}", "mapping": mapping} | ({"current_node": rng.choice(names)} if c % 3 else {"current_node": "nowhere"} if c % 2 else {}))
    rows = exports.chatgpt(spark.createDataFrame([(json.dumps(convs[:25]),), (json.dumps(convs[25:]),), ("not json",)], "json string")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["turn"]):
        got.setdefault(r["session_id"], []).append(r["text"])
    assert got == {c["id"]: plain_thread(c) for c in convs}


@pytest.mark.parametrize("n", [1, 2, 20_000])
def test_a_long_chain(spark, n):
    """One chain of n nodes: about log2(n) rounds."""
    parents = spark.range(1, n).select(F.lit(0).alias("tree"), F.col("id").alias("node"), (F.col("id") - 1).alias("parent"))
    out = nested.ancestors(spark.createDataFrame([(0, n - 1)], "tree int, node long"), parents)
    assert out.agg(F.count("*"), F.sum("distance"), F.max("distance")).first() == (n, n * (n - 1) // 2, n - 1)


def plain_fragments(v):
    lines = lambda t: "\n".join(x for x in (y.strip() for y in t.replace("\r\n", "\n").split("\n")) if x)
    if isinstance(v, str):
        return [lines(v)] if lines(v) else []
    if isinstance(v, list):
        return [t for x in v for t in plain_fragments(x)]
    if isinstance(v, dict) and v.get("content_type") not in nested.ASSETS:
        own = [t for k in ("text", "result", "body") if isinstance(v.get(k), str) for t in plain_fragments(v[k])]
        return own + [t for k in ("parts", "items") if k in v for t in plain_fragments(v[k])]
    return []


def test_content_of_any_depth(spark):
    rng = random.Random(9)

    def value(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice(["a", " b \n\n c ", "", "{", "[x", 7, None, True, 1.5, "\r\nd"])
        if kind < 0.6:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        keys = ["text", "result", "body", "parts", "items", "other"]
        out = {k: value(depth - 1) for k in rng.sample(keys, rng.randint(0, 5))}
        return out | ({"content_type": rng.choice(["text", nested.ASSETS[0]])} if rng.random() < 0.3 else {})

    values = [value(7) for _ in range(150)]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "k int, j string").select("k", F.parse_json("j").alias("v"))
    got = {r["k"]: r["text"] for r in nested.joined(nested.fragments(rows, ["k"]), ["k"]).collect()}
    want = {i: "\n".join(plain_fragments(v)) for i, v in enumerate(values) if plain_fragments(v)}
    assert got == want and len(want) > 40
