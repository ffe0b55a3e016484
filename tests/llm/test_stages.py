"""Each stage of the pipeline by itself: empty tables, repeated rows, nulls and columns of any name; very long messages and items."""

import pytest

import corpus_pipeline
from sessionlake.llm import op01_quotes, op08_decontaminate

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, shingles string, component string, row int"
GOOD = "\n".join(f"This is line number {k} of a text that says something new about topic {k * 7} and its {k * 13} parts." for k in range(12))
OTHER = "\n".join(f"Quite another report number {k} tells of {k * 11} rivers, {k * 17} hills and the towns between them." for k in range(12))
ITEM = " ".join(f"question{k} answer{k * 3}" for k in range(30))


@pytest.fixture
def sf_dir(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "c"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def row(i, text, more=1):
    return (i, text, "en", "s", len(text or ""), more, "x", None, more)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_empty_table(spark, sf_dir, name, stage):
    out = stage(spark, spark.createDataFrame([], SCHEMA), sf_dir)
    assert out.collect() == []
    if name != "token_ids":
        assert out.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_repeated_rows_and_nulls(spark, sf_dir, name, stage):
    rows = [row(1, GOOD), row(1, GOOD), row(2, OTHER), row(2, OTHER), row(3, GOOD), row(None, OTHER), row(4, None), row(5, ""), row(6, f"{OTHER}\n{ITEM}"), row(6, f"{OTHER}\n{ITEM}")]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), sf_dir).collect())
    ids = [None if null else i for null, i in got]
    assert ids == {
        "quality_rules": [6, 6],  # the others repeat themselves too much, or are too short
        "near_duplicates": [1, 2, 4, 5, 6],
        "repeated_bytes": [1, 1, 2, 2, 3, 4, 5, 6, 6, None],
        "decontamination": [1, 1, 2, 2, 3, 4, 5, None],
        "token_ids": [1, 1, 2, 2, 3, 4, 5, 6, 6, None],
    }[name]


def test_very_long_messages(spark, sf_dir):
    """A message of many thousand lines, and one that quotes all of them at once."""
    text = "\n\n".join(f"paragraph number {k} is long enough to be linked to" for k in range(8000))
    quote = "\n".join("> " + line if line else ">" for line in text.split("\n"))
    docs = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", f"{quote}\n\nmy answer")], "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r for r in op01_quotes.conversations(docs).collect()}
    assert got[1]["text"] == "my answer" and got[1]["parent_turn"] == 0 and len(got[1]["links"]) >= 1
    assert {(x["to_conv"], x["to_turn"]) for x in got[1]["links"]} == {(1, 0)} and len(got[0]["text"]) == len(text)


def test_an_item_of_thousands_of_words(spark, sf_dir):
    words = [f"w{k}x{k % 7}" for k in range(3000)]
    changed = [w if k % 300 else "other" for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, "a b c " + " ".join(changed) + " d"), (2, " ".join(words[:1400])), (3, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    assert {r["doc_id"] for r in op08_decontaminate.find(docs, items).collect()} == {1}
