"""The corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a driver writes it as Parquet and reads it again as the
next stage's docs. All but the last return the columns of documents; n_chars follows the text.

Defined results, of every stage: an empty table gives an empty table of the same columns; a null text is an empty text; a
null doc_id stays null and comes after all others where ids are compared; nulls in other columns, and columns that
documents don't have, whatever their names, go through unchanged; texts of any length are read whole. What a stage makes
of empty texts, ties and repeated rows is said in its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm import op02_bpe, op07_suffix, op08_decontaminate, op09_rules, op10_jaccard
from sessionlake.llm.queries import vocabulary_path
from sessionlake.session import ensure_checkpoint_dir, table


def measured(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go, and the documents that the rules reject.

    An empty text has too few words and goes; rows are judged one by one, so repeated rows all stay or all go.
    """
    return measured(op09_rules.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id.

    Repeated rows are duplicates: one stays. Of rows with one id in a group the one with the smallest text stays, then that
    with the smallest other columns. Documents without words are duplicates of nothing but rows of the same id.
    """
    return op10_jaccard.representatives(docs)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that came before are cut from the texts.

    Before means in a smaller doc_id, or earlier in the same document; rows with equal ids and texts are one document and
    lose the same bytes, rows with equal ids and other texts count by their place. A text may become empty; no row goes.
    """
    return measured(op07_suffix.dedup(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Empty texts hold none, and empty items are in no text; repeated rows all stay or all go.
    """
    return op08_decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of token ids of each document and digests of them and of the decoded text.

    A row for each row: an empty text has no ids and the digests of the empty string.
    """
    return op02_bpe.encode(docs, vocabulary_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_bytes", repeated_bytes),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]

#: Edit distances and the tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is kept in the checkpoint folder for the next."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
    return STAGES[-1][1](spark, docs, sf_dir)
