"""Semantic search over stored embeddings, and the upkeep of the store."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions import text as T

EMBED_BYTES, EMBED_BATCH, SCOPE = 1800, 16, 12
QUERY_PREFIX, DOCUMENT_PREFIX = "task: search result | query: ", "title: {title} | text: "


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null for unequal lengths, empty vectors and zero norms."""
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(ok, dot(a, b) / (norm(a) * norm(b)))


def l2_normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def top_k(rows: DataFrame, query: list[float], k: int, vector: str = "embedding", tie: str = "_pos", allowed: DataFrame | None = None, key: str = "id", min_k: int = 1) -> DataFrame:
    """The k (at least one) rows nearest to the query; the query's norm is a constant of the plan."""
    length = math.sqrt(sum(x * x for x in query))
    scope = rows if allowed is None else rows.join(allowed.select(key), key, "left_semi")
    if not query or not length:
        return scope.withColumn("score", F.lit(None).cast("double")).limit(0)
    q = F.array(*[F.lit(float(x)) for x in query])
    n = norm(F.col(vector))
    score = F.when((F.size(vector) == len(query)) & (n > 0), dot(F.col(vector), q) / (n * length))
    return scope.withColumn("score", score).filter("score IS NOT NULL").orderBy(F.desc("score"), tie).limit(max(k, min_k))


def attach(found: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions of the found ids; unknown ids go after the limit."""
    return found.join(sessions, found["session_id"] == sessions["id"])


def embedding_input(title: Column, body: Column) -> Column:
    """Labelled metadata and the collapsed summary between its rules, at most 1 800 bytes."""
    summary = F.regexp_extract(body, r"(?s)\n---\n\n(.*?)(?:\n\n---\n|$)", 1)
    full = F.when(summary != "", summary).otherwise(body)
    return T.cap_bytes(F.concat(F.lit("title: "), title, F.lit(" | text: "), T.collapse_spaces(full)), EMBED_BYTES)


def query_input(text: str) -> str:
    """A query as the model gets it: behind its prefix, at most 1 800 bytes, cut between characters."""
    return (QUERY_PREFIX + text.strip()).encode()[:EMBED_BYTES].decode(errors="ignore")


def scope_ids(store: DataFrame, query: str, model: Callable[[list[str]], list[list[float]]], k: int = SCOPE, allowed: DataFrame | None = None) -> list[str]:
    """The ids of the sessions nearest to a query, which a chat is then about; none is an error."""
    rows = store.withColumnRenamed("session_id", "id")
    found = [r["id"] for r in top_k(rows, model([query_input(query)])[0], k, tie="id", allowed=allowed).select("id").collect()]
    if not found:
        raise ValueError("no session is near the query: search the archive, or rebuild the embeddings")
    return found


def stale(inputs: DataFrame, store: DataFrame) -> DataFrame:
    """Inputs (session_id, model_name, summary_hash, ...) that the store does not hold as they are."""
    keys = ["session_id", "model_name", "summary_hash"]
    return inputs.join(store.select(*keys), keys, "left_anti")


def embed(inputs: DataFrame, model: Callable[[list[str]], list[list[float]]], text: str = "text") -> DataFrame:
    """A record for each input, in batches of 16 texts; the model is any function of a list of texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), EMBED_BATCH):
                part = frame.iloc[i : i + EMBED_BATCH]
                yield part[["session_id", "model_name", "summary_hash"]].assign(embedding=model(part[text].tolist()))

    return inputs.mapInPandas(run, "session_id string, model_name string, summary_hash string, embedding array<float>")


def hash_embedder(dimensions: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for a model: signed hashed words."""

    def model(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dimensions
            for w in t.lower().split():
                h = T.fnv1a(w)
                v[h % dimensions] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return model


def refreshed_store(store: DataFrame, new: DataFrame, live: DataFrame) -> DataFrame:
    """New records replace old ones of their session; sessions that are gone go; ordered by id."""
    kept = store.join(new.select("session_id"), "session_id", "left_anti").unionByName(new)
    return kept.join(live.select(F.col("id").alias("session_id")), "session_id", "left_semi").orderBy("session_id")
