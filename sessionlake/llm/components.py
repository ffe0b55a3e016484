"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al. 2014).

Every step is a grouped minimum and a join; nothing is gathered on the driver but the count that tells when labels
have settled. A star's centre, however large, is one row of the grouped minimum, so a hot component is not one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.session import ensure_checkpoint_dir


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of edges (src, dst: long); component is the smallest node that links reach.

    Self-links, repeated links and either direction are allowed. An empty table gives an empty result.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    pairs = edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct().checkpoint()
    before = None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b >= a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.filter("a > b").distinct()
        centre = small.groupBy("a").agg(F.min("b").alias("m"))
        moved = small.join(centre, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        keep = pairs.filter("a = b")
        pairs = moved.union(centre.select("a", F.col("m").alias("b"))).union(keep).distinct().checkpoint()
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).groupBy("node").agg(F.min("component").alias("component"))
