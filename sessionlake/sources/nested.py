"""Trees inside JSON documents as tables: paths to a root by pointer doubling, and nested content of any depth by rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.functions import text as T
from sessionlake.session import ensure_checkpoint_dir, settled

#: Kinds of content that have no text, fields that hold text, and fields that hold further content.
ASSETS = ["image_asset_pointer", "audio_asset_pointer", "video_asset_pointer"]
TEXT_FIELDS, CHILD_FIELDS = ["text", "result", "body"], ["parts", "items"]


def ancestors(starts: DataFrame, parents: DataFrame) -> DataFrame:
    """(tree, node, distance) of every start (tree, node) and all that its parents (tree, node, parent) lead to.

    Pointers double: in round k those at distances below 2**k jump 2**k steps further, so a chain of n nodes takes about
    log2(n) rounds of joins, whoever holds the chain. Trees that have come to their end leave the rounds. In a loop each
    node counts once, by its shortest distance. A node without a parent in the table ends its path.
    """
    ensure_checkpoint_dir(starts.sparkSession)
    reached = settled(starts.select("tree", "node", F.lit(0).cast("long").alias("distance")))
    jump, step = parents.filter("parent IS NOT NULL").select("tree", "node", F.col("parent").alias("to")), 1
    while True:
        further = reached.join(jump, ["tree", "node"]).select("tree", F.col("to").alias("node"), (F.col("distance") + step).alias("distance"))
        new = settled(further.groupBy("tree", "node").agg(F.min("distance").alias("distance")).join(reached, ["tree", "node"], "left_anti"))
        if new.isEmpty():
            return reached
        reached = settled(reached.unionByName(new))
        going = jump.join(new.select("tree").distinct(), "tree", "left_semi")
        again = going.select("tree", F.col("node").alias("to"), F.col("to").alias("further"))
        jump, step = settled(going.join(again, ["tree", "to"]).select("tree", "node", F.col("further").alias("to"))), 2 * step


def fragments(values: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """(keys, path, text) of the texts in a variant column, at any depth; path orders a value's texts.

    Arrays are read in order; of an object its text fields, if they are strings, then its further content; media have no
    text. Each round opens one level of all values at once, until nothing is nested any more. Lines are trimmed, empty
    ones go, and so do empty texts.
    """
    ensure_checkpoint_dir(values.sparkSession)
    front = values.select(*keys, F.array().cast("array<int>").alias("path"), F.col(value).alias("v")).filter("v IS NOT NULL")
    done = None
    while True:
        front = settled(front.withColumn("kind", F.schema_of_variant("v")))
        texts = front.filter("kind = 'STRING'").select(*keys, "path", T.nonblank_lines(F.variant_get("v", "$", "string")).alias("text")).filter("text <> ''")
        done = texts if done is None else done.unionByName(texts)
        nested = front.filter("kind LIKE 'ARRAY%' OR kind LIKE 'OBJECT%'")
        if nested.isEmpty():
            return done
        media = F.coalesce(F.try_variant_get("v", "$.content_type", "string").isin(ASSETS), F.lit(False))
        items = F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda c, i: F.struct(i.alias("i"), F.lit(False).alias("leaf"), c.alias("c")))
        children = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(i < len(TEXT_FIELDS)).alias("leaf"), F.try_variant_get("v", f"$.{f}", "variant").alias("c")) for i, f in enumerate(TEXT_FIELDS + CHILD_FIELDS)])
        opened = nested.select(*keys, "path", F.explode(F.when(F.col("kind").startswith("ARRAY"), items).when(~media, children)).alias("x")).filter("x.c IS NOT NULL")
        opened = opened.filter("NOT x.leaf OR schema_of_variant(x.c) = 'STRING'")
        front = opened.select(*keys, F.concat("path", F.array("x.i")).alias("path"), F.col("x.c").alias("v"))


def joined(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): a value's texts in order, a line each."""
    ordered = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("path", "text"))).alias("t"))
    return ordered.select(*keys, F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))
