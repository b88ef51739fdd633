"""Connected components of an edge list, by repeated contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctuality.llm.texts import shared


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour if that is smaller, follows the hooks
    once more, and contracts the edges. At least half of the nodes that still have a neighbour
    go in each round, so the number of rounds is logarithmic; each round is written to the
    shared folder. Neighbours are reduced to a minimum before the shuffle, so a node with very
    many edges is no hot spot. Loops and repeated edges do no harm; no edges give no rows.
    """
    live = shared(edges.where("a != b").select("a", "b").distinct())
    known = shared(live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("root", F.col("node")))
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        hook = shared(hook.select("node", F.least("node", "least").alias("up")))
        above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hook = shared(hook.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("top")))
        known = shared(
            known.join(hook.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        )
        at_a, at_b = hook.toDF("a", "top_a"), hook.toDF("b", "top_b")
        live = shared(
            live.join(at_a, "a").join(at_b, "b").where("top_a != top_b")
            .select(F.least("top_a", "top_b").alias("a"), F.greatest("top_a", "top_b").alias("b")).distinct()
        )
    return known
