"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.staging import drop_staged, staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is hung on the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below are hung on the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    below = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v: whole numbers) that isn't itself the least of its component.

    Each round is staged; it ends when every node hangs on one node that hangs on nothing, which takes about the
    logarithm of the longest path. Links stay distributed all the way.
    """
    pairs = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = staged(pairs, "links")
    while True:
        after = staged(_small_star(_large_star(now)), "links")
        drop_staged(now)
        now = after
        chained = now.join(now.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        forked = now.groupBy("u").count().filter("count > 1")
        if chained.isEmpty() and forked.isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
