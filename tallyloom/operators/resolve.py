"""Entity resolution: keys, groups, clusters and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators.catalog import best_per
from tallyloom.operators.lineage import checkpointed


def absorb(rows: DataFrame, base: str, work: str) -> DataFrame:
    """rows with ``bundle``: base and work; rows without a work join the only work of their base, if it is the only one."""
    works = rows.filter(F.col(work).isNotNull()).groupBy(base).agg(F.countDistinct(work).alias("works_"), F.min(work).alias("only_"))
    out = rows.join(works, base, "left")
    chosen = F.coalesce(F.col(work), F.when(F.col("works_") == 1, F.col("only_")))
    return out.withColumn("bundle", F.concat_ws("#", base, F.coalesce(chosen.cast("string"), F.lit("-")))).drop("works_", "only_")


def conflicts(a: Column, b: Column) -> Column:
    """Both known and different."""
    return F.coalesce(a != b, F.lit(False))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is hung on the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below are hung on the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    below = edges.join(least.hint("merge"), "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.union(least.select("u", F.col("m").alias("v"))).distinct()


def clusters(edges: DataFrame) -> DataFrame:
    """(node, cluster): connected components of edges (a, b) by alternating large and small stars; a cluster is its least node.

    Every round is checkpointed. The loop ends only when every node hangs on one node that hangs on nothing, which takes
    about the logarithm of the longest path, whatever the order of the ids along it.
    """
    edges = checkpointed(edges.select("a", "b"))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    now = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        now = checkpointed(_small_star(_large_star(now)))
        chained = now.join(now.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        forked = now.groupBy("u").count().filter("count > 1")
        if chained.isEmpty() and forked.isEmpty():
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("cluster"))


def canonical(products: DataFrame, groups: str, key: str, weight: str) -> DataFrame:
    """products with ``canonical``: the one of its group with most weight, then the lowest key."""
    best = best_per(products, [groups], [F.desc(weight), F.asc(key)]).select(groups, F.col(key).alias("canonical"))
    return products.join(best, groups)


def block_pairs(rows: DataFrame, block: str, key: str, fine: Column, parts: int = 8) -> DataFrame:
    """Pairs (l, r: two structs of rows, l's key the lesser) of a block that pass a test over l and r.

    A block is dealt into parts by its keys' hashes, and each pair of parts is a join key of its own, so that a block that
    holds most rows is no single task's work. For tests that no cheaper key can narrow.
    """
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    dealt = rows.withColumn("part_", part).withColumn("other_", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = dealt.withColumn("i_", F.least("part_", "other_")).withColumn("j_", F.greatest("part_", "other_")).drop("other_").distinct()
    same = (F.col(f"l.{block}") == F.col(f"r.{block}")) & (F.col("l.i_") == F.col("r.i_")) & (F.col("l.j_") == F.col("r.j_"))
    once = (F.col("l.part_") != F.col("r.part_")) | (F.col("l.i_") == F.col("l.j_"))
    return dealt.alias("l").join(dealt.alias("r"), same & once & (F.col(f"l.{key}") < F.col(f"r.{key}")) & fine)


def word_pairs(left: DataFrame, right: DataFrame, block: list[str], left_key: str, right_key: str, tokens: str, least: int) -> DataFrame:
    """Distinct pairs of keys of a block that may share ``least`` words; a word that two of the other side make up counts.

    If two rows share so many words, they share one of the rarest size - least + 1 of either (words ordered by how many rows
    have them, the same for all), so a word that most rows have is no join key unless rows have little else. Words made up
    of two meet by the glued pairs, which are keys against the plain words of the other side.
    """
    words = lambda rows, key: rows.select(*block, F.col(key).alias("k_"), F.size(F.array_distinct(tokens)).alias("n_"), F.explode(F.array_distinct(tokens)).alias("w_"))
    a, b = words(left, left_key), words(right, right_key)
    often = a.union(b).groupBy(*block, "w_").agg(F.count("*").alias("often_"))
    rarest = F.row_number().over(W.partitionBy("k_").orderBy("often_", "w_"))
    rare = lambda side: side.join(often, [*block, "w_"]).withColumn("nth_", rarest).filter(F.col("nth_") <= F.col("n_") - least + 1)
    glue = F.flatten(F.transform(tokens, lambda x: F.transform(tokens, lambda y: F.concat(x, y))))
    glued = lambda rows, key: rows.select(*block, F.col(key).alias("k_"), F.explode(F.array_distinct(glue)).alias("w_"))
    side = lambda rows, name: rows.select(*block, "w_", F.col("k_").alias(name))
    meet = lambda x, y: side(x, "l_").join(side(y, "r_"), [*block, "w_"]).select("l_", "r_")
    pairs = meet(rare(a), rare(b)).union(meet(glued(left, left_key), b)).union(meet(a, glued(right, right_key)))
    return pairs.distinct().select(F.col("l_").alias(left_key), F.col("r_").alias(right_key))


def similar_pairs(rows: DataFrame, block: list[str], key: str, tokens: str, similar, least: int = 1) -> DataFrame:
    """Pairs (a, b) within a block that pass a pandas UDF over both token arrays, which asks for ``least`` shared words."""
    one, other = rows.withColumnRenamed(key, "one_"), rows.withColumnRenamed(key, "other_")
    pairs = word_pairs(one, other, block, "one_", "other_", tokens, least).filter("one_ < other_")
    sides = pairs.join(one.select("one_", F.col(tokens).alias("x_")), "one_").join(other.select("other_", F.col(tokens).alias("y_")), "other_")
    return sides.filter(similar("x_", "y_")).select(F.col("one_").alias("a"), F.col("other_").alias("b"))


def open_work(rows: DataFrame, block: str, key: str, done: str, budget: int) -> DataFrame:
    """The rows to do next under a budget: open ones of blocks of two or more, of blocks with most done first, then by key.

    What a run does counts as done in the next one, so runs go on where the budget ended.
    """
    sizes = rows.groupBy(block).agg(F.count("*").alias("size_"), F.count_if(done).alias("done_")).filter("size_ > 1")
    return rows.filter(~F.col(done)).join(sizes, block).orderBy(F.desc("done_"), key).limit(budget).drop("size_", "done_")
