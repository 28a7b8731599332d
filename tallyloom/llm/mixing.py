"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: its weight's share of the mix, held at ``max_copies`` times the source's own
words, what is over being shared again by weight. A source of rate r = target / words takes floor(r) whole copies of
each of its documents for certain. The remaining words come from a Pareto order sample: document i gets a uniform
number u from its key and an inclusion probability p, and the sample is the head of the order of

    q = (u / (1 - u)) / (p / (1 - p))

p is proportional to size / (size + mean size), so longer documents come a little sooner, by a factor for each source
that makes the expected words equal to those that remain; where that would pass 1 a document is certain and the others
share the rest. The factor is exact: it is found by a running sum over the source's distinct sizes. The head ends where
the words run out; then the one document left whose size comes nearest to the words still missing closes the sample, if
that brings the sum nearer. All is a function of the row and of one small row per source, so no text is shuffled.

Defined cases: a null or blank text has size 0 and gets the certain copies only; a null source is a source of its own,
last in order; a null doc_id is replaced in the random key by the text's digest; equal rows are one unit that is taken
or left together; an empty table gives an empty result; other columns pass through (the operator's own four columns
carry the prefix ``mix_`` and replace input columns of the same name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.joins import bounded_join
from tallyloom.llm.staging import staged
from tallyloom.llm.textcols import boxed, unboxed, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
SEED = "mix-1"
#: Buckets of the order for each source: running sums are taken over buckets, and over rows in one bucket only.
BUCKETS = 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """A row for each source with its target. sizes: mix_source, words, docs. Sources are a small dimension table.

    A source is capped exactly while cap / weight is under the level that the rest would get; over sources in the
    order of cap / weight that level first rises and then falls, so its maximum is the level of the uncapped.
    """
    order = W.orderBy(F.col("mix_source").isNull(), "mix_source")
    ranked = sizes.withColumn("position", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("words") * F.lit(float(max_copies)))
    before = W.orderBy(F.col("cap") / F.col("weight"), "position").rowsBetween(W.unboundedPreceding, -1)
    everywhere = W.partitionBy()
    level = (F.sum("words").over(everywhere) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everywhere))
    target = F.least(F.col("cap"), F.col("weight") * F.col("level"))
    rate = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0)
    return (
        levelled.withColumn("target", target)
        .withColumn("certain", F.floor(rate).cast("int"))
        .withColumn("rest_words", F.col("target") - F.col("certain") * F.col("words"))
        .withColumn("mean_size", F.when(F.col("docs") > 0, F.col("words") / F.col("docs")).otherwise(0.0))
        .select("mix_source", "words", "target", "certain", "rest_words", "mean_size")
    )


def _uniform(doc_id: Column, text: Column, seed: str) -> Column:
    key = F.concat(F.lit(seed), F.lit("|"), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def _weight() -> Column:
    size = F.col("mix_size").cast("double")
    return size / (size + F.col("mean_size"))


def inclusion_factors(units: DataFrame, targets: DataFrame) -> DataFrame:
    """of_source and factor: min(1, factor * weight) are inclusion probabilities whose expected words are the source's rest.

    units: mix_source, mix_size, n. If all sizes above one are certain, the rest fixes the factor of the others; the largest
    size that then isn't certain itself gives the one that holds.
    """
    words = units.filter("mix_size > 0").groupBy("mix_source", "mix_size").agg(F.sum(F.col("mix_size") * F.col("n")).cast("double").alias("at_size"))
    sources = targets.select(F.col("mix_source").alias("of_source"), "rest_words", "mean_size")
    rows = bounded_join(words, sources, F.col("mix_source").eqNullSafe(F.col("of_source")), "inner").withColumn("weight", _weight())
    source = W.partitionBy("of_source")
    above = source.orderBy(F.desc("mix_size")).rowsBetween(W.unboundedPreceding, -1)
    odds = F.sum(F.col("weight") * F.col("at_size"))
    rest = F.col("rest_words") - F.coalesce(F.sum("at_size").over(above), F.lit(0.0))
    rows = rows.withColumn("factor", rest / (odds.over(source) - F.coalesce(odds.over(above), F.lit(0.0))))
    return rows.filter("factor * weight <= 1").groupBy("of_source").agg(F.max_by("factor", "mix_size").alias("factor"))


def inclusion() -> Column:
    """Inclusion probability of a row that has mix_size, mean_size and factor."""
    return F.least(F.lit(1.0), F.coalesce("factor", F.lit(0.0)) * _weight())


def _order_key() -> Column:
    """q of a row that has mix_u, mix_size, mean_size and factor; 0 if it is certain."""
    p = F.greatest(F.lit(1e-9), inclusion())
    return F.when(p >= 1, 0.0).otherwise((F.col("mix_u") / (1.0 - F.col("mix_u"))) / (p / (1.0 - p)))


def _ranked(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    sources = per_source.withColumnRenamed("mix_source", "of_source")
    joined = bounded_join(rows, sources, F.col("mix_source").eqNullSafe(F.col("of_source")), "inner")
    q = _order_key()
    return joined.drop("of_source").withColumn("mix_q", q).withColumn("mix_bucket", F.floor(q / (1.0 + q) * BUCKETS).cast("int"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies (0 to max_copies): what the mix takes of each row."""
    keyed = docs.select(
        boxed(docs),
        word_count(F.col("text")).alias("mix_size"),
        _uniform(F.col("doc_id"), F.col("text"), seed).alias("mix_u"),
        F.col("source").alias("mix_source"),
        F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("mix_id"),
    )
    units = staged(keyed.groupBy("mix_source", "mix_id", "mix_u", "mix_size").agg(F.count("*").alias("n")), "mix-units")
    sizes = units.groupBy("mix_source").agg(F.sum(F.col("mix_size") * F.col("n")).alias("words"), F.sum(F.when(F.col("mix_size") > 0, F.col("n")).otherwise(0)).alias("docs"))
    targets = staged(source_targets(sizes, weights, share, max_copies), "mix-targets")
    factors = inclusion_factors(units, targets)
    targets = staged(targets.join(factors, F.col("mix_source").eqNullSafe(F.col("of_source")), "left").drop("of_source"), "mix-factors")

    ordered = _ranked(units.filter("mix_size > 0"), targets).withColumn("unit_words", F.col("mix_size") * F.col("n"))
    by_bucket = ordered.groupBy("mix_source", "mix_bucket").agg(F.sum("unit_words").alias("bucket_words"))
    per_bucket = W.partitionBy("mix_source").orderBy("mix_bucket")
    sums = by_bucket.withColumn("through", F.sum("bucket_words").over(per_bucket)).join(
        targets.select(F.col("mix_source").alias("of_source"), "rest_words"), F.col("mix_source").eqNullSafe(F.col("of_source"))
    )
    edge = (
        sums.filter("through > rest_words")
        .groupBy("mix_source")
        .agg(F.min("mix_bucket").alias("edge_bucket"), F.min_by(F.col("through") - F.col("bucket_words"), "mix_bucket").alias("edge_before"))
    )
    bounds = targets.join(edge.withColumnRenamed("mix_source", "of_source"), F.col("mix_source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    at_edge = _ranked(units.filter("mix_size > 0"), bounds).withColumn("unit_words", F.col("mix_size") * F.col("n"))
    inside = at_edge.filter("mix_bucket = edge_bucket").withColumn(
        "through", F.col("edge_before") + F.sum("unit_words").over(W.partitionBy("mix_source").orderBy("mix_q", "mix_id", "mix_size"))
    )
    cut = (
        inside.filter("through <= rest_words")
        .groupBy("mix_source")
        .agg(F.max(F.struct("mix_q", "mix_id", "mix_size")).alias("cut"), F.max("through").alias("cut_words"))
    )
    bounds = bounds.join(cut.withColumnRenamed("mix_source", "of_source"), F.col("mix_source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    bounds = staged(bounds.withColumn("missing", F.col("rest_words") - F.coalesce("cut_words", "edge_before", F.lit(0))), "mix-bounds")

    rest = _ranked(units.filter("mix_size > 0"), bounds).filter(~_in_head())
    closing = (
        rest.withColumn("off", F.abs(F.col("missing") - F.col("mix_size") * F.col("n")))
        .filter("off < missing")
        .groupBy("mix_source")
        .agg(F.min(F.struct("off", "mix_q", "mix_id", "mix_size")).alias("closing"))
    )
    bounds = bounds.join(closing.withColumnRenamed("mix_source", "of_source"), F.col("mix_source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    bounds = staged(bounds, "mix-closing")
    mine = F.struct("mix_q", "mix_id", "mix_size")
    closes = F.coalesce(mine == F.struct("closing.mix_q", "closing.mix_id", "closing.mix_size"), F.lit(False)) & F.col("closing").isNotNull()
    extra = F.when((F.col("mix_size") > 0) & (_in_head() | closes), 1).otherwise(0)
    return (
        _ranked(keyed, bounds)
        .withColumn("mix_copies", F.col("certain") + extra)
        .select(
            *unboxed(docs, ("mix_size", "mix_source_size", "mix_target", "mix_copies")),
            "mix_size",
            F.col("words").alias("mix_source_size"),
            F.col("target").alias("mix_target"),
            "mix_copies",
        )
    )


def _in_head() -> Column:
    """Whether a ranked row comes before its source's cut; a source without an edge takes everything."""
    here = F.struct("mix_q", "mix_id", "mix_size")
    return (
        F.col("edge_bucket").isNull()
        | (F.col("mix_bucket") < F.col("edge_bucket"))
        | ((F.col("mix_bucket") == F.col("edge_bucket")) & F.col("cut").isNotNull() & (here <= F.col("cut")))
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken."""
    row = docs.select(boxed(docs), "doc_id", "text", "source")
    taken = mix_sources(row, weights, share, max_copies, seed).filter("mix_copies > 0")
    return taken.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*unboxed(docs))
