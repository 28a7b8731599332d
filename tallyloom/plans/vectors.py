"""Vector and bit queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import vectors as V
from tallyloom.operators import resolve as R
from tallyloom.plans.base import query
from tallyloom.sources.tables import table


@query(
    "cosine_topk",
    """
WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, list_dot_product(e.embedding::DOUBLE[], q.v) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.v, q.v))) AS s FROM embeddings e, q WHERE vec_id <> 0)
SELECT vec_id, round(s, 6) AS score FROM s WHERE s >= 0.2 ORDER BY s DESC, vec_id LIMIT 3
""",
)
def cosine_topk(spark, d):
    """The three memories most like one, above a floor. One query vector is one row, so it is broadcast."""
    e = table(spark, d, "embeddings")
    q = F.broadcast(e.filter("vec_id = 0").select(F.col("embedding").alias("q")))
    scored = e.filter("vec_id <> 0").crossJoin(q).select("vec_id", V.cosine(F.col("embedding"), F.col("q")).alias("s"))
    return scored.filter("s >= 0.2").orderBy(F.desc("s"), "vec_id").limit(3).select("vec_id", F.round("s", 6).alias("score"))


_BITS = "list_reduce(list_prepend(0::BIGINT, list_transform(embedding[{a}:{b}], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END::BIGINT)), lambda s, x: s * 2 + x)"


@query(
    "hamming_pairs",
    f"""
WITH h AS (SELECT vec_id, label, {_BITS.format(a=1, b=32)} AS hi, {_BITS.format(a=33, b=64)} AS lo FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::BIGINT AS bits
FROM h a JOIN h b ON a.label = b.label AND a.vec_id < b.vec_id WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 20
""",
)
def hamming_pairs(spark, d):
    """Pairs within a block whose sign hashes differ in at most twenty bits."""
    e = F.col("embedding")
    h = table(spark, d, "embeddings").select("vec_id", "label", V.sign_bits(e, 32, 1).alias("hi"), V.sign_bits(e, 32, 33).alias("lo"))
    bits = F.bit_count(F.col("l.hi").bitwiseXOR(F.col("r.hi"))) + F.bit_count(F.col("l.lo").bitwiseXOR(F.col("r.lo")))
    return R.block_pairs(h, "label", "vec_id", bits <= 20).select(F.col("l.vec_id").alias("a"), F.col("r.vec_id").alias("b"), bits.cast("long").alias("bits"))


@query(
    "cluster_centres",
    "SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS c1, round(avg(embedding[64]::DOUBLE), 6) AS c64 FROM embeddings GROUP BY 1",
)
def cluster_centres(spark, d):
    """Means of two components by label."""
    e = table(spark, d, "embeddings")
    return e.groupBy("label").agg(F.count("*").alias("n"), *[F.round(F.avg(F.get("embedding", F.lit(i - 1)).cast("double")), 6).alias(f"c{i}") for i in (1, 64)])


@query(
    "nearest_by_label",
    """
WITH c AS (SELECT label, min(vec_id) AS id FROM embeddings GROUP BY 1), q AS (SELECT e.label, e.embedding::DOUBLE[] AS q FROM embeddings e JOIN c ON c.id = e.vec_id)
SELECT e.label, vec_id, round(list_dot_product(embedding::DOUBLE[], q), 6) AS dot FROM embeddings e JOIN q USING (label)
QUALIFY row_number() OVER (PARTITION BY e.label ORDER BY list_dot_product(embedding::DOUBLE[], q) DESC, vec_id) <= 2
""",
)
def nearest_by_label(spark, d):
    """The two vectors of each label with the largest product with its first one."""
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    scored = e.join(first, "label").select("label", "vec_id", V.dot(F.col("embedding"), F.col("q")).alias("s"))
    n = F.row_number().over(W.partitionBy("label").orderBy(F.desc("s"), "vec_id"))
    return scored.withColumn("n", n).filter("n <= 2").select("label", "vec_id", F.round("s", 6).alias("dot"))
