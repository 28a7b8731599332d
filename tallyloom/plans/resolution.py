"""Entity resolution queries: parts as listings, brands as works."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.functions import vectors as V
from tallyloom.operators import resolve as R
from tallyloom.plans.base import query
from tallyloom.sources.tables import table

_LISTED = "SELECT p_partkey, p_name, p_type, p_size, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS work, replace(p_name, ' ', '') || '/' || p_type || '/' || p_size AS base FROM part"


def _listings(spark, d):
    work = F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand"))
    base = F.concat_ws("/", T.name_key(F.col("p_name")), "p_type", "p_size")
    return table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size", work.alias("work"), base.alias("base"))


@query(
    "bundle_keys",
    f"SELECT p_partkey, md5(base || '#' || coalesce(work, '-')) AS bundle_key FROM ({_LISTED})",
)
def bundle_keys(spark, d):
    """Keys of base and work."""
    key = F.md5(F.concat("base", F.lit("#"), F.coalesce("work", F.lit("-"))))
    return _listings(spark, d).select("p_partkey", key.alias("bundle_key"))


_ABSORBED = f"""
SELECT l.*, l.base || '#' || coalesce(l.work, CASE WHEN w.n = 1 THEN w.only_work END, '-') AS bundle FROM ({_LISTED}) l
LEFT JOIN (SELECT base, count(DISTINCT work) AS n, min(work) AS only_work FROM ({_LISTED}) WHERE work IS NOT NULL GROUP BY 1) w ON w.base = l.base
"""


@query("absorb_bundles", f"SELECT p_partkey, bundle FROM ({_ABSORBED})")
def absorb_bundles(spark, d):
    """Listings without a work join the only work of their base."""
    return R.absorb(_listings(spark, d), "base", "work").select("p_partkey", "bundle")


@query(
    "maker_groups",
    f"""
WITH l AS (SELECT *, count(DISTINCT work) OVER (PARTITION BY p_name, p_type) AS works FROM (SELECT p_partkey, p_name, p_type, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS work FROM part))
SELECT p_name, p_type, CASE WHEN works <= 1 THEN '*' ELSE coalesce(work, '-') END AS work_key, count(*) AS n, min(p_partkey) AS first FROM l WHERE works <= 1 OR work IS NOT NULL GROUP BY ALL
""",
)
def maker_groups(spark, d):
    """Groups by code and work; without a work only where there is at most one."""
    l = _listings(spark, d)
    works = l.groupBy("p_name", "p_type").agg(F.countDistinct("work").alias("works"))
    l = l.join(works, ["p_name", "p_type"]).filter("works <= 1 or work is not null")
    key = F.when(F.col("works") <= 1, "*").otherwise(F.coalesce("work", F.lit("-")))
    return l.groupBy("p_name", "p_type", key.alias("work_key")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query(
    "signature_groups",
    "SELECT array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS sig, p_brand, p_size % 3 AS variant, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY ALL HAVING count(*) > 1",
)
def signature_groups(spark, d):
    """Groups of more than one by signature, maker and variant."""
    sig = F.array_join(F.array_sort(F.split("p_name", " ")), " ")
    g = table(spark, d, "part").groupBy(sig.alias("sig"), "p_brand", (F.col("p_size") % 3).alias("variant"))
    return g.agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).filter("n > 1")


_EDGES = """
WITH RECURSIVE p AS (SELECT p_partkey AS id, p_brand, p_type, p_retailprice::DECIMAL(12,2) AS price FROM part),
e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.id <> b.id AND abs(a.price - b.price) <= 5),
r(node, reach) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
"""


@query("similarity_clusters", _EDGES + "SELECT node, min(reach) AS cluster FROM r GROUP BY 1")
def similarity_clusters(spark, d):
    """Clusters of products of a block whose prices lie close; sorted neighbours are enough of the links."""
    close = F.col("price") - F.expr("lag(price) OVER (PARTITION BY p_brand, p_type ORDER BY price, id)") <= 5
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", F.col("p_retailprice").cast("decimal(12,2)").alias("price"))
    edges = p.withColumn("b", F.when(close, F.expr("lag(id) OVER (PARTITION BY p_brand, p_type ORDER BY price, id)"))).filter("b is not null").select(F.col("id").alias("a"), "b")
    return R.clusters(edges)


_HASHES = """
WITH RECURSIVE h AS (SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM h a JOIN h b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) <= 21),
r(node, reach) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT node, min(reach) AS cluster FROM r GROUP BY 1
"""


@query("hash_clusters", _HASHES)
def hash_clusters(spark, d):
    """Clusters of a block whose hashes differ in at most 21 bits."""
    e = F.col("embedding")
    h = table(spark, d, "embeddings").select("vec_id", "label", V.sign_bits(e, 32, 1).alias("hi"), V.sign_bits(e, 32, 33).alias("lo"))
    bits = F.bit_count(F.col("l.hi").bitwiseXOR(F.col("r.hi"))) + F.bit_count(F.col("l.lo").bitwiseXOR(F.col("r.lo")))
    return R.clusters(R.block_pairs(h, "label", "vec_id", bits <= 21).select(F.col("l.vec_id").alias("a"), F.col("r.vec_id").alias("b")))


@query(
    "merge_canonical",
    """
WITH n AS (SELECT p_partkey, p_name, p_brand, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS offers FROM part),
c AS (SELECT *, first_value(p_partkey) OVER (PARTITION BY p_name, p_brand ORDER BY offers DESC, p_partkey) AS canonical FROM n)
SELECT canonical, count(*) AS merged, sum(offers)::BIGINT AS offers FROM c GROUP BY 1
""",
)
def merge_canonical(spark, d):
    """Groups merged into the member with most offers, then the lowest id."""
    offers = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("offers"))
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("|", "p_name", "p_brand").alias("g")).join(offers, "p_partkey", "left").na.fill(0, ["offers"])
    return R.canonical(p, "g", "p_partkey", "offers").groupBy("canonical").agg(F.count("*").alias("merged"), F.sum("offers").alias("offers"))


@query(
    "hash_priority",
    """
WITH p AS (SELECT p_partkey, p_brand || p_type AS block, p_size % 3 = 0 AS done FROM part),
a AS (SELECT p_partkey, count(*) FILTER (done) OVER w AS n, count(*) OVER w AS size, done FROM p WINDOW w AS (PARTITION BY block)),
one AS (SELECT p_partkey FROM a WHERE NOT done AND size > 1 ORDER BY n DESC, p_partkey LIMIT 300),
q AS (SELECT p_partkey, block, done OR p_partkey IN (FROM one) AS done FROM p),
b AS (SELECT p_partkey, count(*) FILTER (done) OVER w AS n, count(*) OVER w AS size, done FROM q WINDOW w AS (PARTITION BY block)),
two AS (SELECT p_partkey FROM b WHERE NOT done AND size > 1 ORDER BY n DESC, p_partkey LIMIT 300)
SELECT 1 AS run, p_partkey FROM one UNION ALL SELECT 2, p_partkey FROM two
""",
)
def hash_priority(spark, d):
    """Open work of two runs under a budget, the nearly complete blocks first (the budget is the feature)."""
    parts = table(spark, d, "part").select("p_partkey", F.concat("p_brand", "p_type").alias("block"), (F.col("p_size") % 3 == 0).alias("done"))
    one = R.open_work(parts, "block", "p_partkey", "done", 300).select("p_partkey")
    after = parts.join(one.withColumn("now_", F.lit(True)), "p_partkey", "left").withColumn("done", F.col("done") | F.coalesce("now_", F.lit(False))).drop("now_")
    two = R.open_work(after, "block", "p_partkey", "done", 300).select("p_partkey")
    return one.select(F.lit(1).alias("run"), "p_partkey").union(two.select(F.lit(2), "p_partkey"))
