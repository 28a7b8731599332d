"""Catalog queries: parts are products, line items are offers, suppliers are shops in nations and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import predicates as P
from tallyloom.functions import vectors as V
from tallyloom.operators import catalog as C
from tallyloom.plans.base import query
from tallyloom.sources.tables import table

#: Exchange rates by nation, so that conversion has known and unknown currencies; nations from 20 on have none.
RATE = "CASE WHEN {n} < 20 THEN CAST(1 + {n} * 0.05 AS DECIMAL(6,2)) END"
#: Money is stored as DOUBLE; products and sums of it are taken as decimals, so that they round alike everywhere.
MONEY = "CAST(l_extendedprice AS DECIMAL(12,2))"


def _shops(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    shops = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return shops.select("s_suppkey", "n_nationkey", "r_name", F.expr(RATE.format(n="n_nationkey")).alias("rate"))


def _offers(spark, d):
    return table(spark, d, "lineitem").withColumn("available", F.col("l_returnflag") != "R")


@query(
    "catalog_search",
    """
WITH shops AS (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'),
cheap AS (SELECT l_partkey, min(l_extendedprice) AS cheapest FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT p_partkey, p_name, p_brand, round(cheapest, 2) AS cheapest
FROM part LEFT JOIN cheap ON l_partkey = p_partkey
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p_partkey AND l_suppkey IN (SELECT s_suppkey FROM shops))
  AND (contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_name), 'blue') OR contains(lower(p_brand), 'blue'))
  AND (contains(lower(p_name), 'bolt') OR contains(lower(p_brand), 'bolt') OR contains(replace(lower(p_name), ' ', ''), 'bolt') OR contains(lower(p_name), 'gear') OR contains(lower(p_brand), 'gear'))
  AND p_size <= 40
ORDER BY cheapest IS NULL, cheapest, p_partkey
""",
)
def catalog_search(spark, d):
    """Faceted search: all terms (with their aliases), shops of a region, a size limit, ordered by the cheapest offer."""
    products, offers = table(spark, d, "part"), _offers(spark, d)
    terms = P.expand_search(["crimson", "bolt"], {"crimson": ["red", "blue"], "bolt": ["gear"]})
    shops = _shops(spark, d).filter("r_name = 'ASIA'").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("there"))
    found = products.filter((F.col("p_size") <= 40) & P.matches_all(terms, [F.col("p_name"), F.col("p_brand")]))
    known = offers.select("l_partkey", "l_suppkey", "l_extendedprice", "available").join(shops, "l_suppkey", "left")
    summary = C.offer_summary(known, "l_partkey", F.col("l_extendedprice"), F.col("available"), F.col("there")).withColumnRenamed("l_partkey", "p_partkey")
    priced = found.join(summary.filter("any_there"), "p_partkey")
    return priced.select("p_partkey", "p_name", "p_brand", F.round("cheapest", 2).alias("cheapest")).orderBy(F.col("cheapest").asc_nulls_last(), "p_partkey")


@query(
    "catalog_page",
    """
WITH hit AS (SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_type = 'PROMO')
SELECT p_partkey, p_name, round(p_retailprice, 2) AS p_retailprice, (SELECT count(*) FROM hit) AS total, greatest(ceil((SELECT count(*) FROM hit) / 20.0), 1)::BIGINT AS last_page
FROM hit ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 20
""",
)
def catalog_page(spark, d):
    """The second page of twenty, with total and last page."""
    hits = table(spark, d, "part").filter("p_type = 'PROMO'").select("p_partkey", "p_name", F.round("p_retailprice", 2).alias("p_retailprice"))
    return C.page(hits, [F.desc("p_retailprice"), F.asc("p_partkey")], 2, 20)


@query("compared_only", "SELECT p_partkey, count(DISTINCT l_suppkey) AS shops FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2")
def compared_only(spark, d):
    """Products that two shops or more offer."""
    offers = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_suppkey").alias("shops")).filter("shops >= 2")
    return table(spark, d, "part").select("p_partkey").join(offers, "p_partkey")


@query("facet_counts", "SELECT p_brand, p_type, count(*) AS products FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey) GROUP BY ALL")
def facet_counts(spark, d):
    """Brands and types that have offered products, with counts."""
    return C.having_any(table(spark, d, "part"), table(spark, d, "lineitem"), "p_partkey", "l_partkey").groupBy("p_brand", "p_type").agg(F.count("*").alias("products"))


@query("facet_options", "SELECT DISTINCT p_type, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size_class FROM part")
def facet_options(spark, d):
    """Distinct options of two facets."""
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "middle").otherwise("large")
    return table(spark, d, "part").select("p_type", size.alias("size_class")).distinct()


@query(
    "lowest_flag_ties",
    f"""
WITH o AS (SELECT l_partkey, l_suppkey, l_returnflag, round({MONEY} * {RATE.format(n='s_nationkey')}, 2)::DOUBLE AS price FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
f AS (SELECT *, l_returnflag <> 'R' AND price = min(CASE WHEN l_returnflag <> 'R' THEN price END) OVER (PARTITION BY l_partkey) AS lowest FROM o)
SELECT l_partkey, count(*) FILTER (lowest) AS lowest_offers, count(*) AS offers, round(min(price) FILTER (lowest), 2) AS lowest_price FROM f GROUP BY 1
""",
)
def lowest_flag_ties(spark, d):
    """Offers at the least converted price of their product, ties included; unknown currencies never are."""
    offers = _offers(spark, d).join(_shops(spark, d), F.col("l_suppkey") == F.col("s_suppkey"))
    offers = offers.withColumn("price", V.converted(F.expr(MONEY), F.col("rate")).cast("double"))
    flagged = C.flag_lowest(offers, "l_partkey", F.col("price"), F.col("available"))
    return flagged.groupBy("l_partkey").agg(F.count_if("lowest").alias("lowest_offers"), F.count("*").alias("offers"), F.round(F.min(F.when(F.col("lowest"), F.col("price"))), 2).alias("lowest_price"))


@query(
    "convert_currency",
    f"""
SELECT l_suppkey, count(*) AS offers, sum(round({MONEY} * {RATE.format(n='s_nationkey')}, 2))::DOUBLE AS converted,
       sum(round({MONEY} * coalesce({RATE.format(n='s_nationkey')}, 1), 2))::DOUBLE AS unknown_as_one, round(max(1 / ({RATE.format(n='s_nationkey')})::DOUBLE), 6) AS inverse
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1
""",
)
def convert_currency(spark, d):
    """Totals by shop under two of the rules for unknown currencies, and the inverse rate."""
    offers = table(spark, d, "lineitem").join(_shops(spark, d), F.col("l_suppkey") == F.col("s_suppkey"))
    price = F.expr(MONEY)
    return offers.groupBy("l_suppkey").agg(
        F.count("*").alias("offers"),
        F.sum(V.converted(price, F.col("rate"))).cast("double").alias("converted"),
        F.sum(V.converted(price, F.col("rate"), "one")).cast("double").alias("unknown_as_one"),
        F.max(V.inverse_rate(F.col("rate").cast("double"))).alias("inverse"),
    )


@query(
    "best_offer_per_shop",
    """
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice, l_returnflag FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_returnflag = 'R', l_extendedprice, l_orderkey, l_linenumber, l_returnflag) = 1
""",
)
def best_offer_per_shop(spark, d):
    """One offer by product and shop: in stock first, then the cheapest, then the earliest."""
    order = [F.asc("sold_out"), F.asc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_returnflag")]
    best = C.best_per(table(spark, d, "lineitem").withColumn("sold_out", F.col("l_returnflag") == "R"), ["l_partkey", "l_suppkey"], order)
    return best.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")


@query("dup_keys_having", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys_having(spark, d):
    """Keys that occur more than once."""
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).filter("n > 1")


@query("keep_latest_per_key", "SELECT l_partkey, l_suppkey, max(l_orderkey) AS l_orderkey FROM lineitem GROUP BY ALL")
def keep_latest_per_key(spark, d):
    """The row of the largest id by key."""
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_orderkey").alias("l_orderkey"))


@query(
    "keep_cheapest_per_key",
    "SELECT l_partkey, l_suppkey, l_extendedprice, l_orderkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice, l_orderkey) = 1",
)
def keep_cheapest_per_key(spark, d):
    """The cheapest row by key, then the lowest id."""
    kept = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(F.struct("l_extendedprice", "l_orderkey")).alias("k"))
    return kept.select("l_partkey", "l_suppkey", "k.l_extendedprice", "k.l_orderkey")


@query(
    "price_spread",
    """
SELECT l_partkey, round(min(l_extendedprice), 2) AS low, round(max(l_extendedprice), 2) AS high, round(sum(CAST(l_extendedprice AS DECIMAL(12,2)))::DOUBLE / count(*), 8) AS mean, count(*) AS n_offers,
       round(max(l_extendedprice) - min(l_extendedprice), 2) AS spread, floor((max(l_extendedprice) - min(l_extendedprice)) * 100 / max(l_extendedprice))::BIGINT AS discount_pct
FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1
""",
)
def price_spread(spark, d):
    """Statistics of the available prices of every product."""
    s = C.price_summary(_offers(spark, d), "l_partkey", F.col("l_extendedprice"), F.col("available"))
    return s.select("l_partkey", *[F.round(c, 2).alias(c) for c in ("low", "high", "spread")], F.round("mean", 8).alias("mean"), "n_offers", "discount_pct")


@query(
    "relation_counts",
    """
SELECT c_custkey, coalesce(o.n, 0) AS orders, coalesce(l.n, 0) AS lines, coalesce(u.n, 0) AS urgent FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) l ON l.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) u ON u.o_custkey = c_custkey
""",
)
def relation_counts(spark, d):
    """Three counts of related rows by customer, zeros kept, from one pass over the orders."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    orders = table(spark, d, "orders").join(lines, "o_orderkey", "left")
    counts = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum(F.coalesce("n", F.lit(0))).alias("lines"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    return table(spark, d, "customer").select("c_custkey").join(counts, "c_custkey", "left").na.fill(0, ["orders", "lines", "urgent"])


@query("two_key_group_count", "SELECT p_type, p_size, count(*) AS n FROM part GROUP BY ALL")
def two_key_group_count(spark, d):
    """Counts by two keys."""
    return table(spark, d, "part").groupBy("p_type", "p_size").agg(F.count("*").alias("n"))


@query(
    "wish_groups",
    """
SELECT o_custkey, count(DISTINCT l_partkey) AS products,
       arg_min(p_name, (l_partkey, l_orderkey)) || CASE WHEN count(DISTINCT l_partkey) > 1 THEN ' and ' || (count(DISTINCT l_partkey) - 1) || ' more' ELSE '' END AS message
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1
""",
)
def wish_groups(spark, d):
    """Distinct products by customer and a message of the first and how many more."""
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    groups = rows.groupBy("o_custkey").agg(F.countDistinct("l_partkey").alias("products"), F.min(F.struct("l_partkey", "l_orderkey", "p_name")).alias("first"))
    more = F.when(F.col("products") > 1, F.concat(F.lit(" and "), (F.col("products") - 1).cast("string"), F.lit(" more"))).otherwise("")
    return groups.select("o_custkey", "products", F.concat("first.p_name", more).alias("message"))


@query(
    "best_family_member",
    "SELECT * FROM (SELECT p_brand, p_name, max(p_size) AS top_size FROM part GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY top_size DESC, p_name) <= 3",
)
def best_family_member(spark, d):
    """The largest of each name within a brand, the three best of each brand."""
    best = table(spark, d, "part").groupBy("p_brand", "p_name").agg(F.max("p_size").alias("top_size"))
    return best.withColumn("n", F.expr("row_number() OVER (PARTITION BY p_brand ORDER BY top_size DESC, p_name)")).filter("n <= 3").drop("n")


@query(
    "relative_scale",
    "SELECT p_type, sum(p_retailprice)::DECIMAL(18,2)::DOUBLE AS total, round(sum(p_retailprice)::DECIMAL(18,2)::DOUBLE / max(sum(p_retailprice)::DECIMAL(18,2)::DOUBLE) OVER (), 6) AS share_of_top FROM part GROUP BY 1",
)
def relative_scale(spark, d):
    """Totals by type, as shares of the largest total."""
    totals = table(spark, d, "part").groupBy("p_type").agg(F.sum("p_retailprice").cast("decimal(18,2)").cast("double").alias("total"))
    return totals.withColumn("share_of_top", F.expr("round(total / max(total) OVER (), 6)"))
