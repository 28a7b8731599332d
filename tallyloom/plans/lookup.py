"""Joins: lookups in tiers, anti- and semi-joins, set operations, access logs and subscriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import predicates as P
from tallyloom.functions import text as T
from tallyloom.operators import lookup as L
from tallyloom.operators.joins import attached
from tallyloom.operators.lineage import checkpointed
from tallyloom.plans.base import query
from tallyloom.sources.tables import table


@query(
    "tiered_lookup",
    r"""
WITH l AS (SELECT p_partkey, p_name, p_brand FROM part WHERE p_size > 25),
m AS (SELECT p_partkey, p_name, p_brand FROM part WHERE p_size <= 25),
a AS (SELECT p_name || '|' || p_brand AS k, min(p_partkey) AS id FROM m GROUP BY 1),
b AS (SELECT replace(p_name, ' ', '') AS k, min(p_partkey) AS id FROM m GROUP BY 1 HAVING count(*) = 1),
c AS (SELECT split_part(p_name, ' ', 1) AS k, min(p_partkey) AS id FROM m GROUP BY 1)
SELECT l.p_partkey, coalesce(a.id, b.id, c.id) AS master, CASE WHEN a.id IS NOT NULL THEN 1 WHEN b.id IS NOT NULL THEN 2 WHEN c.id IS NOT NULL THEN 3 END AS tier
FROM l LEFT JOIN a ON a.k = l.p_name || '|' || l.p_brand LEFT JOIN b ON b.k = replace(l.p_name, ' ', '') LEFT JOIN c ON c.k = split_part(l.p_name, ' ', 1)
""",
)
def tiered_lookup(spark, d):
    """Exact key, else the compact name if unique, else the first word."""
    part = table(spark, d, "part")
    exact, compact, word = F.concat_ws("|", "p_name", "p_brand"), T.name_key(F.col("p_name")), F.split_part("p_name", F.lit(" "), F.lit(1))
    return L.tiered_lookup(part.filter("p_size > 25"), "p_partkey", part.filter("p_size <= 25"), "p_partkey", [(exact, exact, False), (compact, compact, True), (word, word, False)])


@query(
    "name_key_join",
    "SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON lower(replace('nation:' || s_nationkey, ':', '_')) = lower(trim(n_name)) GROUP BY 1",
)
def name_key_join(spark, d):
    """Equi-join on normalised names."""
    s = table(spark, d, "supplier").withColumn("name_key", T.wide_name_key(F.concat(F.lit("Nation: "), F.col("s_nationkey").cast("string"))))
    n = table(spark, d, "nation").withColumn("name_key", T.wide_name_key(F.col("n_name")))
    return s.join(n, "name_key").groupBy("n_name").agg(F.count("*").alias("suppliers"))


@query("not_seen", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '2000-01-01')")
def not_seen(spark, d):
    """Products without an offer since a date."""
    seen = table(spark, d, "lineitem").filter("l_shipdate >= timestamp'2000-01-01'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(seen, "p_partkey", "left_anti")


@query("set_ops_difference", "SELECT DISTINCT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_ops_difference(spark, d):
    """Nations of customers without a rich supplier."""
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(table(spark, d, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("set_ops_intersection", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def set_ops_intersection(spark, d):
    """Products with both kinds of offers."""
    lines = table(spark, d, "lineitem")
    return lines.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).intersect(lines.filter("l_returnflag = 'A'").select("l_partkey"))


@query("boss_suffix_cross", "SELECT r_name || s AS label, r_regionkey FROM region, (VALUES (' Guide'), (' Party'), (' Raid')) v(s)")
def boss_suffix_cross(spark, d):
    """Names times a fixed list of three suffixes."""
    suffix = F.explode(F.array(F.lit(" Guide"), F.lit(" Party"), F.lit(" Raid")))
    return table(spark, d, "region").withColumn("suffix", suffix).select(F.concat("r_name", "suffix").alias("label"), "r_regionkey")


@query(
    "user_scope",
    "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')",
)
def user_scope(spark, d):
    """Rows that belong to owners of a kind."""
    owners = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(owners, "o_custkey", "left_semi").select("o_orderkey")


@query(
    "dimension_groups",
    "SELECT k AS p_type, pos, count(p_partkey) AS n, coalesce(string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey), '') AS members FROM (VALUES ('PROMO', 1), ('GHOST', 2), ('SMALL', 3)) v(k, pos) LEFT JOIN part ON p_type = k GROUP BY ALL",
)
def dimension_groups(spark, d):
    """Groups in the order of a fixed dimension, one without members kept."""
    dimension = spark.createDataFrame([("PROMO", 1), ("GHOST", 2), ("SMALL", 3)], "p_type string, pos int")
    grouped = L.grouped_in_order(table(spark, d, "part"), dimension, "p_type", "p_partkey")
    return grouped.select("p_type", "pos", F.size("members").cast("long").alias("n"), F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


@query(
    "substitutes_attached",
    "WITH s AS (SELECT p_brand, p_type, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_retailprice DESC, p_partkey) AS l, count(*) AS n FROM part GROUP BY ALL) SELECT p.p_partkey, s.n, s.l AS substitutes FROM part p JOIN s ON s.p_brand = p.p_brand AND s.p_type = p.p_type",
)
def substitutes_attached(spark, d):
    """Lists of substitutes attached to the rows of their group."""
    part = table(spark, d, "part")
    entry = F.array_sort(F.collect_list(F.struct((-F.col("p_retailprice")).alias("p"), "p_partkey")))
    listed = F.array_join(F.transform(entry, lambda e: e["p_partkey"].cast("string")), ",")  # made once for a group, not for each row
    groups = checkpointed(part.groupBy("p_brand", "p_type").agg(listed.alias("substitutes"), F.count("*").alias("n")))
    joined = attached(part.select("p_partkey", "p_brand", "p_type"), groups, ["p_brand", "p_type"], "p_partkey", "substitutes")
    return joined.select("p_partkey", "n", "substitutes")


_AGENTS = "CASE user_id % 5 WHEN 0 THEN 'Googlebot/2.1' WHEN 1 THEN 'iPad; CPU OS' WHEN 2 THEN 'Android Mobile' ELSE 'Windows NT' END"


@query(
    "access_by_device",
    "SELECT CASE user_id % 5 WHEN 0 THEN 'bot' WHEN 1 THEN 'tablet' WHEN 2 THEN 'mobile' ELSE 'pc' END AS device, count(*) AS n FROM events GROUP BY 1",
)
def access_by_device(spark, d):
    """Requests by class of device; the agents come from the user's number."""
    return table(spark, d, "events").groupBy(T.device_class(F.expr(_AGENTS)).alias("device")).agg(F.count("*").alias("n"))


@query(
    "top_referrers",
    r"SELECT regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\.', '') AS host, count(*) AS n FROM pages WHERE NOT contains(url, 'example.org') GROUP BY 1 ORDER BY n DESC, host LIMIT 10",
)
def top_referrers(spark, d):
    """The ten hosts with most pages, the own host left out."""
    pages = table(spark, d, "pages").filter(~P.contains_text(F.col("url"), "example.org"))
    return pages.groupBy(T.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(10)


@query(
    "usable_codes",
    """
WITH c AS (SELECT event_id, event_type, ts, value, ts + to_days(floor(value)::INT % 30) AS expires FROM events)
SELECT event_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS class, date_diff('day', DATE '2024-01-15', expires::DATE)::BIGINT AS days_left
FROM c WHERE ts <= TIMESTAMP '2024-01-15' AND expires > TIMESTAMP '2024-01-15'
""",
)
def usable_codes(spark, d):
    """Codes found by a moment and not expired at it, their class and days left."""
    as_of = F.lit("2024-01-15").cast("timestamp_ntz")
    codes = table(spark, d, "events").withColumn("expires", F.expr("ts + make_dt_interval(pmod(cast(floor(value) as int), 30))"))
    held = codes.filter((F.col("ts") <= as_of) & P.is_usable(F.col("expires"), as_of))
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    return held.select("event_id", rank.alias("class"), F.date_diff(F.to_date("expires"), F.lit("2024-01-15").cast("date")).cast("long").alias("days_left"))


@query(
    "verified_split",
    """
WITH c AS (SELECT user_id, event_id, event_type = 'purchase' AS verified FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, verified ORDER BY event_id DESC) AS nth FROM c)
SELECT user_id, verified, count(*) AS n, min(event_id) AS oldest FROM n WHERE nth <= CASE WHEN verified THEN 30 ELSE 40 END GROUP BY ALL
""",
)
def verified_split(spark, d):
    """The newest 30 verified and 40 other codes of each game."""
    codes = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("verified"))
    codes = codes.withColumn("nth", F.expr("row_number() OVER (PARTITION BY user_id, verified ORDER BY event_id DESC)"))
    kept = codes.filter(F.col("nth") <= F.when(F.col("verified"), 30).otherwise(40))
    return kept.groupBy("user_id", "verified").agg(F.count("*").alias("n"), F.min("event_id").alias("oldest"))


@query(
    "topic_subscribers",
    "SELECT user_id, count(*) AS n FROM (SELECT user_id, json_extract_string(props, '$.k')::INT AS k FROM events) WHERE k % 4 = 0 OR k % 3 = 1 GROUP BY 1",
)
def topic_subscribers(spark, d):
    """Subscriptions that take a topic: null topics take all. Topics come from the events' JSON."""
    k = F.get_json_object("props", "$.k").cast("int")
    topics = F.when(k % 4 != 0, F.array(F.concat(F.lit("t"), (k % 3).cast("string"))))
    subs = table(spark, d, "events").withColumn("topics", topics)
    return subs.filter(P.is_subscribed(F.col("topics"), "t1")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("jpop_filter", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang <> 'en' OR l.quality = 1 OR l.quality IS NULL")
def jpop_filter(spark, d):
    """One language is restricted to good documents; unlabelled ones pass."""
    docs = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.filter(P.passes_genre(F.col("lang"), F.col("quality"), "en", F.lit(1))).select("doc_id")


@query(
    "network_decisions",
    """
WITH i AS (SELECT event_id, [10 + user_id % 3, 1, user_id % 200, event_id % 256] AS p FROM events)
SELECT event_id, CASE WHEN p[1] = 10 AND p[3] < 16 THEN 'allow' WHEN p[1] = 10 THEN 'block' ELSE 'pass' END AS decision FROM i
""",
)
def network_decisions(spark, d):
    """Allow lists before block lists, by network."""
    ip = F.expr("concat_ws('.', 10 + user_id % 3, 1, user_id % 200, event_id % 256)")
    return table(spark, d, "events").select("event_id", P.access_decision(ip, ["10.1.0.0/20"], ["10.0.0.0/8"]).alias("decision"))


@query(
    "mode_vote",
    "SELECT user_id, event_type AS mode, n AS votes FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1",
)
def mode_vote(spark, d):
    """The commonest value of each key; ties go to the one seen first."""
    votes = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    best = votes.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "event_type", "n")).alias("b"))
    return best.select("user_id", F.col("b.event_type").alias("mode"), F.col("b.n").alias("votes"))


@query(
    "count_text",
    "SELECT user_id, sum(n)::BIGINT AS total, string_agg(event_type || ' ' || n, ', ' ORDER BY event_type) AS summary FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1",
)
def count_text(spark, d):
    """Counts by type as one line of text for each user, with the total."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda e: F.concat_ws(" ", e["event_type"], e["n"])), ", ")
    return n.groupBy("user_id").agg(F.sum("n").alias("total"), line.alias("summary"))
