"""Matching and merging queries: parts as listings and products, nations as events, suppliers as characters."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import ingest as I
from tallyloom.operators import lookup as L
from tallyloom.operators import matching as M
from tallyloom.operators import resolve as R
from tallyloom.operators import windows as O
from tallyloom.operators.lineage import fresh_folder
from tallyloom.operators.ranks import positions
from tallyloom.plans.base import query
from tallyloom.sources import readers, sinks
from tallyloom.sources.tables import table
from tallyloom.sources.versions import Versions

_RIGID = frozenset(["red"])
_TOKENS = "list_distinct(list_append(string_split(p_name, ' '), lower(p_type)))"


def _tokens():
    return F.array_distinct(F.concat(F.split("p_name", " "), F.array(F.lower("p_type"))))


def _similar(a: str, b: str, least: int) -> str:
    only = lambda x, y: f"list_filter({x}, lambda w_: NOT list_contains({y}, w_))"
    lone = lambda x, y: f"len(list_filter({only(x, y)}, lambda x_: len(list_filter({only(y, x)}, lambda y_: contains(x_, y_) OR contains(y_, x_) OR left(x_, 2) = left(y_, 2))) = 0))"
    rigid = f"len(list_filter(list_concat({only(a, b)}, {only(b, a)}), lambda r_: contains(r_, 'red')))"
    return f"(len(list_intersect({a}, {b})) >= {least} AND {rigid} = 0 AND (len({only(a, b)}) = 0 OR len({only(b, a)}) = 0 OR ({lone(a, b)} = 0 AND {lone(b, a)} = 0)))"


_NAMED = f"SELECT p_brand, p_size % 3 AS scale, {_TOKENS} AS toks, min(p_partkey) AS id FROM part GROUP BY ALL"


@query(
    "token_clusters",
    f"""
WITH RECURSIVE p AS (SELECT p_brand, p_size % 3 AS scale, p_name, p_type, min(p_partkey) AS id, any_value({_TOKENS}) AS toks FROM part GROUP BY 1, 2, 3, 4),
e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.scale = b.scale AND a.id <> b.id AND {_similar("a.toks", "b.toks", 2)}),
r(node, reach) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT node, min(reach) AS cluster FROM r GROUP BY 1
""",
)
def token_clusters(spark, d):
    """Clusters of listings of a work and a scale whose words are similar."""
    part = table(spark, d, "part").withColumn("scale", F.col("p_size") % 3)
    rows = part.groupBy("p_brand", "scale", "p_name", "p_type").agg(F.min("p_partkey").alias("id")).withColumn("toks", _tokens())
    return R.clusters(R.similar_pairs(rows, ["p_brand", "scale"], "id", "toks", T.tokens_similar(2, _RIGID), 2))


_SIDES = f"""l AS (SELECT p_partkey AS id, p_brand, p_size % 3 AS scale, {_TOKENS} AS toks FROM part WHERE p_partkey % 5 = 0),
p AS (SELECT p_partkey AS product, p_brand, p_size % 3 AS scale, {_TOKENS} AS toks FROM part WHERE p_partkey % 5 <> 0)"""
_FUZZY = f"""SELECT l.id, arg_min(p.product, (-len(list_intersect(l.toks, p.toks)), p.product)) AS product, max(len(list_intersect(l.toks, p.toks)))::BIGINT AS shared
FROM l JOIN p ON l.p_brand = p.p_brand AND l.scale = p.scale AND {_similar("l.toks", "p.toks", 2)} GROUP BY 1"""


def _fuzzy(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_size") % 3).alias("scale"), _tokens().alias("toks"))
    rows = part.filter("p_partkey % 5 = 0").withColumnRenamed("p_partkey", "id")
    products = part.filter("p_partkey % 5 <> 0").withColumnRenamed("p_partkey", "product")
    return M.fuzzy_best(rows, products, ["p_brand", "scale"], "id", "product", "toks", 2, _RIGID)


@query("fuzzy_products", f"WITH {_SIDES} {_FUZZY}")
def fuzzy_products(spark, d):
    """For each listing the similar product of its work and scale that shares most words."""
    return _fuzzy(spark, d).select("id", "product", F.col("shared").cast("long"))


_LISTING = {
    "anchor": "CASE WHEN p_partkey % 6 = 0 THEN 'a' || (p_partkey % 40) END",
    "key": "p_name || '/' || p_brand",
    "barcode": "CASE WHEN p_partkey % 3 = 0 THEN 'jan' || (p_partkey % 700) END",
    "work": "CASE WHEN p_partkey % 7 <> 0 THEN p_brand END",
    "accessory": "p_partkey % 11 = 0",
}
_COLUMNS = ", ".join(f"{v} AS {k}" for k, v in _LISTING.items())


@query(
    "resolved_listings",
    f"""
WITH {_SIDES}, f AS ({_FUZZY}),
r AS (SELECT p_partkey AS id, {_COLUMNS} FROM part WHERE p_partkey % 5 = 0),
q AS (SELECT p_partkey AS product, {_COLUMNS} FROM part WHERE p_partkey % 5 <> 0),
a AS (SELECT anchor, min(product) AS p1 FROM q WHERE anchor IS NOT NULL GROUP BY 1), k AS (SELECT key, min(product) AS p2 FROM q GROUP BY 1),
j AS (SELECT barcode, min(product) AS p3 FROM q WHERE barcode IS NOT NULL GROUP BY 1 HAVING count(*) = 1),
s AS (SELECT r.*, p1, p2, p3, coalesce(p1, p2, p3) AS found FROM r LEFT JOIN a USING (anchor) LEFT JOIN k USING (key) LEFT JOIN j USING (barcode)),
g AS (SELECT s.*, coalesce(x.work <> s.work, false) AS clash, found IS NOT NULL AND x.accessory <> s.accessory AS mixed,
        CASE WHEN p2 <> found THEN p2 END AS owner, coalesce(o.work <> s.work, false) AS owner_clash
      FROM s LEFT JOIN q x ON x.product = s.found LEFT JOIN q o ON o.product = s.p2),
c AS (SELECT *, CASE WHEN clash THEN CASE WHEN NOT owner_clash THEN owner END WHEN mixed THEN owner ELSE found END AS kept FROM g)
SELECT c.id, coalesce(kept, CASE WHEN c.barcode IS NULL THEN f.product END) AS product,
       CASE WHEN kept IS NULL THEN CASE WHEN c.barcode IS NULL AND f.product IS NOT NULL THEN 'words' ELSE 'new' END
            WHEN clash OR mixed THEN 'owner' WHEN p1 IS NOT NULL THEN 'anchor' WHEN p2 IS NOT NULL THEN 'key' ELSE 'barcode' END AS by
FROM c LEFT JOIN f ON f.id = c.id
""",
)
def resolved_listings(spark, d):
    """Listings resolved to products: by known offer, key, unique barcode, guards, words, or new."""
    part = table(spark, d, "part").select("p_partkey", *[F.expr(v).alias(k) for k, v in _LISTING.items()])
    rows = part.filter("p_partkey % 5 = 0").withColumnRenamed("p_partkey", "id")
    products = part.filter("p_partkey % 5 <> 0").withColumnRenamed("p_partkey", "product")
    return M.resolved(rows, products, products.filter("anchor is not null").select("anchor", "product"), _fuzzy(spark, d))


_GROUPED = "SELECT p_partkey, p_brand, p_name, p_size, ((('0x' || left(md5(p_name || p_brand), 15))::BIGINT)) AS h FROM part"
_HASH = "xor(h, (1::BIGINT << (p_partkey % 13)::INT) | (1::BIGINT << (20 + p_partkey % 17)::INT))"


@query(
    "image_groups",
    f"""
WITH RECURSIVE i AS (SELECT p_partkey AS id, p_brand, CASE WHEN p_size % 4 > 0 THEN p_size % 4 END AS scale, p_size % 10 = 0 AS acc, contains(p_name, 'red') AS variant, {_TOKENS.replace("lower(p_type)", "'x' || (p_partkey % 2)")} AS toks, {_HASH} AS bits FROM ({_GROUPED})),
e AS (SELECT a.id AS a, b.id AS b FROM i a JOIN i b ON a.p_brand = b.p_brand AND a.scale IS NOT DISTINCT FROM b.scale AND a.acc = b.acc AND a.variant = b.variant AND a.id <> b.id
      AND bit_count(xor(a.bits, b.bits)) <= 3 AND list_sort(a.toks)[:9] = list_sort(b.toks)[:9]),
r(node, reach) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT node, min(reach) AS cluster FROM r GROUP BY 1
""",
)
def image_groups(spark, d):
    """Clusters of a work by image hash under five guards: scale, accessory, variant words, no conflict of words, distance."""
    scale = F.when(F.col("p_size") % 4 > 0, F.col("p_size") % 4)
    toks = F.array_distinct(F.concat(F.split("p_name", " "), F.array(F.concat(F.lit("x"), (F.col("p_partkey") % 2).cast("string")))))
    base = F.conv(F.left(F.md5(F.concat("p_name", "p_brand")), F.lit(15)), 16, 10).cast("long")
    flips = F.expr("shiftleft(1L, int(p_partkey % 13)) | shiftleft(1L, int(20 + p_partkey % 17))")
    items = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        "p_brand",
        F.coalesce(scale, F.lit(0)).alias("scale"),
        (F.col("p_size") % 10 == 0).alias("acc"),
        F.array_join(T.keywords_in(F.col("p_name"), ["red"]), "+").alias("variant"),
        toks.alias("toks"),
        base.bitwiseXOR(flips).alias("bits"),
    )
    return M.hashed_clusters(items, ["p_brand", "scale", "acc", "variant"], "id", "bits", "toks", 3, _RIGID)


_SAID = "CASE event_id % 5 WHEN 0 THEN 'Guide for nation_' || (event_id % 31) WHEN 1 THEN 'weekly RAID notes' WHEN 2 THEN 'NATION_' || (event_id % 25) || ' and Nation_3 party' ELSE 'chat ' || event_id END"


def _posts(spark, d):
    return table(spark, d, "events").select("event_id", F.expr(_SAID).alias("said"), F.to_date("ts").alias("at"), F.expr("CASE WHEN event_id % 10 = 3 THEN CAST(event_id % 40 AS INT) END").alias("link"))


@query(
    "posts_of_raids",
    f"""
WITH t AS (SELECT event_id, {_SAID} AS said FROM events),
m AS (SELECT event_id, min(n_nationkey) AS n_nationkey FROM t JOIN nation ON contains(lower(said), lower(n_name)) GROUP BY 1),
c AS (SELECT coalesce(min(n_nationkey) FILTER (n_nationkey % 9 = 4), min(n_nationkey)) AS cur FROM nation)
SELECT t.event_id, coalesce(m.n_nationkey, CASE WHEN contains(lower(said), 'raid') THEN cur END) AS n_nationkey, CASE WHEN m.n_nationkey IS NOT NULL THEN 1 WHEN contains(lower(said), 'raid') THEN 2 END AS tier
FROM t LEFT JOIN m USING (event_id), c
""",
)
def posts_of_raids(spark, d):
    """Posts with the event they name, or the running one for a generic word."""
    return M.named_or_current(_posts(spark, d), "event_id", "said", table(spark, d, "nation"), "n_nationkey", "n_name", [F.asc("n_nationkey")], F.col("n_nationkey") % 9 == 4, ["raid"])


@query(
    "linked_posts",
    f"""
WITH t AS (SELECT event_id, {_SAID} AS said, ts::DATE AS "at", CASE WHEN event_id % 10 = 3 THEN event_id % 40 END AS link FROM events),
n AS (SELECT n_nationkey, n_name, DATE '2024-01-01' + n_nationkey AS starts FROM nation)
SELECT DISTINCT event_id, n_nationkey FROM t JOIN n ON link = n_nationkey OR (contains(lower(said), lower(n_name)) AND t."at" >= n.starts - 3)
""",
)
def linked_posts(spark, d):
    """Posts of events by explicit link, or by name since three days before the start."""
    events = table(spark, d, "nation").withColumn("starts", F.expr("date_add(date'2024-01-01', n_nationkey)"))
    return M.linked_or_named(_posts(spark, d), "event_id", "said", "at", "link", events, "n_nationkey", "n_name", "starts")


@query(
    "texts_naming",
    r"""
WITH n AS (SELECT name, min(item_id) AS item_id FROM (SELECT item_id, lower(unnest(string_split(text, ' '))) AS name FROM benchmark) WHERE length(name) >= 2 GROUP BY 1)
SELECT doc_id, count(*) AS n, min(item_id) AS first, sum(item_id)::BIGINT AS total FROM documents JOIN n ON contains(lower(text), name) GROUP BY 1
""",
)
def texts_naming(spark, d):
    """The names of a large dictionary (every word of the benchmark) that documents contain."""
    words = table(spark, d, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), " ")).alias("name")).filter(F.length("name") >= 2)
    names = words.groupBy("name").agg(F.min("item_id").alias("item_id"))
    found = M.names_of_texts(table(spark, d, "documents"), "doc_id", "text", names, "item_id", "name")
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, item: a + item)
    found = found.select("doc_id", F.size("ids").cast("long").alias("n"), F.array_min("ids").cast("long").alias("first"), total.alias("total"))
    return found.groupBy("doc_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("total").alias("total"))


@query(
    "party_names",
    """
WITH s AS (SELECT s_suppkey, 'n' || (s_suppkey % 50) AS name, 'b' || (s_suppkey % 20) AS base FROM supplier),
m AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'n' || (l_partkey % 70) ELSE 'b' || (l_partkey % 25) END AS name FROM lineitem),
x AS (SELECT name, min(s_suppkey) AS id FROM s GROUP BY 1), y AS (SELECT l_orderkey, base AS name, min(s_suppkey) AS id FROM lineitem JOIN s ON s_suppkey = l_suppkey GROUP BY 1, 2)
SELECT m.l_orderkey, m.l_linenumber, m.name, coalesce(x.id, y.id) AS s_suppkey, CASE WHEN x.id IS NOT NULL THEN 'exact' WHEN y.id IS NOT NULL THEN 'party' END AS by
FROM m LEFT JOIN x USING (name) LEFT JOIN y ON y.l_orderkey = m.l_orderkey AND y.name = m.name
""",
)
def party_names(spark, d):
    """Names by exact match, or by base name among the party's own members."""
    number = lambda p, c, n: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    lines = table(spark, d, "lineitem")
    masters = table(spark, d, "supplier").select("s_suppkey", number("n", "s_suppkey", 50).alias("name"), number("b", "s_suppkey", 20).alias("base"))
    mentions = lines.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, number("n", "l_partkey", 70)).otherwise(number("b", "l_partkey", 25)).alias("name"))
    party = lines.select("l_orderkey", F.col("l_suppkey").alias("s_suppkey"))
    return M.party_lookup(mentions, masters, party, ["l_orderkey", "l_linenumber"], "name", "s_suppkey", "base")


@query(
    "party_members",
    """
WITH o AS (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0), w AS (SELECT s_suppkey, min(t) AS t FROM (SELECT s_suppkey, (s_suppkey * 7) % 30 AS t FROM supplier WHERE s_suppkey % 2 = 0) WHERE t IN (SELECT s_suppkey FROM o) GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey ELSE coalesce(w.t, l_suppkey) END AS used, coalesce(m.s_name, 'unknown ' || l_suppkey) AS name
FROM lineitem LEFT JOIN w ON w.s_suppkey = l_suppkey LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 4 <> 0) m ON m.s_suppkey = l_suppkey
""",
)
def party_members(spark, d):
    """Members with names, a fallback for unknown ones, and substitutes for those that aren't owned."""
    suppliers = table(spark, d, "supplier")
    members = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    known = suppliers.filter("s_suppkey % 4 <> 0").withColumnRenamed("s_suppkey", "l_suppkey")
    named = M.with_fallback(members, known, "l_suppkey", "s_name", F.concat(F.lit("unknown "), F.col("l_suppkey").cast("string")))
    owned = suppliers.filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    swaps = suppliers.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("l_suppkey"), ((F.col("s_suppkey") * 7) % 30).alias("to"))
    return M.substituted(named, owned, swaps, "l_suppkey", "to").select("l_orderkey", "l_linenumber", "l_suppkey", "used", "name")


@query(
    "season_matches",
    """
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 20 END AS number, o_orderdate::DATE AS starts, o_orderdate::DATE + 20 AS ends, left(o_orderpriority, 1) AS name FROM orders),
s AS (SELECT i AS season, CASE WHEN i % 2 = 0 THEN i END AS number, DATE '1995-01-10' + 30 * i::INT AS s_starts, DATE '1995-01-10' + 30 * i::INT + 40 AS s_ends, (1 + i % 5)::VARCHAR AS s_name FROM range(60) t(i))
SELECT r.o_orderkey, coalesce(n.season, (SELECT arg_min(season, (CASE WHEN r.name = s_name THEN 0 ELSE 1 END, s_starts, season)) FROM s WHERE s_starts <= r.ends AND s_ends >= r.starts)) AS season
FROM r LEFT JOIN s n ON n.number = r.number
""",
)
def season_matches(spark, d):
    """Rows with the season of their number, or the first overlapping one, the same name first."""
    rows = table(spark, d, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 20 END").alias("number"), F.to_date("o_orderdate").alias("starts"), F.date_add(F.to_date("o_orderdate"), 20).alias("ends"), F.left("o_orderpriority", F.lit(1)).alias("name"))
    first = F.expr("date_add(date'1995-01-10', cast(30 * id as int))")
    seasons = spark.range(60).select(F.col("id").alias("season"), F.expr("CASE WHEN id % 2 = 0 THEN id END").alias("number"), first.alias("starts"), F.date_add(first, 40).alias("ends"), (1 + F.col("id") % 5).cast("string").alias("name"))
    return L.season_match(rows, seasons, "o_orderkey")


@query(
    "popular_order",
    """
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS popular,
       row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_size % 3 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END, CASE WHEN p_size % 3 = 0 THEN -p_retailprice ELSE p_retailprice END, p_partkey) AS by_status,
       row_number() OVER (PARTITION BY p_brand ORDER BY lower(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END), p_partkey) AS by_name
FROM part
""",
)
def popular_order(spark, d):
    """Ranks within a brand: by rate and views, by status with ended ones newest first, and by name whatever its case."""
    status = F.col("p_size") % 3
    parts = table(spark, d, "part").select(
        "p_partkey",
        "p_brand",
        "p_size",
        "p_retailprice",
        F.when(status == 1, 0).when(status == 2, 1).otherwise(2).alias("status"),
        F.when(status == 0, -F.col("p_retailprice")).otherwise(F.col("p_retailprice")).alias("by_price"),
        F.lower("p_name").alias("low"),
    )
    last = ("p_partkey", False)
    placed = positions(parts, ["p_brand"], [("p_size", True), ("p_retailprice", True), last], "popular")
    placed = positions(placed, ["p_brand"], [("status", False), ("by_price", False), last], "by_status")
    return positions(placed, ["p_brand"], [("low", False), last], "by_name").select("p_partkey", "popular", "by_status", "by_name")


@query(
    "names_collated",
    """
WITH n AS (SELECT p_partkey, p_size, CASE p_partkey % 7 WHEN 0 THEN '가' WHEN 1 THEN 'É' WHEN 2 THEN 'e' WHEN 3 THEN 'Z' WHEN 4 THEN 'ä' WHEN 5 THEN '나' ELSE 'z' END || p_name AS name FROM part)
SELECT p_partkey, name, rank() OVER (PARTITION BY p_size ORDER BY name COLLATE ko) AS place FROM n
""",
)
def names_collated(spark, d):
    """Names in a Korean reader's order: Hangul first, accents beside their letters, whatever their case."""
    name = F.concat(F.expr("case p_partkey % 7 when 0 then '가' when 1 then 'É' when 2 then 'e' when 3 then 'Z' when 4 then 'ä' when 5 then '나' else 'z' end"), "p_name")
    place = F.rank().over(W.partitionBy("p_size").orderBy(F.collate("name", "ko")))
    return table(spark, d, "part").select("p_partkey", "p_size", name.alias("name")).select("p_partkey", "name", place.cast("long").alias("place"))


@query(
    "mine_first",
    """
WITH r AS (SELECT user_id, event_id, event_type = 'purchase' AS mine, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY mine DESC, nth) AS place FROM r WHERE nth <= 60
""",
)
def mine_first(spark, d):
    """The sixty most recent of each key (the cut is the feature), own ones first."""
    recent = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    rows = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("mine"), recent.alias("nth")).filter("nth <= 60")
    return rows.select("user_id", "event_id", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("mine"), "nth")).alias("place"))


@query(
    "long_bodies",
    "SELECT doc_id, nth FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'en' THEN 0 ELSE 1 END, doc_id) AS nth FROM documents WHERE length(text) > 80) WHERE nth <= 5",
)
def long_bodies(spark, d):
    """Bodies over a least length, the first five of each source by priority (the cut is the feature)."""
    nth = F.row_number().over(W.partitionBy("source").orderBy(F.when(F.col("lang") == "en", 0).otherwise(1), "doc_id"))
    return table(spark, d, "documents").filter(F.length("text") > 80).select("doc_id", nth.alias("nth")).filter("nth <= 5")


@query(
    "search_hits",
    """
WITH t AS (SELECT user_id, ts, CASE event_type WHEN 'view' THEN 'Use gift' || (user_id % 9) || ' now' WHEN 'click' THEN 'GIFT' || (user_id % 9) || ' is expired' ELSE 'other' END AS title, 'gift' || (user_id % 9) AS code FROM events)
SELECT user_id, count(*) > 0 AS found, max(ts)::DATE AS recent, bool_or(contains(lower(title), 'expired')) AS expired_hint FROM t WHERE contains(lower(title), code) GROUP BY 1
""",
)
def search_hits(spark, d):
    """Of the titles that have a code: the latest date, and whether any hints that it expired."""
    title = F.expr("CASE event_type WHEN 'view' THEN 'Use gift' || (user_id % 9) || ' now' WHEN 'click' THEN 'GIFT' || (user_id % 9) || ' is expired' ELSE 'other' END")
    rows = table(spark, d, "events").select("user_id", "ts", F.lower(title).alias("title"), F.expr("'gift' || (user_id % 9)").alias("code"))
    hits = rows.filter(F.contains("title", F.col("code"))).groupBy("user_id")
    return hits.agg((F.count("*") > 0).alias("found"), F.to_date(F.max("ts")).alias("recent"), F.bool_or(F.contains("title", F.lit("expired"))).alias("expired_hint"))


@query(
    "codes_with_rewards",
    """
WITH t AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'gift' ELSE 'Gift' END || (event_id % 300) AS code, CASE WHEN event_id % 3 = 0 THEN 'r' || event_id END AS rewards FROM events)
SELECT upper(code) AS key, arg_min(code, (rewards IS NULL, event_id)) AS code, arg_min(event_id, (rewards IS NULL, event_id)) AS event_id FROM t GROUP BY 1
""",
)
def codes_with_rewards(spark, d):
    """One row for each code in upper case, the first with rewards, or else the first."""
    rows = table(spark, d, "events").select("event_id", F.expr("CASE WHEN event_id % 2 = 0 THEN 'gift' ELSE 'Gift' END || (event_id % 300)").alias("code"), F.expr("CASE WHEN event_id % 3 = 0 THEN 'r' || event_id END").alias("rewards"))
    best = F.min(F.struct(F.col("rewards").isNull().alias("without"), "event_id", "code")).alias("b")
    return rows.groupBy(F.upper("code").alias("key")).agg(best).select("key", "b.code", "b.event_id")


def _of_family(number: int):
    return lambda k: F.struct(k.alias("k"), F.lit(number).alias("family"))


@query(
    "pattern_families",
    r"""
WITH f AS (SELECT page_id, 1 AS p, unnest(regexp_extract_all(html, 'href="/([^"/]+)', 1)) AS k FROM pages UNION ALL SELECT page_id, 2, unnest(regexp_extract_all(html, 'href="([^"/:]+)"', 1)) FROM pages
 UNION ALL SELECT page_id, 3, unnest(regexp_extract_all(html, '<(h[1-3]|table|ul)\b', 1)) FROM pages)
SELECT page_id, k, min(p) AS family FROM f GROUP BY 1, 2
""",
)
def pattern_families(spark, d):
    """Keys that three families of patterns find in pages; the first family that has a key wins."""
    families = [r'href="/([^"/]+)', r'href="([^"/:]+)"', r"<(h[1-3]|table|ul)\b"]
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("html", F.lit(p), 1), _of_family(i + 1)) for i, p in enumerate(families)]))
    rows = table(spark, d, "pages").select("page_id", F.explode(found).alias("f"))
    return rows.groupBy("page_id", F.col("f.k").alias("k")).agg(F.min("f.family").alias("family"))


_DUP_OLD = "SELECT p_partkey AS id, p_size AS day, string_split(p_name, ' ') AS toks, CASE WHEN p_partkey % 4 <> 0 THEN 'old' || p_partkey END AS link FROM part WHERE p_partkey % 10 = 0"
_DUP_NEW = "SELECT p_partkey AS id, p_size AS day, string_split(p_name, ' ') AS toks, 'new' || p_partkey AS link FROM part WHERE p_partkey % 10 = 3"


@query(
    "attached_duplicates",
    f"""
WITH o AS ({_DUP_OLD}), n AS ({_DUP_NEW}),
p AS (SELECT n.id AS new_id, min(o.id) AS id, any_value(n.link) AS link FROM o JOIN n ON o.day = n.day AND len(list_intersect(o.toks, n.toks)) > 0 GROUP BY 1),
b AS (SELECT id, arg_min(link, new_id) AS link FROM p GROUP BY 1)
SELECT o.id, 'old' AS side, coalesce(o.link, b.link, '') AS link FROM o LEFT JOIN b USING (id) UNION ALL SELECT n.id, 'new', n.link FROM n WHERE n.id NOT IN (SELECT new_id FROM p)
""",
)
def attached_duplicates(spark, d):
    """Duplicates of another source fill empty links; new rows that duplicate nothing stay."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("day"), F.split("p_name", " ").alias("toks"))
    one = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    old = part.filter("id % 10 = 0").withColumn("link", one(F.expr("CASE WHEN id % 4 <> 0 THEN 'old' || id END")))
    new = part.filter("id % 10 = 3").withColumn("link", one(F.expr("'new' || id")))
    kept, fresh = I.attach_duplicates(old, new, ["day"], "id", "toks", "link")
    shown = lambda df, side: df.select("id", F.lit(side).alias("side"), F.array_join("link", ",").alias("link"))
    return shown(kept, "old").union(shown(fresh, "new"))


@query(
    "owned_fields",
    """
SELECT event_id, CASE WHEN event_id % 5 > 0 AND event_id % 3 = 1 THEN CASE WHEN event_id % 2 = 0 THEN 'new' END WHEN event_id % 3 = 0 THEN coalesce(CASE WHEN event_id % 4 = 0 THEN 'old' END, CASE WHEN event_id % 2 = 0 THEN 'new' END) ELSE CASE WHEN event_id % 4 = 0 THEN 'old' END END AS field,
       user_id % 2 <> 0 AND user_id % 3 <> 0 AND user_id % 2 <> user_id % 3 AS conflict
FROM events
""",
)
def owned_fields(spark, d):
    """Fields that only their owner overwrites or clears; works that are both known and differ."""
    e = table(spark, d, "events")
    owner = F.expr("CASE event_id % 3 WHEN 1 THEN 'site' WHEN 2 THEN 'fan' END")
    field = I.owned_overwrite(F.expr("CASE WHEN event_id % 4 = 0 THEN 'old' END"), F.expr("CASE WHEN event_id % 2 = 0 THEN 'new' END"), owner, F.lit("site"), F.col("event_id") % 5 > 0)
    some = lambda n: F.when(F.col("user_id") % n != 0, F.col("user_id") % n)
    return e.select("event_id", field.alias("field"), R.conflicts(some(2), some(3)).alias("conflict"))


@query(
    "untold_rows",
    "SELECT event_id FROM events e WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events t WHERE t.event_type = 'signup' AND t.user_id = e.user_id AND t.event_id % 7 = e.event_id % 7)",
)
def untold_rows(spark, d):
    """Rows of keys that no notice has gone out for."""
    e = table(spark, d, "events").withColumn("slot", F.col("event_id") % 7)
    return I.not_yet_told(e.filter("event_type = 'purchase'"), e.filter("event_type = 'signup'"), ["user_id", "slot"]).select("event_id")


@query(
    "listed_groups",
    "SELECT p_partkey FROM part p WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size < 2) OR EXISTS (SELECT 1 FROM part a WHERE a.p_size < 2 AND a.p_brand = p.p_brand AND a.p_name = p.p_name)",
)
def listed_groups(spark, d):
    """Rows that didn't arrive are deleted, but only in groups of which something arrived."""
    part = table(spark, d, "part")
    arrived = part.filter("p_size < 2").select("p_brand", "p_name")
    return I.delete_missing_of_seen(part.select("p_partkey", "p_brand", "p_name"), arrived, "p_brand", ["p_brand", "p_name"]).select("p_partkey")


@query(
    "manual_merges",
    """
WITH w AS (SELECT event_id % 90 AS g, (event_id * 13) % 2300 AS id FROM events WHERE event_type = 'signup' AND event_id < 900)
SELECT g, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (p_partkey IS NULL), '') AS missing, count(DISTINCT p_brand) > 1 AS mixed_works, min(p_partkey) AS into FROM w LEFT JOIN part ON p_partkey = id GROUP BY 1
""",
)
def manual_merges(spark, d):
    """Merges that a person asks for: ids that exist not, works that differ, and the id to merge into. The orders are the
    first nine hundred events' sign-ups (a person's list is short)."""
    wanted = table(spark, d, "events").filter("event_type = 'signup' and event_id < 900").select((F.col("event_id") % 90).alias("g"), ((F.col("event_id") * 13) % 2300).alias("p_partkey"))
    merged = M.checked_merge(table(spark, d, "part"), wanted, "p_partkey", "g", "p_brand")
    return merged.select("g", F.array_join(F.transform("missing", lambda m: m.cast("string")), ",").alias("missing"), "mixed_works", "into")


@query(
    "roster_export",
    """SELECT n_nationkey, '{"version":3,"entries":[' || string_agg('{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}', ',' ORDER BY s_suppkey) || ']}' AS document FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""",
)
def roster_export(spark, d):
    """A versioned JSON document for each key."""
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", "s_name")
    return sinks.versioned_export(rows, ["n_nationkey"], 3)


@query(
    "feed_items",
    "SELECT event_id, i, 'News ' || i || ' & more' AS title, 'https://x.example/' || event_id || '/' || i AS link, 'Mon, 0' || (1 + event_id % 9) || ' Jan 2024' AS published FROM events, range(2) t(i)",
)
def feed_items(spark, d):
    """Items of feeds, with CDATA or without, one row each."""
    item = lambda i, open_, close: f"'<item><title>{open_}News {i} & more{close}</title><link> https://x.example/', event_id, '/{i}</link><pubDate>Mon, 0', 1 + event_id % 9, ' Jan 2024</pubDate></item>'"
    body = F.expr(f"concat('<rss><channel>', {item(0, '<![CDATA[', ']]>')}, {item(1, '', '')}, '</channel></rss>')")
    items = readers.feed_items(table(spark, d, "events").select("event_id", body.alias("body")), "body")
    return items.select("event_id", F.regexp_extract("title", r"News (\d)", 1).cast("long").alias("i"), "title", "link", "published")


@query(
    "embedded_data",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END::BIGINT AS n, CASE WHEN event_id % 3 <> 0 THEN event_type END AS name, CASE WHEN event_id % 4 <> 0 THEN 'v' || event_id END AS video FROM events",
)
def embedded_data(spark, d):
    """JSON-LD objects of a type in pages, and a field of a page's state wherever it lies."""
    kind = F.expr("CASE WHEN event_id % 3 = 0 THEN 'Thing' ELSE 'Event' END")
    page = F.concat(F.lit('<script type="application/ld+json">{"@type":"'), kind, F.lit('","name":"'), F.col("event_type"), F.lit('"}</script>'))
    state = F.expr("""CASE event_id % 4 WHEN 0 THEN '{"a":[]}' WHEN 1 THEN '{"a":[{"videoId":"v' || event_id || '"}]}' WHEN 2 THEN '[[{"b":{"videoId": "v' || event_id || '"}}]]' ELSE '{"videoId":"v' || event_id || '","x":1}' END""")
    found = readers.json_ld(page, "Event")
    return table(spark, d, "events").select(
        "event_id",
        F.size(found).cast("long").alias("n"),
        F.try_variant_get(F.get(found, F.lit(0)), "$.name", "string").alias("name"),
        F.get(readers.state_values(state, "videoId"), F.lit(0)).alias("video"),
    )


@query(
    "page_blocks",
    "SELECT event_id, 'Card ' || event_id || ' at hall ' || (event_id % 4) AS text, 'Card ' || event_id AS title, 'hall ' || (event_id % 4) AS place, 'a' || event_id || '|' || event_type AS lines FROM events",
)
def page_blocks(spark, d):
    """Visible text of rich documents, cards of lists, and tab-separated blocks."""
    rich = F.expr("""'{"type":"doc","content":[{"type":"p","content":[{"type":"text","text":"Card ' || event_id || '"},{"type":"text","text":" at hall ' || (event_id % 4) || '"}]}]}'""")
    cards = F.expr("""'<ul><li class="card x"><a href="/1"><b>Card ' || event_id || '</b></a><span class=''p''> hall ' || (event_id % 4) || '</span></li><li class="ad">no</li></ul>'""")
    block = F.expr("'head\\n' || 'a' || event_id || '\\t' || event_type || '\\nshort'")
    card = F.get(readers.elements(cards, "li", "card"), F.lit(0))
    return table(spark, d, "events").select(
        "event_id",
        readers.rich_text(rich).alias("text"),
        F.get(readers.element_texts(card, "b"), F.lit(0)).alias("title"),
        F.get(readers.element_texts(card, "span", "p"), F.lit(0)).alias("place"),
        F.array_join(F.transform(readers.tab_blocks(block, ["a", "b"]), lambda s: F.concat_ws("|", s["a"], s["b"])), ",").alias("lines"),
    )


@query(
    "table_rows",
    "SELECT event_id, 'GIFT' || event_id AS code, event_type AS reward FROM events",
)
def table_rows(spark, d):
    """Rows of HTML tables whose header names the roles."""
    html = F.expr("'<table><tr><td>intro</td></tr><tr><th>Redeem Code</th><th>x</th><th>Rewards</th></tr><tr><td>GIFT' || event_id || '</td><td>-</td><td> ' || event_type || ' </td></tr></table>'")
    rows = readers.table_rows(table(spark, d, "events").select("event_id", html.alias("html")), "html", {"code": ["code"], "reward": ["reward"]})
    return rows.select("event_id", F.col("row")["code"].alias("code"), F.col("row")["reward"].alias("reward"))


@query(
    "published_versions",
    """
SELECT 1 AS version, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part
UNION ALL SELECT 2, count(*), round(sum(p_retailprice * 2), 2) FROM part WHERE p_size > 10
""",
)
def published_versions(spark, d):
    """A table published twice; both versions are read after the second one."""
    parts = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    versions = Versions(spark, fresh_folder(spark, "versions"))
    first = versions.publish(parts)
    second = versions.publish(versions.read(first).filter("p_size > 10").withColumn("p_retailprice", F.col("p_retailprice") * 2), based_on=first)
    of = lambda v: versions.read(v).agg(F.lit(v).alias("version"), F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))
    return of(first).union(of(second))


@query(
    "source_chain",
    "SELECT s_suppkey AS id, 'main' AS source, 1 AS priority FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'fans', 2 FROM supplier WHERE s_suppkey % 3 = 0",
)
def source_chain(spark, d):
    """The first source that has rows, united with another under their priorities; an empty one is passed over."""
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    main = readers.first_that_reads([lambda: suppliers.filter("id < 0"), lambda: suppliers.filter("id % 2 = 0")])
    return readers.union_sources({"main": main, "fans": suppliers.filter("id % 3 = 0")}, {"main": 1, "fans": 2})


@query(
    "sources_by_spec",
    """
WITH a AS (SELECT s_suppkey AS id, 'main' AS source, 1 AS priority FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT s_suppkey, 'fans', 3 FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT c_custkey, 'buyers', 5 FROM customer WHERE c_acctbal < 0)
SELECT id, source, priority FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY priority) = 1
""",
)
def sources_by_spec(spark, d):
    """What each source has by the best of them: one fails while it is read, one is empty, one has no driver."""
    suppliers, customers = table(spark, d, "supplier"), table(spark, d, "customer")
    registry = {
        "suppliers": lambda every, broken=False: suppliers.filter(F.col("s_suppkey") % every == 0).select((F.raise_error(F.lit("down")).cast("long") if broken else F.col("s_suppkey")).alias("id")),
        "customers": lambda below: customers.filter(F.col("c_acctbal") < below).select(F.col("c_custkey").alias("id")),
    }
    specs = [
        {"driver": "suppliers", "source": "fans", "every": 3},
        {"driver": "nobody", "source": "gone"},
        {"driver": "suppliers", "source": "main", "main": True, "every": 4},
        {"driver": "customers", "source": "buyers", "below": 0},
        {"driver": "suppliers", "source": "down", "main": True, "every": 2, "broken": True},
    ]
    rows, _ = readers.run_sources(registry, specs)
    return O.top_per(rows, ["id"], [F.asc("priority")], 1).select("id", "source", "priority")
