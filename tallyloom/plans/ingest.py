"""Snapshot and batch queries: old rows and new rows are split from one table by date."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import ingest as I
from tallyloom.plans.base import query
from tallyloom.sources.tables import table

_OLD = "SELECT p_partkey AS k, CASE WHEN p_size % 4 <> 0 THEN p_brand END AS maker, p_size AS size, p_retailprice::DECIMAL(12,2)::DOUBLE AS price FROM part WHERE p_partkey % 5 <> 0"
_NEW = "SELECT p_partkey AS k, 'new' AS maker, CASE WHEN p_size % 3 <> 0 THEN p_size + 1 END AS size, p_retailprice::DECIMAL(12,2)::DOUBLE + 1 AS price FROM part WHERE p_partkey % 3 = 0"


def _split(spark, d):
    part = table(spark, d, "part")
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("double")
    old = part.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).alias("maker"), F.col("p_size").alias("size"), price.alias("price"))
    new = part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("k"), F.lit("new").alias("maker"), F.when(F.col("p_size") % 3 != 0, F.col("p_size") + 1).alias("size"), (price + 1).alias("price"))
    return old, new


@query(
    "upsert_merge",
    f"""
WITH o AS ({_OLD}), n AS ({_NEW})
SELECT coalesce(o.k, n.k) AS k, coalesce(o.maker, n.maker) AS maker, CASE WHEN n.k IS NOT NULL THEN n.size ELSE o.size END AS size, round(CASE WHEN o.k IS NULL THEN n.price ELSE o.price END, 2) AS price,
       CASE WHEN o.k IS NULL THEN 'created' WHEN n.k IS NOT NULL THEN 'updated' ELSE 'kept' END AS action
FROM o FULL JOIN n ON o.k = n.k WHERE o.k IS NOT NULL OR n.price < 1000
""",
)
def upsert_merge(spark, d):
    """Overwrites one column, nulls too, fills another, keeps the third; new rows only under a condition."""
    old, new = _split(spark, d)
    merged = I.upsert(old, new, ["k"], overwrite=("size",), fill=("maker",), insert_if=F.col("price") < 1000)
    return merged.withColumn("price", F.round("price", 2))


@query("run_statistics", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT CASE WHEN o.k IS NULL THEN 'created' WHEN n.k IS NOT NULL THEN 'updated' ELSE 'kept' END AS action, count(*) AS n FROM o FULL JOIN n ON o.k = n.k GROUP BY 1")
def run_statistics(spark, d):
    """How many rows a batch creates, updates and keeps."""
    old, new = _split(spark, d)
    return I.upsert(old, new, ["k"], overwrite=("size",)).groupBy("action").agg(F.count("*").alias("n"))


@query("insert_absent", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT k, maker FROM o UNION ALL SELECT k, maker FROM n WHERE k NOT IN (SELECT k FROM o)")
def insert_absent(spark, d):
    """Only new keys are added."""
    old, new = _split(spark, d)
    return I.insert_absent(old, new, ["k"]).select("k", "maker")


@query(
    "corroboration",
    """
SELECT user_id AS code, count(DISTINCT event_type) AS corroboration, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources,
       max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 1 AS confirmed
FROM events GROUP BY 1
""",
)
def corroboration(spark, d):
    """Distinct sources that saw each code, and whether one confirms it."""
    seen = table(spark, d, "events").withColumnRenamed("user_id", "code")
    rows = I.corroborated(seen, ["code"], "event_type")
    return rows.select("code", F.col("corroboration").cast("long"), F.array_join("sources", ",").alias("sources"), F.array_contains("sources", "purchase").alias("confirmed"))


@query(
    "status_lattice",
    """
WITH a AS (SELECT user_id, arg_min(event_type, event_id) AS o, arg_max(event_type, event_id) AS n FROM events GROUP BY 1)
SELECT user_id, CASE WHEN n = 'purchase' THEN n ELSE o END AS status, CASE WHEN (CASE n WHEN 'signup' THEN 2 WHEN 'view' THEN 1 ELSE 0 END) > (CASE o WHEN 'signup' THEN 2 WHEN 'view' THEN 1 ELSE 0 END) THEN n ELSE o END AS source FROM a
""",
)
def status_lattice(spark, d):
    """Old and new state of each key merged: confirmation overrides, sources go by rank."""
    a = table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("o"), F.max_by("event_type", "event_id").alias("n"))
    o, n = F.col("o"), F.col("n")
    return a.select("user_id", I.merged_status(o, n, "purchase").alias("status"), I.merged_source(o, n, {"signup": 2, "view": 1}).alias("source"))


@query(
    "expire_prune",
    """
WITH c AS (SELECT event_id, ts, CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 3 DAY END AS expires, event_type AS status FROM events)
SELECT event_id, CASE WHEN expires <= TIMESTAMP '2024-01-20' THEN 'expired' ELSE status END AS status FROM c WHERE coalesce(expires, ts)::DATE >= DATE '2024-01-13'
""",
)
def expire_prune(spark, d):
    """Past-due rows are expired, and dropped a week later."""
    expires = F.when(F.col("event_id") % 3 != 0, F.expr("ts + interval 3 days"))
    rows = table(spark, d, "events").select("event_id", "ts", expires.alias("expires"), F.col("event_type").alias("status"))
    return I.expire_and_prune(rows, "expires", "ts", F.lit("2024-01-20").cast("timestamp_ntz"), 7).select("event_id", "status")


@query(
    "mark_unseen",
    "SELECT l_suppkey, count(*) FILTER (l_returnflag <> 'R' AND NOT (l_suppkey % 2 = 0 AND l_shipdate < TIMESTAMP '1999-01-01')) AS available, count(*) AS offers FROM lineitem GROUP BY 1",
)
def mark_unseen(spark, d):
    """Offers that a crawled shop no longer lists become unavailable."""
    offers = table(spark, d, "lineitem").withColumn("available", F.col("l_returnflag") != "R")
    crawled = table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    marked = I.mark_unseen(offers, "l_shipdate", F.lit("1999-01-01").cast("timestamp_ntz"), "l_suppkey", crawled)
    return marked.groupBy("l_suppkey").agg(F.count_if("available").alias("available"), F.count("*").alias("offers"))


@query(
    "guarded_deactivate",
    """
WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-06-01'),
g AS (SELECT (SELECT count(*) FROM a) > 0 AND (SELECT count(*) FROM a) >= 0.5 * (SELECT count(*) FROM part WHERE p_size > 5) AS ok)
SELECT p_partkey, p_size > 5 AND (p_partkey IN (SELECT l_partkey FROM a) OR NOT g.ok) AS active FROM part, g
""",
)
def guarded_deactivate(spark, d):
    """Missing keys are deactivated, unless too few arrived."""
    old = table(spark, d, "part").select("p_partkey", (F.col("p_size") > 5).alias("active"))
    arrived = table(spark, d, "lineitem").filter("l_shipdate >= timestamp'2000-06-01'").select(F.col("l_partkey").alias("p_partkey"))
    return I.deactivate_missing(old, arrived, "p_partkey").select("p_partkey", "active")


@query(
    "replace_own_source",
    """
WITH old AS (SELECT p_partkey, p_brand, CASE p_size % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'wiki' ELSE 'forum' END AS source FROM part),
new AS (SELECT p_partkey, p_brand, 'wiki' AS source FROM part WHERE p_size > 20)
SELECT * FROM old WHERE source <> 'wiki' UNION ALL SELECT * FROM new WHERE p_partkey NOT IN (SELECT p_partkey FROM old WHERE source = 'manual')
""",
)
def replace_own_source(spark, d):
    """A source replaces its own rows; manual rows stay and win."""
    part = table(spark, d, "part")
    source = F.when(F.col("p_size") % 3 == 0, "manual").when(F.col("p_size") % 3 == 1, "wiki").otherwise("forum")
    old = part.select("p_partkey", "p_brand", source.alias("source"))
    return I.replace_own(old, part.filter("p_size > 20").select("p_partkey", "p_brand", F.lit("wiki").alias("source")), "source", "wiki", ["p_partkey"])


@query(
    "signal_fold",
    """
WITH e AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE END AS d FROM orders),
s AS (SELECT l_orderkey AS k, l_linenumber AS seq, min(date_trunc('month', l_shipdate)::DATE) AS day FROM lineitem GROUP BY ALL),
f AS (SELECT e.k, coalesce(e.d, arg_min(s.day, s.seq)) AS date, e.d IS NULL AND count(s.k) > 0 AS filled FROM e LEFT JOIN s USING (k) GROUP BY e.k, e.d)
SELECT f.k AS o_orderkey, f.date, (f.filled)::INT AS filled, (count(*) FILTER (s.day = f.date) - f.filled::INT)::INT AS confirmed, (count(*) FILTER (s.day <> f.date))::INT AS mismatched
FROM f LEFT JOIN s USING (k) GROUP BY f.k, f.date, f.filled
""",
)
def signal_fold(spark, d):
    """Signals fill a missing date, then confirm it or not, in order."""
    events = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.to_date("o_orderdate")).alias("date"))
    month = F.to_date(F.date_trunc("month", "l_shipdate"))
    signals = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("seq")).agg(F.min(month).alias("date"))
    return I.fold_signals(events, signals, "o_orderkey")


@query(
    "retention",
    "SELECT event_type, count(*) AS kept FROM events WHERE ts::DATE >= DATE '2024-01-30' - 14 GROUP BY 1",
)
def retention(spark, d):
    """Rows of the last fourteen days before a date."""
    kept = table(spark, d, "events").filter(F.to_date("ts") >= F.date_sub(F.lit("2024-01-30").cast("date"), 14))
    return kept.groupBy("event_type").agg(F.count("*").alias("kept"))


@query(
    "topic_merge",
    """
WITH s AS (SELECT user_id, event_id % 20 AS slot, event_id % 2 = 0 AS before, bool_or(event_type = 'error') AS every, list_sort(list_distinct(list(event_type))) AS topics FROM events WHERE event_id % 7 <> user_id % 3 GROUP BY ALL),
o AS (SELECT * FROM s WHERE before), n AS (SELECT * FROM s WHERE NOT before)
SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.slot, o.slot) AS slot,
       CASE WHEN coalesce(o.every, false) OR coalesce(n.every, false) THEN NULL ELSE array_to_string(list_sort(list_distinct(list_concat(coalesce(o.topics, []), coalesce(n.topics, [])))), ',') END AS topics
FROM o FULL JOIN n ON n.user_id = o.user_id AND n.slot = o.slot + 1
""",
)
def topic_merge(spark, d):
    """Subscriptions as they were and new requests: all topics stay all, asking for all is granted, else the union."""
    events = table(spark, d, "events").filter("event_id % 7 <> user_id % 3")
    groups = events.groupBy("user_id", (F.col("event_id") % 20).alias("slot"), (F.col("event_id") % 2 == 0).alias("before"))
    sets = groups.agg(F.bool_or(F.col("event_type") == "error").alias("every"), F.array_sort(F.collect_set("event_type")).alias("t"))
    sets = sets.withColumn("topics", F.when(~F.col("every"), F.col("t"))).drop("t", "every")
    old = sets.filter("before").select("user_id", (F.col("slot") + 1).alias("slot"), "topics")
    new = sets.filter("not before").select("user_id", "slot", "topics")
    merged = I.merge_subscriptions(old, new, ["user_id", "slot"], "topics")
    only_old = F.col("slot") - F.when(F.col("asked_"), 0).otherwise(1)
    return merged.select("user_id", only_old.alias("slot"), F.array_join("topics", ",").alias("topics"))
