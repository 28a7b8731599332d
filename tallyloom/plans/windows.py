"""Leaderboards, runs, histories and other window queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators import windows as O
from tallyloom.operators.lanes import week_lanes
from tallyloom.operators.ranks import positions, ranks
from tallyloom.plans.base import query
from tallyloom.sources.tables import table


@query("leaderboard_rank", "SELECT o_orderkey, o_orderpriority, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC)::BIGINT AS place FROM orders")
def leaderboard_rank(spark, d):
    """Competition rank: one more than the number of strictly higher scores."""
    scores = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ranks(scores, ["o_orderpriority"], [("o_totalprice", True)], "place").select("o_orderkey", "o_orderpriority", "place")


@query(
    "global_rank",
    "SELECT l_orderkey, l_linenumber, l_partkey, rank() OVER (ORDER BY l_quantity DESC) AS place, row_number() OVER (ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS position FROM lineitem",
)
def global_rank(spark, d):
    """Rank and position of every row in the whole table, by a score that has many ties."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    order = [("l_quantity", True), *[(c, False) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]]
    return positions(ranks(lines, [], [("l_quantity", True)], "place"), [], order).select("l_orderkey", "l_linenumber", "l_partkey", "place", "position")


@query(
    "page_by_position",
    "SELECT o_orderkey, position, position // 500 AS page FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position FROM orders)",
)
def page_by_position(spark, d):
    """The page of every row of an ordered result, at 500 rows a page."""
    placed = positions(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [], [("o_totalprice", True), ("o_orderkey", False)])
    return placed.select("o_orderkey", (F.col("position") - 1).alias("position"), F.expr("(position - 1) div 500").alias("page"))


@query(
    "leaderboard_topn",
    "SELECT o_orderpriority, o_orderkey, round(o_totalprice, 2) AS score, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)::BIGINT AS position FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 10",
)
def leaderboard_topn(spark, d):
    """The ten best of every game; ties go to the earlier id."""
    top = O.top_per(table(spark, d, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)
    return top.select("o_orderpriority", "o_orderkey", F.round("o_totalprice", 2).alias("score"), F.col("position").cast("long"))


@query(
    "cap_per_key",
    "SELECT p_brand, p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) - 1)::BIGINT AS sort FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 4",
)
def cap_per_key(spark, d):
    """At most four substitutes for each character, numbered from 0."""
    kept = O.top_per(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 4)
    return kept.select("p_brand", "p_partkey", (F.col("position") - 1).cast("long").alias("sort"))


@query(
    "consecutive_runs",
    """
WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events),
g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS island FROM d)
SELECT user_id, min(day) AS run_start, max(day) AS run_end, count(*) AS days FROM g GROUP BY user_id, island
""",
)
def consecutive_runs(spark, d):
    """Runs of consecutive active days of every user."""
    days = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"))
    return O.date_runs(days, ["user_id"], "day")


@query(
    "last_n_turns",
    "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS nth FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)",
)
def last_n_turns(spark, d):
    """The last three turns of every conversation in ascending order."""
    return O.last_n(table(spark, d, "conversations"), ["conv_id"], "turn", 3).select("conv_id", "turn", "role", F.col("nth").cast("long"))


@query("after_pointer", "SELECT conv_id, turn FROM (SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE turn > 0 AND nxt IS NOT NULL")
def after_pointer(spark, d):
    """Turns past the pointer without the last."""
    return O.after_pointer(table(spark, d, "conversations"), ["conv_id"], "turn", F.lit(0)).select("conv_id", "turn")


@query(
    "compaction_chunk",
    """
WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_id > 1000)
SELECT user_id, event_id, nth::BIGINT AS nth FROM p WHERE n > 20 AND nth <= 20
""",
)
def compaction_chunk(spark, d):
    """The next twenty rows past the pointer of every key that has more than twenty."""
    rows = table(spark, d, "events").select("user_id", "event_id")
    return O.compaction_chunk(rows, ["user_id"], "event_id", F.lit(1000), 20).select("user_id", "event_id", F.col("nth").cast("long"))


@query(
    "restock_transitions",
    """
WITH s AS (SELECT l_partkey, l_suppkey, l_shipdate, max((l_returnflag <> 'R')::INT) = 1 AS available FROM lineitem GROUP BY ALL),
b AS (SELECT *, lag(available) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate) AS was FROM s)
SELECT l_partkey, l_suppkey, l_shipdate FROM b WHERE available AND NOT was
""",
)
def restock_transitions(spark, d):
    """Snapshots in which an offer is available after one in which it was not."""
    offers = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey", "l_shipdate").agg(F.bool_or(F.col("l_returnflag") != "R").alias("available"))
    return O.transitions(offers, ["l_partkey", "l_suppkey"], ["l_shipdate"], F.col("available")).select("l_partkey", "l_suppkey", "l_shipdate")


@query("first_wins", "SELECT p_name, min(p_partkey) AS p_partkey, count(*) AS listings FROM part GROUP BY 1")
def first_wins(spark, d):
    """The first listing of every name."""
    return table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"), F.count("*").alias("listings"))


_INTERVALS = "SELECT o_orderkey AS id, o_orderdate::DATE AS starts, greatest(max(l_shipdate)::DATE, o_orderdate::DATE) AS ends FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate"
_PIECES = f"""
WITH i AS ({_INTERVALS}),
w AS (SELECT id, starts, ends, unnest(generate_series(starts - dayofweek(starts)::INT, ends, INTERVAL 7 DAY))::DATE AS week FROM i)
SELECT week, id, greatest(week, starts) AS piece_start, least(week + 6, ends) AS piece_end FROM w
"""


def _intervals(spark, d):
    orders = table(spark, d, "orders")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    spans = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    starts, ends = F.to_date("o_orderdate"), F.greatest(F.to_date("shipped"), F.to_date("o_orderdate"))
    return spans.select(F.col("o_orderkey").alias("id"), starts.alias("starts"), ends.alias("ends"))


def _pieces(spark, d):
    return O.week_pieces(_intervals(spark, d), "starts", "ends").select("week", "id", "piece_start", "piece_end")


@query("week_split", _PIECES)
def week_split(spark, d):
    """Intervals cut at week ends."""
    return _pieces(spark, d)


@query("lane_packing")
def lane_packing(spark, d):
    """Lanes of the pieces of each week; the greedy choice has no SQL form."""
    several = F.col("starts") < F.col("ends")
    return week_lanes(_intervals(spark, d), O.pieces_of_weeks(F.col("starts"), F.col("ends"), several.alias("several")))


@query(
    "ordinal_labels",
    "SELECT p_brand, p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand, p_name) > 1 THEN p_name || ' #' || row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) ELSE p_name END AS label FROM part",
)
def ordinal_labels(spark, d):
    """Names with their number within the group where the group has more than one."""
    w = W.partitionBy("p_brand", "p_name")
    label = F.when(F.count("*").over(w) > 1, F.concat("p_name", F.lit(" #"), F.row_number().over(w.orderBy("p_partkey")).cast("string"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_brand", "p_partkey", label.alias("label"))


@query(
    "default_view",
    """
WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderdate <= TIMESTAMP '1998-01-01' AND o_orderdate >= TIMESTAMP '1997-06-01' AS active, o_orderdate > TIMESTAMP '1998-01-01' AS upcoming FROM orders),
w AS (SELECT *, count(*) FILTER (active) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY upcoming DESC, o_orderdate, o_orderkey) AS nth FROM s)
SELECT o_custkey, o_orderkey, active FROM w WHERE active OR (n = 0 AND nth = 1 AND upcoming)
""",
)
def default_view(spark, d):
    """All active entries of a customer, or else the single next one."""
    rows = table(spark, d, "orders").withColumn("active", F.expr("o_orderdate between timestamp'1997-06-01' and timestamp'1998-01-01'")).withColumn("upcoming", F.expr("o_orderdate > timestamp'1998-01-01'"))
    w = W.partitionBy("o_custkey")
    rows = rows.withColumn("n", F.count_if("active").over(w)).withColumn("nth", F.row_number().over(w.orderBy(F.desc("upcoming"), "o_orderdate", "o_orderkey")))
    return rows.filter("active or (n = 0 and nth = 1 and upcoming)").select("o_custkey", "o_orderkey", "active")


@query(
    "score_range",
    """
WITH f(tier, base, hp) AS (VALUES (1, 0, 100000.0), (2, 100000, 150000.0), (3, 250000, 150000.0), (4, 400000, 200000.0)),
r AS (SELECT tier, base AS low, lead(base) OVER (ORDER BY base) AS high FROM f)
SELECT tier, count(*) AS n, round(min(o_totalprice), 2) AS least FROM orders JOIN r ON o_totalprice >= low AND (high IS NULL OR o_totalprice < high) GROUP BY 1
""",
)
def score_range(spark, d):
    """Scores by tier: a tier's floor counts, the next floor doesn't, the top is open. The tiers are a fixed small table."""
    tiers = spark.createDataFrame([(1, 0), (2, 100000), (3, 250000), (4, 400000)], "tier int, low long").withColumn("high", F.expr("lead(low) OVER (ORDER BY low)"))
    price = F.col("o_totalprice")
    held = (price >= F.col("low")) & (F.col("high").isNull() | (price < F.col("high")))
    return table(spark, d, "orders").join(F.broadcast(tiers), held).groupBy("tier").agg(F.count("*").alias("n"), F.round(F.min("o_totalprice"), 2).alias("least"))


@query(
    "ranker_set_filter",
    """
WITH r AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey))) AS squad, count(*) AS members FROM lineitem GROUP BY 1),
c AS (SELECT l_orderkey, members, len(list_filter(squad, lambda s: s % 10 IN (3, 7))) AS excluded, len(list_intersect(squad, [1, 2, 3, 4, 5, 6])) AS wanted FROM r),
s AS (SELECT *, count(*) FILTER (excluded = 0 AND wanted > 0) OVER () AS clean FROM c)
SELECT l_orderkey, members, excluded::BIGINT AS excluded, CASE WHEN clean >= 3 THEN 'ranker' ELSE 'partial' END AS mode,
       excluded * 1000 - members AS sort_key
FROM s WHERE wanted > 0 AND (clean < 3 OR excluded = 0)
""",
)
def ranker_set_filter(spark, d):
    """Rankers with a wanted member and none excluded; with fewer than three such, all with a wanted one. A page takes the head by sort_key (fewest excluded, most members) and key."""
    rankers = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("squad"), F.count("*").alias("members"))
    excluded = F.size(F.filter("squad", lambda s: (s % 10).isin(3, 7))).cast("long")
    wanted = F.exists("squad", lambda s: s.isin(1, 2, 3, 4, 5, 6))
    held = rankers.withColumn("excluded", excluded).filter(wanted)
    clean = held.agg(F.sum(F.when(F.col("excluded") == 0, 1).otherwise(0)).alias("clean"))
    held = held.crossJoin(F.broadcast(clean)).filter("clean < 3 or excluded = 0")
    key = (F.col("excluded") * 1000 - F.col("members")).alias("sort_key")
    return held.select("l_orderkey", "members", "excluded", F.when(F.col("clean") >= 3, "ranker").otherwise("partial").alias("mode"), key)


@query(
    "usage_join",
    "SELECT p_partkey, p_name, sum(l_quantity)::BIGINT AS used, count(*) FILTER (l_linestatus = 'F') AS assists FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL",
)
def usage_join(spark, d):
    """Summed usage of every master row that is used."""
    used = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("used"), F.count_if(F.col("l_linestatus") == "F").alias("assists"))
    return table(spark, d, "part").join(used, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_name", "used", "assists")


@query(
    "page_of_groups",
    """
WITH g AS (SELECT l_orderkey, max(l_extendedprice) AS top, dense_rank() OVER (ORDER BY max(l_extendedprice) DESC, l_orderkey) AS place, count(*) OVER () AS n FROM lineitem GROUP BY 1)
SELECT place::BIGINT AS place, l.l_orderkey, l.l_linenumber, l.l_partkey, n > 10 AS has_more FROM g JOIN lineitem l USING (l_orderkey) WHERE place BETWEEN 6 AND 10
""",
)
def page_of_groups(spark, d):
    """The second page of five groups, with their rows, and whether more groups follow."""
    lines = table(spark, d, "lineitem")
    groups = lines.groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("top"))
    n = groups.agg(F.count("*").alias("n"))
    here = groups.orderBy(F.desc("top"), "l_orderkey").offset(5).limit(5)
    here = here.withColumn("place", F.expr("row_number() OVER (ORDER BY top DESC, l_orderkey)").cast("long") + 5).crossJoin(F.broadcast(n))
    return lines.join(F.broadcast(here), "l_orderkey").select("place", "l_orderkey", "l_linenumber", "l_partkey", (F.col("n") > 10).alias("has_more"))


@query(
    "slot_states",
    """
WITH s AS (SELECT l_orderkey, bool_or(l_returnflag = 'A') AS owned, min(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN l_partkey END) AS chosen, min(CASE WHEN l_returnflag = 'N' THEN l_partkey END) AS candidate FROM lineitem GROUP BY 1)
SELECT CASE WHEN owned THEN 'owned' WHEN chosen IS NOT NULL OR candidate IS NOT NULL THEN 'substituted' ELSE 'vacant' END AS state, count(*) AS slots, sum(CASE WHEN NOT owned THEN coalesce(chosen, candidate) END)::BIGINT AS filled_sum FROM s GROUP BY 1
""",
)
def slot_states(spark, d):
    """Tally of slots that are owned, substituted (by choice, else the first candidate) or vacant."""
    lines = table(spark, d, "lineitem")
    spare = F.when(F.col("l_returnflag") == "N", F.col("l_partkey"))
    slots = lines.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("owned"), F.min(F.when(F.col("l_linestatus") == "F", spare)).alias("chosen"), F.array_sort(F.collect_set(spare)).alias("candidates"))
    return O.resolve_slots(slots).groupBy("state").agg(F.count("*").alias("slots"), F.sum("filled_by").alias("filled_sum"))
