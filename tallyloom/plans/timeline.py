"""Intervals, statuses and date rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import dates as D
from tallyloom.operators import lookup as L
from tallyloom.operators.intervals import meeting_sums, met_elsewhere
from tallyloom.plans.base import query
from tallyloom.sources.tables import table

_SPANS = "SELECT o_orderkey, o_orderpriority, o_orderstatus, o_orderdate::DATE AS starts, max(l_shipdate)::DATE AS ends FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"


def _spans(spark, d):
    ends = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("ends"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.to_date("o_orderdate").alias("starts"))
    return orders.join(ends, "o_orderkey", "left")


@query("month_overlap", f"SELECT o_orderkey, starts, ends FROM ({_SPANS}) WHERE starts <= DATE '1997-02-28' AND coalesce(ends, starts) >= DATE '1997-02-01'")
def month_overlap(spark, d):
    """Intervals that meet a month; one without an end is a point."""
    first, last = D.month_window(1997, 2)
    return L.overlapping(_spans(spark, d), "starts", "ends", first, last).select("o_orderkey", "starts", "ends")


@query(
    "covered_by_other_source",
    f"""
WITH s AS (SELECT * FROM (SELECT * REPLACE (coalesce(ends, DATE '9999-12-31') AS ends) FROM ({_SPANS})) WHERE ends >= starts)
SELECT o_orderkey FROM s a WHERE EXISTS (SELECT 1 FROM s b WHERE b.o_orderpriority = a.o_orderpriority AND b.o_orderstatus <> a.o_orderstatus AND b.starts <= a.ends AND b.ends >= a.starts)
""",
)
def covered_by_other_source(spark, d):
    """Intervals that another source's interval of the same kind overlaps; one without an end goes on."""
    return met_elsewhere(_spans(spark, d), "o_orderkey", "o_orderpriority", "o_orderstatus", "starts", "ends").select("o_orderkey")


@query(
    "raids_of_seasons",
    f"""
WITH s AS (SELECT * FROM ({_SPANS}) WHERE ends IS NULL OR ends >= starts),
c AS (SELECT c_custkey, DATE '1995-01-01' + (c_custkey * 37 % 1500)::INT AS opens, CASE WHEN c_custkey % 11 <> 0 THEN DATE '1995-01-01' + (c_custkey * 37 % 1500)::INT + (c_custkey % 5)::INT * (c_custkey % 90)::INT END AS closes FROM customer)
SELECT c_custkey, count(*) AS n, min(o_orderkey) AS first FROM c JOIN s ON s.starts <= coalesce(closes, DATE '9999-12-31') AND coalesce(s.ends, DATE '9999-12-31') >= opens AND o_orderstatus = 'P' GROUP BY 1
""",
)
def raids_of_seasons(spark, d):
    """How many intervals each season meets, long and open ones too."""
    opens = F.expr("date_add(date'1995-01-01', cast(c_custkey * 37 % 1500 as int))")
    seasons = table(spark, d, "customer").select("c_custkey", opens.alias("opens"), F.expr("case when c_custkey % 11 <> 0 then date_add(date_add(date'1995-01-01', cast(c_custkey * 37 % 1500 as int)), cast((c_custkey % 5) * (c_custkey % 90) as int)) end").alias("closes"))
    raids = _spans(spark, d).filter("o_orderstatus = 'P'").select("o_orderkey", "starts", "ends")
    sums = meeting_sums(seasons, ("opens", "closes"), raids, ("starts", "ends"), F.col("o_orderkey"))
    return sums.groupBy("c_custkey").agg(F.sum("met").alias("n"), F.min("least").alias("first"))


@query(
    "status_at",
    f"SELECT CASE WHEN starts > DATE '1998-06-01' THEN 'upcoming' WHEN ends < DATE '1998-06-01' THEN 'ended' ELSE 'active' END AS status, count(*) AS n, min(starts) AS first FROM ({_SPANS}) GROUP BY 1",
)
def status_at(spark, d):
    """Statuses at a moment; both ends belong to the interval."""
    status = D.status_at(F.col("starts"), F.col("ends"), F.lit("1998-06-01").cast("date"))
    return _spans(spark, d).groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.min("starts").alias("first"))


@query("days_left", f"SELECT o_orderkey, date_diff('day', DATE '1998-06-01', ends)::BIGINT AS left_days FROM ({_SPANS}) WHERE ends IS NOT NULL")
def days_left(spark, d):
    """Days from a moment to the end, negative when over."""
    return _spans(spark, d).filter("ends is not null").select("o_orderkey", D.days_left(F.col("ends"), F.lit("1998-06-01").cast("date")).cast("long").alias("left_days"))


@query(
    "timeline_union",
    """
SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS at FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'ship', l_orderkey, l_shipdate FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1
UNION ALL SELECT 'customer', c_custkey, NULL FROM customer WHERE c_acctbal < 0
""",
)
def timeline_union(spark, d):
    """Three kinds of rows as one timeline; rows without a date have null."""
    a = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    b = table(spark, d, "lineitem").filter("l_returnflag = 'R' and l_linenumber = 1").select(F.lit("ship").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("at"))
    c = table(spark, d, "customer").filter("c_acctbal < 0").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    return a.unionByName(b).unionByName(c, allowMissingColumns=True)


@query(
    "year_interpolation",
    """
WITH e AS (SELECT o_orderkey, o_orderdate::DATE AS posted, (1 + o_orderkey % 12)::INT AS m, (1 + o_orderkey % 28)::INT AS dd FROM orders)
SELECT o_orderkey,
       CASE WHEN make_date(year(posted), m, dd) < posted THEN make_date(year(posted) + 1, m, dd) ELSE make_date(year(posted), m, dd) END AS by_post,
       make_date(year(posted) + CASE WHEN m < month(posted) - 6 THEN 1 ELSE 0 END, m, dd) AS by_half,
       CASE WHEN make_date(year(posted), m, dd) > posted THEN make_date(year(posted) - 1, m, dd) ELSE make_date(year(posted), m, dd) END AS ticket
FROM e
""",
)
def year_interpolation(spark, d):
    """Three of the rules for a year that isn't written."""
    e = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("posted"), F.expr("cast(1 + o_orderkey % 12 as int)").alias("m"), F.expr("cast(1 + o_orderkey % 28 as int)").alias("dd"))
    posted, m, dd = F.col("posted"), F.col("m"), F.col("dd")
    return e.select("o_orderkey", D.year_of_event(posted, m, dd).alias("by_post"), D.year_by_half(posted, m, dd).alias("by_half"), D.ticket_date(posted, m, dd).alias("ticket"))


@query("day_spine", "SELECT d::DATE AS day, count(event_id) AS n FROM generate_series(DATE '2023-12-31', DATE '2024-02-03', INTERVAL 1 DAY) g(d) LEFT JOIN events ON ts::DATE = d::DATE GROUP BY 1")
def day_spine(spark, d):
    """Every day of the whole weeks of a month, with its events."""
    first, last = D.month_window(2024, 1)
    days = spark.range(1).select(F.explode(F.sequence(D.week_start(first), F.date_add(D.week_start(last), 6))).alias("day"))
    n = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.join(n, "day", "left").na.fill(0, ["n"])


@query(
    "backfill_targets",
    f"SELECT s.o_orderkey FROM ({_SPANS}) s LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a ON a.l_orderkey = s.o_orderkey WHERE starts <= DATE '1998-06-01' AND coalesce(ends, starts) >= DATE '1998-06-01' - 60 AND (coalesce(ends, starts) >= DATE '1998-06-01' OR coalesce(a.n, 0) = 0)",
)
def backfill_targets(spark, d):
    """Started, ended within sixty days, and either going on or still empty."""
    as_of = F.lit("1998-06-01").cast("date")
    filled = table(spark, d, "lineitem").filter("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    spans = _spans(spark, d).withColumn("until", F.coalesce("ends", "starts")).filter((F.col("starts") <= as_of) & (F.col("until") >= F.date_sub(as_of, 60)))
    spans = spans.join(filled, "o_orderkey", "left")
    return spans.filter((F.col("until") >= as_of) | (F.coalesce("n", F.lit(0)) == 0)).select("o_orderkey")
