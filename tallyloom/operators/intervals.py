"""Joins of intervals of days by dyadic ranges.

The line of days is halved again and again; an interval is the union of at most two ranges of each length (its cover), and
lies below these ranges' forebears. Of two ranges one holds the other or they are apart, so two intervals meet if and only
if a range of one's cover is a range of the other's cover or a forebear of one. That makes about 2 log2(days) keys for
an interval, whatever its length, and equality joins. A null start is open (since ever), a null end too (for ever); an
interval that ends before it starts holds no day and meets nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators.joins import measured_join
from tallyloom.operators.lineage import checkpointed

#: log2 of the days of the line, which has day 0 (1970-01-01) in the middle: all dates of Spark.
LEVELS = 23
_MIDDLE = 1 << (LEVELS - 1)


def _day(day: Column) -> Column:
    return (F.datediff(day, F.lit("1970-01-01").cast("date")) + _MIDDLE).cast("long")


def cover(first: Column, last: Column) -> Column:
    """The ranges that make up the days first to last (places on the line), as numbers of a tree whose root is 1."""
    parts = []
    for k in range(LEVELS + 1):
        low = F.shiftright(first + ((1 << k) - 1), k)
        high = F.shiftright(last + 1, k)
        root = 1 << (LEVELS - k)
        parts += [F.when((low < high) & (low % 2 == 1), low + root), F.when((low < high) & (high % 2 == 1), high - 1 + root)]
    return F.array_distinct(F.array_compact(F.array(*parts)))


def forebears(ranges: Column) -> Column:
    """The ranges above some ranges, each once."""
    return F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.filter(F.transform(F.sequence(F.lit(1), F.lit(LEVELS)), lambda j: F.call_function("shiftright", r, j)), lambda x: x > 0))))


def _days(rows: DataFrame, starts: str, ends: str) -> DataFrame:
    """Rows with first_ and last_ (places on the line); those without a day are left out."""
    first = F.coalesce(_day(F.col(starts)), F.lit(0).cast("long"))
    last = F.coalesce(_day(F.col(ends)), F.lit(2 * _MIDDLE - 1).cast("long"))
    return rows.withColumns({"first_": first, "last_": last}).filter("first_ <= last_")


def _placed(rows: DataFrame, starts: str, ends: str) -> DataFrame:
    """Rows with first_, last_ and cover_."""
    return _days(rows, starts, ends).withColumn("cover_", cover(F.col("first_"), F.col("last_")))


def met_elsewhere(rows: DataFrame, key: str, kind: str, source: str, starts: str, ends: str) -> DataFrame:
    """Rows that another source's row of the same kind meets; repeated rows stay as often as they are there.

    Those that a row meets are the ones that start by its end less the ones that end before its start. Both are running
    sums over days by kind, of which the own source's share is taken away, so no pair is made and each row asks two days
    of a table of kinds, sources and days.
    """
    placed = checkpointed(_days(rows, starts, ends).filter(F.col(kind).isNotNull() & F.col(source).isNotNull()))
    event = lambda day, opened, closed: F.struct(day.alias("day_"), F.lit(opened).alias("o_"), F.lit(closed).alias("c_"))
    first, last = F.col("first_"), F.col("last_")
    events = placed.select(kind, source, F.inline(F.array(event(first, 1, 0), event(last, 0, 0), event(last + 1, 0, 1))))
    own = events.groupBy(kind, source, "day_").agg(F.sum("o_").alias("o_"), F.sum("c_").alias("c_"))
    every = own.groupBy(kind, "day_").agg(F.sum("o_").alias("all_o_"), F.sum("c_").alias("all_c_"))
    # a window holds a row for each day that occurs, so the calendar bounds it
    upto = lambda c, *by: F.sum(c).over(W.partitionBy(*by).orderBy("day_").rowsBetween(W.unboundedPreceding, W.currentRow))
    own = own.withColumns({"o_": upto("o_", kind, source), "c_": upto("c_", kind, source)})
    every = every.withColumns({"all_o_": upto("all_o_", kind), "all_c_": upto("all_c_", kind)})
    sums = own.join(every, [kind, "day_"]).select(kind, source, "day_", (F.col("all_o_") - F.col("o_")).alias("opened_"), (F.col("all_c_") - F.col("c_")).alias("closed_"))
    sums = checkpointed(sums)
    out = measured_join(placed, sums.select(kind, source, F.col("day_").alias("last_"), "opened_"), [kind, source, "last_"])
    out = measured_join(out, sums.select(kind, source, F.col("day_").alias("first_"), "closed_"), [kind, source, "first_"])
    return out.filter("opened_ > closed_").select(*rows.columns)


def meeting_sums(left: DataFrame, left_span: tuple[str, str], right: DataFrame, right_span: tuple[str, str], least: Column, on: list[str] | None = None) -> DataFrame:
    """left's rows that meet any of right, with ``met`` (how many) and ``least`` (the least value of a column among them).

    An interval meets another if it holds the other's first day or starts within its later days. The first are found at
    the ranges above that day, each of which is in an interval's cover or not; the second at the ranges that cover the
    later days, which each start lies in or not. Either way one range counts an interval, so ranges' sums are all that is
    joined, and no pair is made. Equal intervals of either side are summed up, or looked up, once.
    """
    on = on or []
    spans = [*on, "first_", "last_"]
    up = lambda day: F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda j: F.call_function("shiftright", day + (1 << LEVELS), j))
    tagged = lambda holds, starts: F.inline(F.concat(F.transform(holds, lambda r: F.struct(r.alias("range_"), F.lit(True).alias("holds_"))), F.transform(starts, lambda r: F.struct(r.alias("range_"), F.lit(False).alias("holds_")))))
    b = _days(right, *right_span).groupBy(*spans).agg(F.count("*").alias("n_"), F.min(least).alias("m_"))
    b = b.select(*on, "n_", "m_", tagged(cover(F.col("first_"), F.col("last_")), up(F.col("first_"))))
    b = checkpointed(b.groupBy(*on, "range_", "holds_").agg(F.sum("n_").alias("n_"), F.min("m_").alias("m_")))
    a = _days(left, *left_span)
    asked = a.select(*spans).distinct()
    asked = asked.select(*spans, tagged(up(F.col("first_")), cover(F.col("first_") + 1, F.col("last_"))))
    found = measured_join(asked, b, [*on, "range_", "holds_"]).groupBy(*spans).agg(F.sum("n_").alias("met"), F.min("m_").alias("least"))
    return a.join(found.hint("merge"), spans).select(*[F.col(c) for c in left.columns], "met", "least")


def meeting_pairs(left: DataFrame, left_span: tuple[str, str], right: DataFrame, right_span: tuple[str, str], on: list[str] | None = None) -> DataFrame:
    """All columns of left and right (names must differ, but for those of ``on``) for each pair whose intervals meet, once.

    A pair is taken where the first day they share lies: one range of each cover holds it, and one of these the other.
    """
    on = on or []
    names = {c: f"{c}_l_" for c in left.columns}
    a = _placed(left, *left_span).select(*[F.col(c).alias(n) if c not in on else F.col(c) for c, n in names.items()], F.col("first_").alias("al_"), "cover_")
    b = _placed(right, *right_span).withColumnRenamed("first_", "bl_").drop("last_")
    on_cover = a.select("*", F.explode("cover_").alias("range_")).drop("cover_").join(b.select("*", F.explode(F.array_union("cover_", forebears(F.col("cover_")))).alias("range_")).drop("cover_"), [*on, "range_"])
    above = a.select("*", F.explode(forebears(F.col("cover_"))).alias("range_")).drop("cover_").join(b.select("*", F.explode("cover_").alias("range_")).drop("cover_"), [*on, "range_"])
    # the range's days begin where its number, brought down to the lowest level, does
    depth = F.length(F.bin("range_")) - 1
    place = F.greatest("al_", "bl_")
    there = F.call_function("shiftright", place, F.lit(LEVELS) - depth) + F.call_function("shiftleft", F.lit(1).cast("long"), depth) == F.col("range_")
    pairs = on_cover.unionByName(above).filter(there)
    back = [F.col(n).alias(c) if c not in on else F.col(c) for c, n in names.items()]
    return pairs.select(*back, *[c for c in right.columns if c not in on])
