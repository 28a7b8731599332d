"""Window operators: ranks, runs, pointers and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_per(rows: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "position") -> DataFrame:
    """The first n rows of each key, numbered from 1."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)


def date_runs(rows: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Runs of distinct days at most one apart: keys, run_start, run_end, days."""
    days = rows.select(*keys, F.col(day).alias("day_")).distinct()
    island = F.date_sub("day_", F.row_number().over(W.partitionBy(*keys).orderBy("day_")))
    runs = days.withColumn("island_", island).groupBy(*keys, "island_")
    return runs.agg(F.min("day_").alias("run_start"), F.max("day_").alias("run_end"), F.count("*").alias("days")).drop("island_")


def last_n(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key; ``nth`` numbers them in ascending order."""
    kept = top_per(rows, keys, [F.desc(order)], n, "back_")
    return kept.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(order))).drop("back_")


def after_pointer(rows: DataFrame, keys: list[str], order: str, pointer: Column) -> DataFrame:
    """Rows past the pointer, without the last row of the key."""
    last = F.lead(order).over(W.partitionBy(*keys).orderBy(order)).isNull()
    return rows.withColumn("last_", last).filter((F.col(order) > pointer) & ~F.col("last_")).drop("last_")


def compaction_chunk(rows: DataFrame, keys: list[str], order: str, pointer: Column, size: int, name: str = "nth") -> DataFrame:
    """The first ``size`` rows past the pointer, of keys that have more than that past it."""
    past = rows.filter(F.col(order) > pointer)
    w = W.partitionBy(*keys)
    past = past.withColumn("n_", F.count("*").over(w)).withColumn(name, F.row_number().over(w.orderBy(order)))
    return past.filter((F.col("n_") > size) & (F.col(name) <= size)).drop("n_")


def transitions(rows: DataFrame, keys: list[str], order: list[str], state: Column) -> DataFrame:
    """Rows where the state turns from false to true against the row before of the same key."""
    before = F.lag(state).over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("before_", before).filter(state & (F.col("before_") == F.lit(False))).drop("before_")


def week_pieces(rows: DataFrame, starts: str, ends: str) -> DataFrame:
    """One row for each week (from Sunday) that an interval touches: week, piece_start, piece_end."""
    first = F.date_sub(F.col(starts), F.dayofweek(starts) - 1)
    weeks = rows.withColumn("week", F.explode(F.sequence(first, F.col(ends), F.expr("interval 7 days"))))
    return weeks.withColumn("piece_start", F.greatest("week", starts)).withColumn("piece_end", F.least(F.date_add("week", 6), F.col(ends)))


def pieces_of_weeks(starts: Column, ends: Column, *extra: Column) -> Column:
    """The pieces of week_pieces of one row, as an array of structs."""
    weeks = F.sequence(F.date_sub(starts, F.dayofweek(starts) - 1), ends, F.expr("interval 7 days"))
    return F.transform(weeks, lambda w: F.struct(w.alias("week"), F.greatest(w, starts).alias("piece_start"), F.least(F.date_add(w, 6), ends).alias("piece_end"), *extra))


def restocked_first(rows: DataFrame, product: str, shop: str, order: str, there: str) -> DataFrame:
    """Rows where a shop's stock comes up (there: 0 or 1) while no shop had the product just before."""
    last = F.lag(there).over(W.partitionBy(product, shop).orderBy(order))
    moved = rows.withColumn("delta_", F.col(there) - F.coalesce(last, F.lit(0)))
    before = F.sum("delta_").over(W.partitionBy(product).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return moved.withColumn("before_", F.coalesce(before, F.lit(0))).filter("delta_ = 1 and before_ = 0").drop("delta_", "before_")


def resolve_slots(slots: DataFrame) -> DataFrame:
    """slots (owned, chosen, candidates: array of owned ones) with the state and who fills it.

    The owner's own entry goes first, then the chosen one, then the first candidate; else the slot is vacant.
    """
    state = F.when(F.col("owned"), "owned").when(F.col("chosen").isNotNull() | (F.size("candidates") > 0), "substituted").otherwise("vacant")
    return slots.withColumn("state", state).withColumn("filled_by", F.when(~F.col("owned"), F.coalesce("chosen", F.get("candidates", F.lit(0)))))
