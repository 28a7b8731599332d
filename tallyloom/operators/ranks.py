"""Running totals and ranks over whole tables, without a window that holds a whole key.

Rows are dealt into sorted ranges of keys and order, so a key that holds most rows is many ranges. Totals run within each
range, and what the ranges before it hold for the same key is added: a table of one row for each range and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators.joins import measured_join
from tallyloom.operators.lineage import checkpointed

#: (column, descending)
Order = list[tuple[str, bool]]


def _sorted(order: Order) -> list[Column]:
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in order]


def running_totals(rows: DataFrame, keys: list[str], order: Order, value: Column, name: str, ranges: int | None = None) -> DataFrame:
    """rows with the sum of value over the rows before, in order, of the same keys (0 for the first of them).

    The order must tell the rows of a key apart. ranges: number of ranges (as many as shuffle partitions).
    """
    by = [*[F.col(k) for k in keys], *_sorted(order)]
    dealt = rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)
    dealt = checkpointed(dealt.withColumns({"range_": F.spark_partition_id(), "value_": value}))  # ranges are drawn once
    inside = W.partitionBy("range_", *keys).orderBy(*_sorted(order)).rowsBetween(W.unboundedPreceding, -1)
    sums = dealt.groupBy("range_", *keys).agg(F.sum("value_").alias("sum_"))
    before = W.partitionBy(*keys).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    start = F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("start_")
    starts = sums.select(F.col("range_").alias("of_"), *[F.col(k).alias(f"{k}_of_") for k in keys], start) if keys else _starts(sums)
    same = F.col("range_") == F.col("of_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_of_"))
    local = dealt.withColumn("local_", F.coalesce(F.sum("value_").over(inside), F.lit(0)))
    out = measured_join(local, starts, same, "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("local_") + F.col("start_")).alias(name))


def _starts(sums: DataFrame) -> DataFrame:
    """Where each range starts if there are no keys: sums of the ranges before, which are as few as partitions."""
    total = F.sort_array(F.collect_list(F.struct("range_", "sum_")))
    spread = sums.agg(total.alias("all_")).select(F.posexplode("all_").alias("at_", "one_"), "all_")
    before = F.aggregate(F.slice("all_", F.lit(1), F.col("at_")), F.lit(0).cast(sums.schema["sum_"].dataType), lambda a, x: a + x["sum_"])
    return spread.select(F.col("one_.range_").alias("of_"), before.alias("start_"))


def positions(rows: DataFrame, keys: list[str], order: Order, name: str = "position", ranges: int | None = None) -> DataFrame:
    """rows numbered from 1 within their keys; the order must tell them apart."""
    return running_totals(rows, keys, order, F.lit(1).cast("long"), "before_", ranges).withColumn(name, F.col("before_") + 1).drop("before_")


def ranks(rows: DataFrame, keys: list[str], order: Order, name: str = "rank", ranges: int | None = None) -> DataFrame:
    """rows with their competition rank within their keys: one more than the rows strictly before; ties share one.

    Ties are counted first, so that values are distinct where ranges are cut: no tie lies across a border, and one that
    holds most rows is one row.
    """
    values = [c for c, _ in order]
    counts = rows.groupBy(*keys, *values).agg(F.count("*").alias("ties_"))
    ranked = running_totals(counts, keys, order, F.col("ties_"), "before_", ranges)
    names = {c: f"{c}_of_" for c in [*keys, *values]}
    ranked = ranked.select(*[F.col(c).alias(n) for c, n in names.items()], (F.col("before_") + 1).alias(name))
    same = F.lit(True)
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    return measured_join(rows, ranked, same).drop(*names.values())
