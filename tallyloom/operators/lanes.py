"""Lanes of intervals in a calendar's weeks, by kinds of pieces.

Within a week a piece is one of at most 56 kinds: whether its interval has several days, its first day and its number of
days. Pieces are placed by kind (several days first, then the earlier first day, then the longer), and those of a kind
all meet, so the choice of lanes depends on their number alone: they take the first lanes that are free on all their
days, in order of id. A week is thus placed from 56 numbers, and each piece finds its lane by its number within its kind.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators.joins import measured_join
from tallyloom.operators.lineage import checkpointed

#: log2 of the rows of a range, whose pieces a task sorts in memory.
RANGE_BITS = 14


def free_lanes(taken: list[list[tuple[int, int]]], count: int) -> list[tuple[int, int]]:
    """The first ``count`` lanes outside of several days' taken ones, as (first, number) of runs of lanes."""
    out, at = [], 0
    for low, high in sorted(run for day in taken for run in day):
        if low > at and count:
            n = min(count, low - at)
            out.append((at, n))
            count -= n
        at = max(at, high)
    return [*out, (at, count)] if count else out


def _placed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Runs of lanes of a week's kinds: from which number within the kind, how many, and the first lane."""
    days: list[list[tuple[int, int]]] = [[] for _ in range(7)]
    rows = []
    kinds = pdf.sort_values(["several", "first_day", "days"], ascending=[False, True, False])
    for kind in kinds.itertuples(index=False):
        here, nth = range(kind.first_day, kind.first_day + kind.days), 1
        for lane, n in free_lanes([days[d] for d in here], kind.n):
            rows.append((kind.week, kind.several, kind.first_day, kind.days, nth, nth + n, lane))
            nth += n
            for d in here:
                days[d].append((lane, lane + n))
    return pd.DataFrame(rows, columns=["week", "several", "first_day", "days", "from_", "to_", "lane_"])


def week_lanes(rows: DataFrame, cut: Column | None = None) -> DataFrame:
    """Pieces (week: its first day, id, piece_start, piece_end, several) with the first lane that is free, from 0.

    rows are pieces, or what ``cut`` (an array of structs of a piece's columns without id) makes pieces of. Rows are dealt
    into ranges of ids once, and each range counts its pieces by week and kind. What the ranges before it hold goes with
    the range as a row of its own that comes first in the numbering, so pieces are made where they are numbered and are
    never shuffled.
    """
    kind = ["week", "several", "first_day", "days"]
    cut = F.array(F.struct("week", "piece_start", "piece_end", "several")) if cut is None else cut
    shape = {"first_day": F.datediff("piece_start", "week").cast("int"), "days": (F.datediff("piece_end", "piece_start") + 1).cast("int")}
    inside = F.shiftright(F.monotonically_increasing_id(), RANGE_BITS)
    dealt = checkpointed(rows.repartitionByRange("id").sortWithinPartitions("id").withColumn("range_", inside))  # ranges are drawn once
    counts = dealt.select("range_", F.inline(cut)).withColumns(shape).groupBy("range_", *kind).agg(F.count("*").alias("n"))
    counts = checkpointed(counts)
    totals = counts.groupBy(*kind).agg(F.sum("n").alias("n"))
    runs = totals.groupBy("week").applyInPandas(_placed, "week date, several boolean, first_day int, days int, from_ long, to_ long, lane_ long")
    listed = runs.groupBy(*kind).agg(F.collect_list(F.struct("from_", "to_", "lane_")).alias("runs_"))  # few for a kind
    earlier = F.sum("n").over(W.partitionBy(*kind).orderBy("range_").rowsBetween(W.unboundedPreceding, -1))  # a row for each range
    start = F.date_add("week", F.col("first_day"))
    piece = F.struct("week", start.alias("piece_start"), F.date_add(start, F.col("days") - 1).alias("piece_end"), "several")
    starts = counts.withColumn("start_", earlier).filter("start_ is not null").select("range_", F.array(piece).alias("piece_"), "start_")
    ranges = max(counts.agg(F.count_distinct("range_")).head()[0], 1)
    both = dealt.unionByName(starts, allowMissingColumns=True).repartitionByRange(ranges, "range_")
    pieces = both.select("range_", "id", "start_", F.inline(F.when(F.col("start_").isNull(), cut).otherwise(F.col("piece_")))).withColumns(shape)
    pieces = pieces.select("range_", "id", "start_", *kind)
    order = W.partitionBy("range_", *kind).orderBy(F.col("start_").isNull(), "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = pieces.withColumn("nth_", F.sum(F.coalesce("start_", F.lit(1))).over(order)).filter("start_ is null")
    out = measured_join(numbered, listed, kind)
    mine = F.filter("runs_", lambda r: (r["from_"] <= F.col("nth_")) & (F.col("nth_") < r["to_"]))[0]
    return out.select("week", "id", start.alias("piece_start"), F.date_add(start, F.col("days") - 1).alias("piece_end"), "several", (mine["lane_"] + F.col("nth_") - mine["from_"]).alias("lane"))
