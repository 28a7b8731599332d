"""Tiered lookups and set-based joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.intervals import meeting_sums


def tiered_lookup(left: DataFrame, left_id: str, masters: DataFrame, master_id: str, tiers: list[tuple[Column, Column, bool]]) -> DataFrame:
    """left_id, master and tier (from 1): the first tier whose key finds a master.

    A tier is (key of left, key of masters, unique): with unique a key that several masters have finds none, else it
    finds the least id. Keys are grouped first, so every join is on one row for each key.
    """
    out = left.select(left_id, *[k.alias(f"k{i}_") for i, (k, _, _) in enumerate(tiers)])
    for i, (_, key, unique) in enumerate(tiers):
        found = masters.select(key.alias(f"k{i}_"), F.col(master_id).alias("m_")).groupBy(f"k{i}_").agg(F.min("m_").alias(f"m{i}_"), F.count("*").alias("n_"))
        found = found.filter("n_ = 1") if unique else found
        out = out.join(found.drop("n_"), f"k{i}_", "left")
    tier = F.coalesce(*[F.when(F.col(f"m{i}_").isNotNull(), i + 1) for i in range(len(tiers))])
    return out.select(left_id, F.coalesce(*[F.col(f"m{i}_") for i in range(len(tiers))]).alias("master"), tier.alias("tier"))


def overlapping(rows: DataFrame, starts: str, ends: str, first: Column, last: Column) -> DataFrame:
    """Rows whose interval meets a window, both inclusive; a null end is a point."""
    return rows.filter((F.col(starts) <= last) & (F.coalesce(ends, starts) >= first))


def season_match(rows: DataFrame, seasons: DataFrame, row_id: str) -> DataFrame:
    """rows (number, starts, ends, name) with the season of the same number, or else the first that overlaps, by name first.

    Intervals meet by the sums of dyadic ranges, so neither long intervals nor many seasons make pairs.
    """
    by_number = rows.join(seasons.filter("number is not null").groupBy("number").agg(F.min("season").alias("by_number")), "number", "left")
    open_ = by_number.filter("by_number is null").select(row_id, "starts", "ends", "name")
    spans = seasons.select(F.col("season").alias("by_span"), F.col("starts").alias("s_starts"), F.col("ends").alias("s_ends"), "name")
    first = lambda on: meeting_sums(open_, ("starts", "ends"), spans, ("s_starts", "s_ends"), F.struct("s_starts", "by_span"), on)
    found = first(["name"]).select(row_id, F.lit(0).alias("other"), "least").unionByName(first([]).select(row_id, F.lit(1).alias("other"), "least"))
    found = found.groupBy(row_id).agg(F.min(F.struct("other", "least"))["least"]["by_span"].alias("by_span"))
    return by_number.join(found, row_id, "left").select(row_id, F.coalesce("by_number", "by_span").alias("season"))


def grouped_in_order(members: DataFrame, dimension: DataFrame, key: str, member: str) -> DataFrame:
    """Every row of the dimension, in its order, with its sorted members; groups without any stay, empty."""
    lists = members.groupBy(key).agg(F.array_sort(F.collect_list(member)).alias("members"))
    return dimension.join(lists, key, "left").withColumn("members", F.coalesce("members", F.array().cast(lists.schema["members"].dataType)))
