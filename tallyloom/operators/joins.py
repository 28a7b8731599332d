"""Joins that choose by a checked size between a broadcast and a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and bytes of a table that may be sent to every executor; a larger one is joined by a shuffle.
ROWS, BYTES = 500_000, 64_000_000
#: Bytes of distinct long values that a task's rows are to have, about: a column's dictionary in Parquet holds 1 MB, and beyond it each row has its value written out.
VALUE_BYTES = 250_000


def is_small(table: DataFrame, rows: int = ROWS, size: int = BYTES) -> bool:
    """Whether a table has no more than so many rows and about so many bytes (as JSON texts)."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns])))
    found = table.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).head()
    return found["n"] <= rows and found["bytes"] <= size


def measured_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """left join right; right is measured first and broadcast only if it has few rows and bytes."""
    return left.join(F.broadcast(right) if is_small(right) else right, on, how)


def attached(left: DataFrame, right: DataFrame, on: list[str], key: str, long: str) -> DataFrame:
    """left join right, whose rows each give many rows of left one long text (column long).

    Rows that get the same text lie in few tasks, and a task's rows have few texts, so that a file holds each once and not
    once a row. key spreads the rows of one text over ranges.
    """
    parts = int((right.agg(F.sum(F.octet_length(long))).head()[0] or 0) // VALUE_BYTES) + 1
    if is_small(right):
        return left.repartitionByRange(parts, *on, key).join(F.broadcast(right), on)
    return left.repartition(parts, *on).join(right.repartition(parts, *on).hint("merge"), on)
