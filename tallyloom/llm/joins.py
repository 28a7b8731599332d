"""Joins that choose by a checked size between a broadcast and a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType

#: Rows and bytes of a key table that may be sent to every executor; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64_000_000


def _width(column: Column, kind: DataType) -> Column:
    """About the bytes of a value."""
    if isinstance(kind, ArrayType):
        return F.coalesce(F.size(column) * 8, F.lit(0)) + 16
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    return F.lit(8)


def is_small(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table has no more than so many rows and about so many bytes."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in table.schema.fields), F.lit(16))
    found = table.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(width.cast("long")).alias("bytes")).head()
    return found["n"] <= rows and (found["bytes"] or 0) <= size


def bounded_join(left: DataFrame, right: DataFrame, on, how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """left join right; right is measured first and broadcast only if it has few rows and bytes."""
    return left.join(F.broadcast(right) if is_small(right, rows) else right, on, how)
