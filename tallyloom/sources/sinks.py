"""Sinks: JSON rows, versioned exports, and replacing a table whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.versions import Versions


def json_rows(rows: DataFrame) -> DataFrame:
    """One JSON text for each row, nulls kept."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def versioned_export(rows: DataFrame, keys: list[str], version: int) -> DataFrame:
    """One JSON document for each key: its version and its sorted entries."""
    entries = [c for c in rows.columns if c not in keys]
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*entries))).alias("entries"))
    return lists.select(*keys, F.to_json(F.struct(F.lit(version).alias("version"), "entries")).alias("document"))


def replace_table(rows: DataFrame, path: str) -> int:
    """Publishes rows as the next version of the table in a folder and returns its number; an empty result is refused.

    Readers (``current_table``) see the version before or this one, at no moment none.
    """
    return Versions(rows.sparkSession, path).publish(rows)


def current_table(spark: SparkSession, path: str) -> DataFrame:
    """The last version of a table that replace_table publishes."""
    return Versions(spark, path).read()
