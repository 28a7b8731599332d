"""Readers of the Parquet tables that the queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table by name; the path goes to Spark as it is, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
