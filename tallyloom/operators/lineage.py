"""Cutting lineage in iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where that is unset, a new one on a single machine, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
    return named.rstrip("/") if named else f"file://{tempfile.mkdtemp(prefix='tallyloom-')}"


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/tallyloom/{uuid.uuid4().hex}-{label}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, checkpointed in the folder that spark.checkpoint.dir names; where that is unset, in a new one on a single machine,
    else an error."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
