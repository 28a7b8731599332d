"""Written intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet there and reading it again: a lost executor then costs the tasks it ran and not
the whole history, and later steps read only the columns they need.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a new temporary one on a single machine, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = f"file://{tempfile.mkdtemp(prefix='tallyloom-')}"
    return _OWN["dir"]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tallyloom/{uuid.uuid4().hex}-{label}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """df, written once to the shared folder and read from there."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Deletes the files of a staged table that no later step reads."""
    for f in {name.rpartition("/")[0] for name in df.inputFiles()}:
        _remove(df.sparkSession, f)


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps that are done: it does so when the driver's garbage is collected."""
    spark.sparkContext._jvm.System.gc()
