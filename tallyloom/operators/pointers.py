"""Histories that are compacted by pointers kept between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.windows import compaction_chunk
from tallyloom.sources.versions import Versions


def advance(pointers: Versions, messages: DataFrame, run_id: str, size: int, summary: Column | None = None) -> DataFrame:
    """Compacts one chunk of every history that has more than ``size`` messages past its pointer; the pointers after it.

    messages: key, nth, text. A version of pointers holds key, pointer, chunks and summary for every history that was ever
    compacted. The chunk's summary and the pointer past it are published as one version that bears the run's id, so a run
    that stops halfway changes nothing and one that is repeated does nothing, and of two runs at once one fails.
    summary: of a chunk's sorted texts (column texts); by default their first words, one after the other.
    """
    last = pointers.current()
    if any(pointers.entry(n)["note"] == run_id for n in pointers.numbers()):
        return pointers.read()
    empty = messages.sparkSession.createDataFrame([], messages.select("key", F.col("nth").alias("pointer")).schema)
    known = pointers.read(last) if last else empty.selectExpr("key", "pointer", "0L as chunks", "'' as summary")
    open_ = messages.join(known.select("key", "pointer"), "key", "left").withColumn("pointer", F.coalesce("pointer", F.lit(-1)))
    chunk = compaction_chunk(open_, ["key"], "nth", F.col("pointer"), size, name="place_")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda m: m["text"]).alias("texts")
    made = chunk.groupBy("key").agg(F.max("nth").alias("to_"), texts)
    said = summary if summary is not None else F.array_join(F.transform("texts", lambda t: F.regexp_extract(t, r"^\s*(\S+)", 1)), " ")
    made = made.select("key", "to_", said.alias("said_"))
    both = known.join(made, "key", "full")
    grown = F.concat_ws("\n", F.when(F.col("summary") != "", F.col("summary")), "said_")
    after = both.select("key", F.coalesce("to_", "pointer").alias("pointer"), (F.coalesce("chunks", F.lit(0)) + F.when(F.col("to_").isNotNull(), 1).otherwise(0)).cast("long").alias("chunks"), grown.alias("summary"))
    pointers.publish(after, based_on=last, note=run_id, allow_empty=True)
    return pointers.read()
