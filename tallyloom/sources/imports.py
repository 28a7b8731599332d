"""Imports of JSON rows under a contract; what breaks it is kept with the reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """What a field must be: its type, whether it may be missing (null or blank), a pattern, or a list of values."""

    kind: str = "string"
    required: bool = False
    pattern: str | None = None
    values: tuple[str, ...] = ()
    default: str | None = None

    def given(self, name: str) -> Column:
        text = F.trim(F.col(f"`{name}`"))
        text = F.when(text != "", text)
        return F.coalesce(text, F.lit(self.default)) if self.default is not None else text

    def wrong(self, name: str) -> Column:
        """The reason why a value breaks the contract, or null."""
        text = self.given(name)
        bad = F.lit(False) if self.kind == "string" else text.isNotNull() & text.try_cast(self.kind).isNull()
        bad = bad | ~F.coalesce(text.rlike(self.pattern), F.lit(True)) if self.pattern else bad
        bad = bad | ~F.coalesce(text.isin(*self.values), F.lit(True)) if self.values else bad
        missing = text.isNull() if self.required else F.lit(False)
        return F.when(missing, f"missing {name}").when(bad, f"bad {name}")


def import_rows(spark: SparkSession, path: str, contract: dict[str, Field]) -> tuple[DataFrame, DataFrame]:
    """(rows with the contract's fields and types, rejects: line and reasons) of files with one JSON object on a line.

    Fields are read as texts, so a value of a wrong type is judged and not lost; objects and lists are their JSON. A line that
    is no JSON object is rejected as such. All reasons of a line are given, in the order of the contract.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", ", ".join(f"`{n}` string" for n in contract) + ", _broken string", {"columnNameOfCorruptRecord": "_broken"})
    read = lines.select(F.col("value").alias("line_"), parsed.alias("p_")).select("line_", "p_.*")
    broken = F.col("_broken").isNotNull()
    reasons = F.array_compact(F.array(*[f.wrong(n) for n, f in contract.items()]))
    judged = read.withColumn("reasons_", F.when(broken, F.array(F.lit("no JSON object"))).otherwise(reasons))
    good = judged.filter(F.size("reasons_") == 0).select(*[f.given(n).cast(f.kind).alias(n) for n, f in contract.items()])
    return good, judged.filter(F.size("reasons_") > 0).select(F.col("line_").alias("line"), F.col("reasons_").alias("reasons"))


def id_or_key(rows: DataFrame, ref: str, masters: DataFrame, master_id: str, master_key: str, name: str) -> DataFrame:
    """rows with the master whose key is ref, or else whose id it is if it is all digits; null where neither is."""
    by_key = masters.groupBy(F.col(master_key).alias(ref)).agg(F.min(master_id).alias("by_key_"))
    by_id = masters.select(F.col(master_id).cast("string").alias("as_text_"), F.col(master_id).alias("by_id_")).distinct()
    plain = F.when(F.col(ref).rlike("^[0-9]+$"), F.regexp_replace(F.col(ref), "^0+(?=.)", ""))
    out = rows.join(by_key, ref, "left").withColumn("plain_", plain).join(by_id, F.col("plain_") == F.col("as_text_"), "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("by_key_", "by_id_").alias(name))
