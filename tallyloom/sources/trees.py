"""Recursive descent into JSON texts, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.lineage import checkpointed


def json_tree(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Every value of JSON texts at any depth: key, place, name, value (a variant) and kind.

    place is the path as positions, and its order is that of a walk through the text in which an object's fields go by
    their names; name is the field, null for elements of lists and the whole. Each level is one lateral join over the
    values of the level above, so a text is as deep as it likes and no row is visited twice. Texts that aren't JSON, and
    those in which an object names a field twice, have no values.
    """
    whole = rows.select(F.col(key).alias("key_"), F.array().cast("array<int>").alias("place"), F.lit(None).cast("string").alias("name"), F.try_parse_json(text).alias("value"))
    level = checkpointed(whole.filter(F.col("value").isNotNull()))
    levels = [level]
    spark = rows.sparkSession
    while True:
        inner = level.alias("up").lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).alias("in"))
        level = checkpointed(inner.select("key_", F.concat("up.place", F.array(F.col("in.pos"))).alias("place"), F.col("in.key").alias("name"), F.col("in.value").alias("value")))
        if level.isEmpty():
            break
        levels.append(level)
    out = levels[0]
    for one in levels[1:]:
        out = out.union(one)
    kind = F.regexp_extract(F.schema_of_variant("value"), r"^(\w+)", 1)
    return out.select(F.col("key_").alias(key), "place", "name", "value", kind.alias("kind"))


def found_values(rows: DataFrame, key: str, text: str, field: str) -> DataFrame:
    """(key, place, found): the value of a field wherever it lies, as a string; of objects and lists their JSON, of null null."""
    tree = json_tree(rows, key, text).filter(F.col("name") == field)
    plain = F.try_variant_get("value", "$", "string")
    return tree.select(key, "place", F.when(~F.is_variant_null("value"), F.coalesce(plain, F.to_json("value"))).alias("found"))


def rich_texts(rows: DataFrame, key: str, text: str, blocks: list[str]) -> DataFrame:
    """(key, nth, block): the visible text of each block of a rich document, in order.

    A block is an object whose type is one of ``blocks``; its text are the strings of the ``text`` fields below it that lie
    in no further block, put together in order. Blocks without text are left out.
    """
    tree = json_tree(rows, key, text)
    typed = (F.col("name") == "type") & F.try_variant_get("value", "$", "string").isin(blocks)
    above = F.slice("place", F.lit(1), F.size("place") - 1)
    starts = tree.filter(typed).select(key, above.alias("start_"))
    texts = tree.filter((F.col("name") == "text") & (F.col("kind") == "STRING")).select(key, "place", F.try_variant_get("value", "$", "string").alias("text_"))
    # a text's block is the nearest of the objects above it: its own paths are the keys
    paths = F.transform(F.sequence(F.lit(0), F.size("place") - 1), lambda n: F.slice("place", F.lit(1), n))
    near = texts.select(key, "place", "text_", F.explode(paths).alias("start_")).join(starts, [key, "start_"])
    own = near.groupBy(key, "place").agg(F.max(F.struct(F.size("start_").alias("depth"), "start_", "text_")).alias("own_"))
    listed = own.groupBy(key, F.col("own_.start_").alias("start_")).agg(F.array_sort(F.collect_list(F.struct("place", F.col("own_.text_").alias("text_")))).alias("texts_"))
    joined = listed.select(key, "start_", F.array_join(F.transform("texts_", lambda t: t["text_"]), "").alias("block")).filter("block <> ''")
    ordered = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_", "block"))).alias("all_"))
    return ordered.select(key, F.posexplode("all_").alias("nth", "one_")).select(key, "nth", F.col("one_.block").alias("block"))
