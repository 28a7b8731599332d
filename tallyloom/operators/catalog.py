"""Catalog operators: search, comparison and clean-up of offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_cheapest(products: DataFrame, offers: DataFrame, key: str, offer_key: str, price: Column, usable: Column) -> DataFrame:
    """products with the least price of their usable offers (null without one)."""
    least = offers.filter(usable).groupBy(F.col(offer_key).alias(key)).agg(F.min(price).alias("cheapest"))
    return products.join(least, key, "left")


def offer_summary(offers: DataFrame, key: str, price: Column, usable: Column, there: Column) -> DataFrame:
    """By product, in one pass: the least usable price (null without one), and whether any offer is ``there``."""
    return offers.groupBy(key).agg(F.min(F.when(usable, price)).alias("cheapest"), F.coalesce(F.bool_or(there), F.lit(False)).alias("any_there"))


def having_any(products: DataFrame, offers: DataFrame, key: str, offer_key: str, at_least: int = 1) -> DataFrame:
    """Products with at least so many offers (a semi-join; counted only where more than one is asked for)."""
    keys = offers.select(F.col(offer_key).alias(key))
    if at_least > 1:
        keys = keys.groupBy(key).count().filter(F.col("count") >= at_least).select(key)
    return products.join(keys, key, "left_semi")


def flag_lowest(offers: DataFrame, product: str, price: Column, usable: Column) -> DataFrame:
    """offers with ``lowest``: usable and at the least price of the product, ties all flagged."""
    least = F.min(F.when(usable, price)).over(W.partitionBy(product))
    return offers.withColumn("lowest", F.coalesce(usable & (price == least), F.lit(False)))


def best_per(offers: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first offer of each key, in an order that has no ties that matter."""
    return offers.withColumn("nth_", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("nth_ = 1").drop("nth_")


def price_summary(offers: DataFrame, product: str, price: Column, usable: Column) -> DataFrame:
    """Least, most and average usable price by product, the spread, and the discount of the least to the most in percent."""
    kept = offers.filter(usable).groupBy(product).agg(F.min(price).alias("low"), F.max(price).alias("high"), (F.sum(price.cast("decimal(12,2)")).cast("double") / F.count("*")).alias("mean"), F.count("*").alias("n_offers"))
    return kept.withColumn("spread", F.col("high") - F.col("low")).withColumn("discount_pct", F.floor((F.col("high") - F.col("low")) * 100 / F.col("high")))


def page(rows: DataFrame, order: list[Column], number: int, size: int, most: int = 50) -> DataFrame:
    """One page (from 1) with the total and the last page's number on each row."""
    size = min(size, most)
    total = rows.agg(F.count("*").alias("total"))
    here = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return here.crossJoin(F.broadcast(total)).withColumn("last_page", F.greatest(F.ceil(F.col("total") / size), F.lit(1)))
