"""Stateful ingest: each operator takes the old snapshot and a new batch and returns the new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], overwrite: tuple[str, ...] = (), fill: tuple[str, ...] = (), insert_if: Column | None = None) -> DataFrame:
    """old with new merged in by key, and ``action``: created, updated or kept.

    overwrite: columns that the batch sets, to null too. fill: columns that it sets only where they are null. insert_if:
    a condition on columns of the batch for rows that are new; known ones are updated all the same.
    """
    a = old.withColumn("in_old_", F.lit(True)).alias("o")
    b = new.withColumn("in_new_", F.lit(True)).alias("n")
    if insert_if is not None:
        b = new.withColumn("in_new_", F.lit(True)).withColumn("may_", insert_if).alias("n")
    both = a.join(b, keys, "full_outer")
    if insert_if is not None:
        both = both.filter(F.col("in_old_").isNotNull() | F.coalesce("may_", F.lit(False)))
    came = F.col("in_new_").isNotNull()
    out = []
    for c in old.columns:
        o = F.col(f"o.{c}")
        if c in keys:
            out.append(F.col(c))
        elif c in overwrite:
            out.append(F.when(came, F.col(f"n.{c}")).otherwise(o).alias(c))
        elif c in fill:
            out.append(F.coalesce(o, F.col(f"n.{c}")).alias(c))
        elif c in new.columns:
            out.append(F.when(F.col("in_old_").isNull(), F.col(f"n.{c}")).otherwise(o).alias(c))
        else:
            out.append(o.alias(c))
    action = F.when(F.col("in_old_").isNull(), "created").when(came, "updated").otherwise("kept")
    return both.select(*out, action.alias("action"))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def merged_status(old: Column, new: Column, confirmed: str = "verified") -> Column:
    """Confirmation overrides; anything less never overwrites."""
    return F.when(new == confirmed, new).otherwise(F.coalesce(old, new))


def merged_source(old: Column, new: Column, ranks: dict[str, int]) -> Column:
    """The source of higher rank; equal ranks keep the old one."""
    rank = lambda c: F.coalesce(*[F.when(c == k, v) for k, v in ranks.items()], F.lit(0))
    return F.when(old.isNull() | (rank(new) > rank(old)), new).otherwise(old)


def corroborated(sightings: DataFrame, key: list[str], source: str) -> DataFrame:
    """Distinct sources of each key and their number."""
    return sightings.groupBy(*key).agg(F.array_sort(F.collect_set(source)).alias("sources")).withColumn("corroboration", F.size("sources"))


def expire_and_prune(rows: DataFrame, expires: str, updated: str, as_of: Column, grace_days: int) -> DataFrame:
    """rows with status expired where past due, without those past due (or, with no expiry, untouched) for the grace."""
    limit = F.date_sub(F.to_date(as_of), grace_days)
    kept = rows.filter(F.to_date(F.coalesce(expires, updated)) >= limit)
    return kept.withColumn("status", F.when(F.col(expires) <= as_of, "expired").otherwise(F.col("status")))


def mark_unseen(offers: DataFrame, collected: str, run_start: Column, shop: str, crawled: DataFrame) -> DataFrame:
    """offers with available false where a crawled shop no longer lists them; other shops stay as they are."""
    shops = crawled.select(F.col(shop), F.lit(True).alias("crawled_")).distinct()
    unseen = F.col("crawled_").isNotNull() & (F.col(collected).isNull() | (F.col(collected) < run_start))
    return offers.join(shops, shop, "left").withColumn("available", F.col("available") & ~unseen).drop("crawled_")


def deactivate_missing(old: DataFrame, arrived: DataFrame, key: str, ratio: float = 0.5) -> DataFrame:
    """old with active false for keys that didn't arrive, unless fewer arrived than ratio times the active ones.

    The guard is one row of two counts, so no data moves to the driver, and an empty arrival changes nothing.
    """
    keys = arrived.select(key).distinct().withColumn("came_", F.lit(True))
    guard = keys.agg(F.count("*").alias("a_")).crossJoin(old.agg(F.count_if("active").alias("b_")))
    guard = guard.select(((F.col("a_") > 0) & (F.col("a_") >= ratio * F.col("b_"))).alias("ok_"))
    out = old.join(keys, key, "left").crossJoin(F.broadcast(guard))
    return out.withColumn("active", F.col("active") & (F.col("came_").isNotNull() | ~F.col("ok_"))).drop("came_", "ok_")


def replace_own(old: DataFrame, new: DataFrame, source: str, own: str, keys: list[str], manual: str = "manual") -> DataFrame:
    """old without the rows of one source, with its new ones, except where a manual row has the same key."""
    kept = old.filter(F.col(source) != own)
    by_hand = kept.filter(F.col(source) == manual).select(*keys).distinct()
    return kept.unionByName(new.join(by_hand, keys, "left_anti").select(*old.columns))


def fold_signals(events: DataFrame, signals: DataFrame, key: str) -> DataFrame:
    """events (key, date) with the verdict of their signals (seq, date), in order.

    The first signal fills a missing date; later ones confirm it or are a mismatch. Signals of a key are folded in one
    pass over their sorted array.
    """
    lists = signals.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", F.col("date").alias("day")))).alias("signals_"))
    start = F.struct(F.col("date").alias("day"), F.lit(0).alias("filled"), F.lit(0).alias("confirmed"), F.lit(0).alias("mismatched"))
    step = lambda a, s: F.struct(
        F.coalesce(a["day"], s["day"]).alias("day"),
        (a["filled"] + F.when(a["day"].isNull(), 1).otherwise(0)).alias("filled"),
        (a["confirmed"] + F.when(a["day"] == s["day"], 1).otherwise(0)).alias("confirmed"),
        (a["mismatched"] + F.when(a["day"] != s["day"], 1).otherwise(0)).alias("mismatched"),
    )
    state = F.aggregate(F.coalesce("signals_", F.array().cast(lists.schema["signals_"].dataType)), start, step)
    return events.join(lists, key, "left").withColumn("s_", state).select(key, F.col("s_.day").alias("date"), "s_.filled", "s_.confirmed", "s_.mismatched")


def merge_topics(old: Column, new: Column) -> Column:
    """Null stands for all topics and absorbs; else the union."""
    return F.when(old.isNotNull() & new.isNotNull(), F.array_sort(F.array_union(old, new)))


def merge_subscriptions(old: DataFrame, new: DataFrame, keys: list[str], topics: str) -> DataFrame:
    """All subscriptions after new requests, with asked_: whether there was one. A null set stands for all topics.

    One that is new gets what it asks for. One that was there keeps all topics if it had them, gets all if it asks for
    them, and else adds to its own; without a request it stays as it was.
    """
    before = old.select(*keys, F.col(topics).alias("old_"), F.lit(True).alias("had_"))
    asked = new.select(*keys, F.col(topics).alias("new_"), F.lit(True).alias("asked_"))
    both = before.join(asked, keys, "full")
    after = F.when(F.col("had_").isNull(), F.array_sort("new_")).when(F.col("asked_").isNull(), F.array_sort("old_")).otherwise(merge_topics(F.col("old_"), F.col("new_")))
    return both.select(*keys, after.alias(topics), F.coalesce("asked_", F.lit(False)).alias("asked_"))


def merge_maps(left: Column, right: Column) -> Column:
    """Entries of both; the right one's value wins."""
    return F.map_from_entries(F.concat(F.map_entries(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))), F.map_entries(right)))


def not_yet_told(rows: DataFrame, told: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys no notice has gone out for."""
    return rows.join(told.select(*keys).distinct(), keys, "left_anti")


def owned_overwrite(old: Column, new: Column, owner: Column, source: Column, came: Column) -> Column:
    """Only the owning source may overwrite or clear a field; others fill it where it is empty and unowned."""
    return F.when(came & (owner == source), new).when(owner.isNull(), F.coalesce(old, new)).otherwise(old)


def attach_duplicates(old: DataFrame, new: DataFrame, same: list[str], key: str, tokens: str, links: str) -> tuple[DataFrame, DataFrame]:
    """old with empty links filled from duplicates in new, and the rows of new that duplicate nothing.

    A duplicate has the same values in ``same`` (a day) and a token in common; tokens are exploded into the join's key.
    The least key that shares a token is the one that keeps the duplicate's links, so of the old rows with a token only the
    least key is joined: a new row has no more matches than tokens.
    """
    mine = old.select(F.col(key).alias("old_key"), *same, F.explode(tokens).alias("token_")).groupBy(*same, "token_").agg(F.min("old_key").alias("old_key"))
    other = new.select(F.col(key).alias("new_key"), links, *same, F.explode(tokens).alias("token_"))
    pairs = mine.join(other, [*same, "token_"]).groupBy("new_key").agg(F.min("old_key").alias(key), F.min(links).alias("links_"))
    best = pairs.groupBy(key).agg(F.min_by("links_", "new_key").alias("links_"))
    filled = old.join(best, key, "left").withColumn(links, F.when(F.col(links).isNull() | (F.size(links) == 0), F.coalesce("links_", links)).otherwise(F.col(links))).drop("links_")
    return filled, new.join(pairs.select(F.col("new_key").alias(key)), key, "left_anti")


def delete_missing_of_seen(old: DataFrame, arrived: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """old without keys that didn't arrive, but only in groups of which something arrived."""
    seen = old.join(arrived.select(group).distinct(), group, "left_semi").join(arrived.select(*keys).distinct(), keys, "left_semi")
    unseen = old.join(arrived.select(group).distinct(), group, "left_anti")
    return unseen.unionByName(seen)


def fill_absent(old: DataFrame, fetched: DataFrame, key: str, detail: str) -> DataFrame:
    """old with details fetched for keys that have none; ``fetched`` says which keys were asked for."""
    came = fetched.groupBy(key).agg(F.min(detail).alias("came_"))
    out = old.join(came, key, "left").withColumn("fetched", F.col(detail).isNull())
    return out.withColumn(detail, F.coalesce(detail, "came_")).drop("came_")
