"""Streaming forms of two ingest operators: activity by window, and turns from unavailable to available."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def activity_by_window(events: DataFrame, lateness: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts by type in event-time windows; rows later than the watermark are left out."""
    seen = events.withWatermark("ts", lateness).groupBy(F.window("ts", size), "event_type")
    return seen.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def restocks(snapshots: DataFrame) -> DataFrame:
    """snapshots (offer, seq, available): a row for each turn to available, state kept by offer between batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        there = rows["available"].astype(bool).to_numpy()
        first = state.get[0] if state.exists else there[0]  # without a row before there is no turn
        before = np.concatenate([[first], there[:-1]])
        turned = rows["seq"].to_numpy()[there & ~before]
        state.update((bool(there[-1]),))
        yield pd.DataFrame({"offer": np.full(len(turned), key[0]), "seq": turned}).astype({"offer": "int64", "seq": "int64"})

    return snapshots.groupBy("offer").applyInPandasWithState(step, "offer long, seq long", "available boolean", "append", GroupStateTimeout.NoTimeout)
