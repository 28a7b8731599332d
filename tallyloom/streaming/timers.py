"""Streams with event-time timers: turns in the order of events whatever their arrival, and notices told once.

State is kept by key in the state store (which must be the RocksDB one) and comes back after a restart. What the watermark
has passed is final: rows later than it are left out by Spark.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def _millis(moment) -> int:
    """Milliseconds of a moment in UTC, rounded up, so that a timer never comes before it."""
    return -(-pd.Timestamp(moment).tz_localize("UTC").value // 1_000_000) if pd.Timestamp(moment).tzinfo is None else -(-pd.Timestamp(moment).value // 1_000_000)


class _Turns(StatefulProcessor):
    """Holds rows until the watermark has passed them, and then tells the turns to available in the order of time and seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "at long, seq long, available boolean")
        self._last = handle.getValueState("last", "available boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            at = [_millis(t) for t in pdf["ts"]]
            self._waiting.appendList(list(zip(at, pdf["seq"].astype(int).tolist(), pdf["available"].astype(bool).tolist(), strict=True)))
            for t in set(at):
                self._handle.registerTimer(t)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(r) for r in self._waiting.get()] if self._waiting.exists() else []
        ready = sorted(r for r in waiting if r[0] <= until)
        if ready:  # an earlier timer of the batch may have taken them
            self._waiting.put([r for r in waiting if r[0] > until]) if len(ready) < len(waiting) else self._waiting.clear()
            there = self._last.get()[0] if self._last.exists() else ready[0][2]  # without a row before there is no turn
            turned = []
            for _, seq, available in ready:
                if available and not there:
                    turned.append(seq)
                there = available
            self._last.update((there,))
            if turned:
                yield pd.DataFrame({"offer": [key[0]] * len(turned), "seq": turned})


def restocks_by_time(snapshots: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """snapshots (offer, ts, seq, available): a row for each turn to available in the order of ts and seq, once no earlier row can come."""
    keyed = snapshots.withWatermark("ts", lateness).groupBy("offer")
    return keyed.transformWithStateInPandas(_Turns(), "offer long, seq long", "Append", "EventTime")


class _Notices(StatefulProcessor):
    """Keeps the last known end of each key and tells once when it is near."""

    def __init__(self, lead_ms: int):
        self._lead = lead_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._end = handle.getValueState("end", "said long, seq long, ends long")
        self._told = handle.getValueState("told", "told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = tuple(self._end.get()) if self._end.exists() else None
        for pdf in rows:
            for ts, seq, ends in zip(pdf["ts"], pdf["seq"], pdf["ends"], strict=True):
                one = (_millis(ts), int(seq), _millis(ends))
                best = one if best is None or one > best else best
        if best is not None and not self._told.exists():
            self._end.update(best)
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(max(best[2] - self._lead, best[0]))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self._told.exists():
            self._told.update((True,))
            ends = self._end.get()[2]
            self._end.clear()
            yield pd.DataFrame({"code": [key[0]], "ends": [pd.Timestamp(ends, unit="ms")]})


def expiry_notices(codes: DataFrame, lead: dt.timedelta, lateness: str = "10 minutes") -> DataFrame:
    """codes (code, ts, seq, ends): one row for each code when the watermark comes within ``lead`` of the end that was last said.

    A code is told once, whatever is said of it afterwards; an end that moves away before it is told moves the notice.
    """
    keyed = codes.withWatermark("ts", lateness).groupBy("code")
    return keyed.transformWithStateInPandas(_Notices(int(lead.total_seconds() * 1000)), "code string, ends timestamp_ntz", "Append", "EventTime")
