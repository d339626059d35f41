"""Change detection and expiry on a stream with typed state: values, maps, timers, a start from the cache, and a time to live.

These need the state store that keeps typed state: `use_typed_state` sets it for a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000
CHANGES = "url string, ts timestamp, change_type string, word_diff long, seen_before boolean"
EVENTS = "url string, event string, at timestamp"


def use_typed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Changes(StatefulProcessor):
    """The last page of each url, and when each of its contents was first seen."""

    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "content_hash string, word_count long, micros long", self.ttl)
        self.seen = handle.getMapState("seen", "content_hash string", "micros long", self.ttl)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        row = initialState.sort_values("ts", kind="stable").iloc[-1]
        at = int(row["ts"].value // 1000)
        self.last.update((row["content_hash"], int(row["word_count"]), at))
        self.seen.updateValue((row["content_hash"],), (at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "content_hash"], kind="stable")
        last = self.last.get() if self.last.exists() else None
        out = []
        for h, n, ts in zip(new["content_hash"], new["word_count"], new["ts"], strict=True):
            at, n, before = int(ts.value // 1000), int(n), self.seen.containsKey((h,))
            if last is not None and at < last[2]:  # an earlier batch has brought a later page
                out.append((key[0], ts, "outdated", None, before))
            else:
                kind = "new" if last is None else "identical" if last[0] == h else "modified"
                out.append((key[0], ts, kind, n - last[1] if kind == "modified" else None, before))
                last = (h, n, at)
            if not before:
                self.seen.updateValue((h,), (at,))
        self.last.update(last)
        frame = pd.DataFrame(out, columns=["url", "ts", "change_type", "word_diff", "seen_before"])
        yield frame.astype({"word_diff": "Int64"})

    def close(self) -> None:
        pass


def changes(stream: DataFrame, cache: DataFrame | None = None, days: int | None = 90) -> DataFrame:
    """Every page (url, content_hash, word_count, ts) against the last of its url, in order of ts within a micro-batch.

    change_type: new, identical, modified, or outdated for one that is older than what an earlier micro-batch brought; seen_before:
    whether the url ever had this content. cache: rows of the same columns that are known at the start. days: how long a
    url's state lives after its last change.
    """
    start = None if cache is None else cache.select("url", "content_hash", "word_count", "ts").groupBy("url")
    rows = stream.select("url", "content_hash", "word_count", "ts").groupBy("url")
    return rows.transformWithStateInPandas(_Changes(None if days is None else days * DAY), CHANGES, "Append", "ProcessingTime", initialState=start)


class _Expiry(StatefulProcessor):
    """When each url was last seen, with a timer for when that is too long ago."""

    def __init__(self, life: int):
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "millis long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        known = self.last.get()[0] if self.last.exists() else None
        latest = max(int(ts.value // 1_000_000) for part in rows for ts in part["ts"])
        if known is None or latest > known:
            if known is not None:
                self.handle.deleteTimer(known + self.life)
            self.last.update((latest,))
            self.handle.registerTimer(latest + self.life)
            known = latest
        yield pd.DataFrame([(key[0], "stored", pd.Timestamp(known, unit="ms"))], columns=["url", "event", "at"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame([(key[0], "expired", pd.Timestamp(last + self.life, unit="ms"))], columns=["url", "event", "at"])

    def close(self) -> None:
        pass


def expiring(stream: DataFrame, days: int = 90, watermark: str = "0 seconds") -> DataFrame:
    """(url, event, at): `stored` when a page (url, ts) is seen, and `expired` once the watermark is `days` beyond its last sight."""
    rows = stream.withWatermark("ts", watermark).select("url", "ts").groupBy("url")
    return rows.transformWithStateInPandas(_Expiry(days * DAY), EVENTS, "Append", "EventTime")
