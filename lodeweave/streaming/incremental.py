"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodeweave.functions import text as T
from lodeweave.operators.cache_table import CacheTable


def unique_pages(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """The first page of each content hash; hashes are forgotten behind the watermark on ts."""
    return stream.withWatermark("ts", watermark).withColumn("content_hash", T.dedupe_hash(F.col("content"))).dropDuplicatesWithinWatermark(["content_hash"])


def rolling_metrics(stream: DataFrame, size: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """Fetches, failures and mean response time by window of ts."""
    by = stream.withWatermark("ts", watermark).groupBy(F.window("ts", size).alias("w"))
    return by.agg(F.count("*").alias("fetched"), F.count_if(~F.col("success")).alias("failed"), F.avg("response_time").alias("avg_response_time")).select(F.col("w.start").alias("start"), "fetched", "failed", "avg_response_time")


def changes(stream: DataFrame) -> DataFrame:
    """Each page (url, content_hash, word_count) against the last seen of its url: new, identical or modified."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        out = []
        for batch in batches:
            for h, n in zip(batch["content_hash"], batch["word_count"], strict=True):
                n = int(n)
                kind = "new" if last is None else "identical" if last[0] == h else "modified"
                out.append((key[0], kind, n - last[1] if kind == "modified" else None))
                last = (h, n)
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=["url", "change_type", "word_diff"])

    return stream.groupBy("url").applyInPandasWithState(run, "url string, change_type string, word_diff long", "content_hash string, word_count long", "append", GroupStateTimeout.NoTimeout)


def upsert_cache(stream: DataFrame, path: str, checkpoint: str, order: list[str] | None = None):
    """Every micro-batch is appended to the cache's history as `batch=<id>`, so a batch costs what it holds; `current` reads the last row of each url.

    A batch that runs again replaces its own rows. With a new checkpoint give a new path: batches are numbered from 0.
    """
    keys = order or ["last_scraped"]

    def upsert(batch: DataFrame, epoch: int) -> None:
        from lodeweave.operators import cache as C

        C.latest(batch, keys).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)


def upsert_table(stream: DataFrame, table: CacheTable, checkpoint: str):
    """Every micro-batch is put into a cache that is laid out by url and compacts itself; a batch that runs again puts the same rows, which changes nothing."""
    return stream.writeStream.foreachBatch(lambda batch, epoch: table.put(batch)).option("checkpointLocation", checkpoint)


def current(cache: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The cache as it stands: of a history (with its column batch) the last row of each url; of equal times the later batch holds."""
    from lodeweave.operators import cache as C

    return C.latest(cache, [*(order or ["last_scraped"]), "batch"]).drop("batch")


def chat_memory(stream: DataFrame, cap: int = 100) -> DataFrame:
    """The memory of every conversation after each micro-batch: its last `cap` messages of people and assistants, as (conv_id, n, last_turn, messages).

    Messages (conv_id, turn, role, text) are remembered in order of turn within a batch, batches in order of arrival.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in json.loads(state.get[0])] if state.exists else []
        new = pd.concat(list(batches)).sort_values("turn", kind="stable")
        held = (held + [(int(t), r, m) for t, r, m in zip(new["turn"], new["role"], new["text"], strict=True)])[-cap:]
        state.update((json.dumps(held),))
        yield pd.DataFrame([(key[0], len(held), held[-1][0], [f"{r}: {m}" for _, r, m in held])], columns=["conv_id", "n", "last_turn", "messages"])

    people = stream.where(F.col("role").isin("user", "assistant"))
    return people.groupBy("conv_id").applyInPandasWithState(run, "conv_id long, n int, last_turn long, messages array<string>", "held string", "update", GroupStateTimeout.NoTimeout)


def expiring(stream: DataFrame, days: int = 90, watermark: str = "0 seconds") -> DataFrame:
    """(url, event, at) of cached pages (url, ts): `stored` when a page is seen, and `expired` once the watermark on ts is `days` beyond its last sight."""
    life = days * 86_400_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame([(key[0], "expired", pd.Timestamp(last + life, unit="ms"))], columns=["url", "event", "at"])
            return
        seen = [int(t.timestamp() * 1000) for batch in batches for t in batch["ts"]]
        last = max([*seen, *([state.get[0]] if state.exists else [])])
        state.update((last,))
        if last + life > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(last + life)
        yield pd.DataFrame([(key[0], "stored", pd.Timestamp(last, unit="ms"))], columns=["url", "event", "at"])

    return stream.withWatermark("ts", watermark).groupBy("url").applyInPandasWithState(run, "url string, event string, at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def without_expired(cache: DataFrame, now: Column, days: int = 90) -> DataFrame:
    from lodeweave.operators.cache import without_older

    return without_older(cache, now, days)
