import datetime
import time

import pytest
from pyspark.sql import functions as F

from lodeweave.operators.cache_table import CacheTable
from lodeweave.streaming import incremental, stateful

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "url string, content_hash string, word_count long, ts timestamp"


def row(url, h, n, minutes):
    return url, h, n, T0 + datetime.timedelta(minutes=minutes)


@pytest.fixture
def typed(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    stateful.use_typed_state(spark)
    yield spark
    spark.conf.set(name, before)


def batches(spark, tmp_path, made, names, parts, by_clock=False):
    """Run a stream over one file of rows after another, each in a run of its own from the same checkpoint."""
    out = []
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        query = made(stream).writeStream.foreachBatch(lambda df, _: out.extend(tuple(r[n] for n in names) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/check").start()
        if by_clock:  # a stream whose state expires by the clock never comes to an end by itself
            until, wanted = time.monotonic() + 120, len(out) + len(part)
            while len(out) < wanted and time.monotonic() < until and query.exception() is None:
                time.sleep(0.2)
        else:
            query.processAllAvailable()
        assert query.exception() is None
        query.stop()
    return out


def test_changes_in_order_of_time(typed, tmp_path):
    cache = typed.createDataFrame([row("c", "old", 5, -100), row("d", "same", 1, -50)], SCHEMA)
    first = [row("a", "h3", 30, 3), row("a", "h1", 10, 1), row("a", "h2", 20, 2), row("b", "x", 1, 1), row("c", "new", 9, 1), row("d", "same", 1, 2)]
    second = [row("a", "h1", 10, 4), row("a", "late", 1, 0), row("b", "x", 1, 5), row("e", "n", 1, 9)]
    got = batches(typed, tmp_path, lambda s: stateful.changes(s, cache), ["url", "change_type", "word_diff", "seen_before"], [first, second], by_clock=True)
    assert [g for g in got if g[0] == "a"] == [("a", "new", None, False), ("a", "modified", 10, False), ("a", "modified", 10, False), ("a", "outdated", None, False), ("a", "modified", -20, True)]
    assert [g for g in got if g[0] == "b"] == [("b", "new", None, False), ("b", "identical", None, True)]
    assert sorted((g for g in got if g[0] in "cde"), key=str) == [("c", "modified", 4, False), ("d", "identical", None, True), ("e", "new", None, False)]


def test_pages_expire_by_the_watermark(typed, tmp_path):
    day = 24 * 60
    got = batches(typed, tmp_path, lambda s: stateful.expiring(s, days=10), ["url", "event", "at"], [[row("a", "", 0, 0), row("b", "", 0, 0)], [row("a", "", 0, 5 * day)], [row("z", "", 0, 12 * day)], [row("z", "", 0, 30 * day)]])
    at = lambda d: T0 + datetime.timedelta(days=d)
    assert [g for g in got if g[1] == "expired" and g[0] in "ab"] == [("b", "expired", at(10)), ("a", "expired", at(15))]
    assert [g for g in got if g[0] == "a" and g[1] == "stored"] == [("a", "stored", at(0)), ("a", "stored", at(5))]


def test_a_stream_into_the_cache_by_url(spark, tmp_path):
    """The cache's table folds what the stream puts beside it; a batch that runs again changes nothing."""
    table = CacheTable(spark, f"file://{tmp_path}/cache", "url string, content_hash string, word_count bigint, last_scraped timestamp", buckets=2, puts=2)
    for k in range(4):
        spark.createDataFrame([row(f"u{i}", f"h{k}", k, k) for i in range(k, k + 3)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in").withColumnRenamed("ts", "last_scraped")
        query = incremental.upsert_table(stream, table, f"{tmp_path}/check").trigger(availableNow=True).start()
        assert query.awaitTermination(180) and query.exception() is None
    want = {f"u{i}": f"h{min(i, 3)}" for i in range(6)}
    assert {r.url: r.content_hash for r in table.current().collect()} == want
    table.put(spark.createDataFrame([row(f"u{i}", "h3", 3, 3) for i in range(3, 6)], SCHEMA).select("url", "content_hash", "word_count", F.col("ts").alias("last_scraped")))
    assert {r.url: r.content_hash for r in table.current().collect()} == want and len(table.versions.additions()) < 2
