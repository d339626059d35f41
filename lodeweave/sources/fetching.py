"""Fetching pages by table: one try or several, hosts at their own pace, as a batch, or as a stream over a plan.

`fetch_table` deals urls by host into slots of bounded size; a slot is fetched in input order at
its share of the host's rate, and failed urls come back later as long as the slot's retries last.
A task keeps a few requests in flight and no more than a window of urls in memory; urls never pass
through the driver. A lost executor's slots are fetched again, so what must not be asked twice is
written (`live_crawl` does so).

`PlanSource` is the same as a stream: a plan is a folder of batches, offsets count batches, and a
micro-batch reads the plan's files where they are.
"""

from __future__ import annotations

import heapq
import itertools
import random
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lodeweave.functions import retry as R
from lodeweave.functions import urls as U
from lodeweave.session import finished_versions, written

#: Seconds that a page, and a PDF, may take.
PAGE_TIMEOUT, PDF_TIMEOUT = 30.0, 60.0
FETCHED = "url string, status_code int, html string, content binary, success boolean, error_message string, error_type string, attempts int, timestamp string"
#: Urls of a host that one slot has, and urls that a task holds at a time, at most.
SLOT_URLS, IN_HAND = 20_000, 512


def error_class(error: Exception) -> tuple[str, int | None]:
    """What kind of failure a fetch had (connection, timeout, response or other), and the status of a response."""
    import urllib.error

    if isinstance(error, urllib.error.HTTPError):
        return "response", error.code
    if isinstance(error, TimeoutError) or isinstance(getattr(error, "reason", None), TimeoutError):
        return "timeout", None
    return ("connection", None) if isinstance(error, OSError) else ("other", None)


class Fetcher:
    """Fetches a url; only status 200 is a success, and a failed fetch is a row.

    Options: delay (seconds before a try), timeout, userAgent, binary (bytes in `content` instead of text in `html`), and
    retryMode: `linear` tries `retries` times whatever went wrong and waits retryDelay * number of tries; `exponential` tries
    again only after connection failures, timeouts and server errors, and waits initialDelay * exponentialBase ** tries, maxDelay
    at most, times a random number from 0.5 to 1.5 unless jitter is false; `once` doesn't try again and takes every 2xx.
    """

    def __init__(self, options: dict[str, object]):
        get = lambda name, default: str(options.get(name, default))
        self.mode = get("retryMode", "linear")
        if self.mode not in ("linear", "exponential", "once"):
            raise ValueError(f"unknown retry mode: {self.mode}")
        config = R.RetryConfig()
        self.retries = 1 if self.mode == "once" else int(get("retries", config.max_retries))
        self.retry_delay, self.delay = float(get("retryDelay", 2)), float(get("delay", 2))
        self.initial, self.base, self.most = float(get("initialDelay", config.initial_delay)), float(get("exponentialBase", config.exponential_base)), float(get("maxDelay", config.max_delay))
        self.jitter, self.binary = get("jitter", config.jitter).lower() == "true", get("binary", False).lower() == "true"
        self.timeout, self.agent = float(get("timeout", PDF_TIMEOUT if self.binary else PAGE_TIMEOUT)), get("userAgent", "lodeweave")

    def wait(self, tries: int) -> float:
        """Seconds after so many failed tries."""
        if self.mode == "linear":
            return self.retry_delay * tries
        return min(self.initial * self.base ** (tries - 1), self.most) * (random.random() + 0.5 if self.jitter else 1.0)

    def attempt(self, url: str, tries: int = 1) -> tuple[tuple, bool]:
        """A row of FETCHED from one try, and whether another one is worth it."""
        import urllib.error
        import urllib.request

        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": self.agent}), timeout=self.timeout) as r:
                if r.status != 200 and self.mode != "once":
                    raise urllib.error.HTTPError(url, r.status, r.reason, r.headers, None)
                body = r.read()
                page = None if self.binary else body.decode(r.headers.get_content_charset() or "utf-8", "replace")
                return (url, r.status, page, body if self.binary else None, True, None, None, tries, datetime.now(UTC).isoformat()), False
        except Exception as e:
            kind, status = error_class(e)
            again = tries < self.retries and (self.mode == "linear" or R.worth_another_try(kind, status))
            message = f"HTTP error: {status}" if kind == "response" else f"Error: {e}"
            return (url, status, None, None, False, message, R.name_of_error(kind, status), tries, datetime.now(UTC).isoformat()), again

    def fetch(self, url: str) -> tuple:
        for tries in itertools.count(1):
            time.sleep(self.delay)
            row, again = self.attempt(url, tries)
            if not again:
                return row
            time.sleep(self.wait(tries))
        raise AssertionError


class Courier:
    """Fetches (key, url) pairs: urls of one key in order and at least `gap` seconds apart, different keys side by side.

    A url that is worth another try comes back when its wait is over, as long as its key has retries left; nothing else waits for it.
    """

    def __init__(self, fetcher: Fetcher, gap: Callable[[object], float], concurrency: int = 8, budget: int = 1000, in_hand: int = IN_HAND):
        self.fetcher, self.gap, self.concurrency, self.budget, self.in_hand = fetcher, gap, max(1, concurrency), budget, in_hand

    def run(self, urls: Iterable[tuple[object, object, str]]) -> Iterator[tuple[object, tuple]]:
        """(tag, row of FETCHED) of each (key, tag, url), as they are done."""
        source, free, left = iter(urls), {}, {}
        queue: list[tuple[float, int, object, object, str, int]] = []
        flying: dict[Future, tuple] = {}
        number, exhausted = itertools.count(), False

        def put(key: object, tag: object, url: str, tries: int, not_before: float) -> None:
            due = max(not_before, free.get(key, 0.0))
            free[key] = due + self.gap(key)
            heapq.heappush(queue, (due, next(number), key, tag, url, tries))

        with ThreadPoolExecutor(self.concurrency) as pool:
            while True:
                while not exhausted and len(queue) + len(flying) < self.in_hand:
                    item = next(source, None)
                    if item is None:
                        exhausted = True
                    else:
                        put(*item, 1, time.monotonic())
                while queue and len(flying) < self.concurrency and queue[0][0] <= time.monotonic():
                    _, _, key, tag, url, tries = heapq.heappop(queue)
                    flying[pool.submit(self.fetcher.attempt, url, tries)] = key, tag, url, tries
                if not flying and not queue:
                    return
                pause = max(0.0, queue[0][0] - time.monotonic()) if queue and len(flying) < self.concurrency else None
                if not flying:
                    time.sleep(pause or 0.0)
                    continue
                for done in wait(flying, timeout=pause, return_when=FIRST_COMPLETED).done:
                    key, tag, url, tries = flying.pop(done)
                    row, again = done.result()
                    if again and left.setdefault(key, self.budget) > 0:
                        left[key] -= 1
                        put(key, tag, url, tries + 1, time.monotonic() + self.fetcher.wait(tries))
                    else:
                        yield tag, row


def in_slots(urls: DataFrame, slot_urls: int = SLOT_URLS) -> DataFrame:
    """`urls` (url, position) with host, slot, slots and place: a host's urls in slots of about `slot_urls`, in order of position."""
    rows = urls.withColumn("host", F.lower(U.netloc(F.col("url"))))
    sizes = rows.groupBy(F.col("host").alias("_host")).agg(F.ceil(F.count("*") / slot_urls).alias("slots"))
    rows = rows.join(sizes, F.col("host").eqNullSafe(F.col("_host"))).withColumn("slot", F.pmod(F.xxhash64("position"), F.col("slots"))).drop("_host")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("host", "slot").orderBy("position")))  # a slot's size is bounded


def fetch_table(urls: DataFrame, rate: float = 0.5, concurrency: int = 8, budget: int = 1000, slot_urls: int = SLOT_URLS, partitions: int | None = None, **options: object) -> DataFrame:
    """(position, and FETCHED) of every row of `urls` (url, and optionally position: its place in the order).

    rate: urls a second that any host is asked for, all tasks together. budget: tries beyond the first that a slot has.
    Without `position` the order of the table's files counts. A null url is a failed row.
    """
    if "position" not in urls.columns:
        urls = written(urls.select("url"), "urls").withColumn("position", F.monotonically_increasing_id())
    known = in_slots(urls.where("url IS NOT NULL").select("url", "position"), slot_urls)
    n = partitions or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A slot is in one task, and the slots of a task take turns.
    dealt = known.repartition(n, "host", "slot").sortWithinPartitions("place", "host", "slot").select("position", "url", "host", "slot", "slots")
    fields = T.StructType.fromDDL(f"position long, {FETCHED}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        courier, schema = Courier(Fetcher(options), lambda key: key[2] / rate if rate > 0 else 0.0, concurrency, budget), to_arrow_schema(fields)
        rows = (((h, s, k), p, u) for b in batches for p, u, h, s, k in zip(*(b.column(c).to_pylist() for c in ("position", "url", "host", "slot", "slots")), strict=True))
        results = courier.run(rows)
        while part := list(itertools.islice(results, 64)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*((tag, *row) for tag, row in part), strict=True), schema, strict=True)], schema=schema)

    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields.fields[1:]]
    missing = urls.where("url IS NULL").select("position", *nothing)
    missing = missing.withColumns({"success": F.lit(False), "error_message": F.lit("no url"), "error_type": F.lit(R.name_of_error("other", None)), "attempts": F.lit(0)})
    return dealt.mapInArrow(run, fields).unionByName(missing)


# A stream over a plan

PLAN = "position long, url string, host string, slot long, slots long"


def add_to_plan(urls: DataFrame, path: str, slot_urls: int = SLOT_URLS) -> int:
    """Append urls (url, and optionally position) as the plan's next batch, dealt by host; its number. A batch counts once it is whole."""
    if "position" not in urls.columns:
        urls = written(urls.select("url"), "urls").withColumn("position", F.monotonically_increasing_id())
    done = finished_versions(urls.sparkSession, path, "batch=")
    number = done[-1] + 1 if done else 0
    rows = in_slots(urls.where("url IS NOT NULL").select("url", "position"), slot_urls)
    rows.repartition("host", "slot").sortWithinPartitions("place", "host", "slot").select("position", "url", "host", "slot", "slots").write.mode("overwrite").parquet(f"{path}/batch={number}")
    return number


class _PlanFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PlanReader(DataSourceStreamReader):
    """Offsets are numbers of the plan's finished batches; a partition is one file of them.

    maxBatches: how many of them a micro-batch takes at most; 0, the default, takes all that there are, which `availableNow` needs.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.options = options["path"].rstrip("/"), dict(options)
        self.rate, self.most = float(options.get("rate", "0.5")), int(options.get("maxBatches", "0"))
        self.concurrency, self.budget = int(options.get("concurrency", "8")), int(options.get("budget", "1000"))
        self.from_ = 0

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def _finished(self) -> int:
        from pyarrow import fs

        system, root = self._system()
        n = 0
        while system.get_file_info(f"{root}/batch={n}/_SUCCESS").type == fs.FileType.File:
            n += 1
        return n

    def initialOffset(self) -> dict:
        return {"batches": 0}

    def latestOffset(self) -> dict:
        done = self._finished()
        return {"batches": min(done, self.from_ + self.most) if self.most else done}

    def partitions(self, start: dict, end: dict) -> list[_PlanFile]:
        from pyarrow import fs

        system, root = self._system()
        self.from_ = end["batches"]
        out = []
        for n in range(start["batches"], end["batches"]):
            found = system.get_file_info(fs.FileSelector(f"{root}/batch={n}"))
            out += [_PlanFile(f.path) for f in sorted(found, key=lambda f: f.path) if f.base_name.startswith("part-")]
        return out

    def commit(self, end: dict) -> None:
        self.from_ = max(self.from_, end["batches"])

    def read(self, partition: _PlanFile) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        system, _ = self._system()
        with system.open_input_file(partition.path) as file:
            rows = (((r["host"], r["slot"], r["slots"]), r["position"], r["url"]) for b in pq.ParquetFile(file).iter_batches(1000) for r in b.to_pylist())
            courier = Courier(Fetcher(self.options), lambda key: key[2] / self.rate if self.rate > 0 else 0.0, self.concurrency, self.budget)
            for position, row in courier.run(rows):
                yield (position, *row)


class PlanSource(DataSource):
    """spark.dataSource.register(PlanSource); spark.readStream.format("fetches").option("path", ...).load(): FETCHED with position, for each url of the plan."""

    @classmethod
    def name(cls) -> str:
        return "fetches"

    def schema(self) -> str:
        return f"position long, {FETCHED}"

    def streamReader(self, schema) -> PlanReader:
        options = {k: v for k, v in self.options.items()}
        known = {k.lower(): k for k in ("path", "rate", "maxBatches", "concurrency", "budget", "delay", "timeout", "userAgent", "binary", "retryMode", "retries", "retryDelay", "initialDelay", "exponentialBase", "maxDelay", "jitter")}
        return PlanReader({known.get(k.lower(), k): v for k, v in options.items()})


def fetched_stream(spark: SparkSession, plan: str, **options: object) -> DataFrame:
    """The plan's pages as they are fetched; written by `streaming.incremental.upsert_cache`, each is in the cache once, also after a restart."""
    spark.dataSource.register(PlanSource)
    return spark.readStream.format("fetches").options(path=plan, **options).load()
