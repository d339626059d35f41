import threading
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodeweave.functions import retry as R
from lodeweave.operators import crawl, live_crawl
from lodeweave.sources import fetching
from lodeweave.streaming import incremental


class Site:
    """A web server on this machine; notes what it was asked and when."""

    def __init__(self):
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

        site = self
        self.asked, self.pages = [], {}

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                site.asked.append((time.monotonic(), self.headers["Host"], self.path))
                seen = sum(p == self.path for _, _, p in site.asked) if self.path.startswith("/flaky") else 0
                status, body = site.pages.get(self.path, (200, f"page {self.path}"))
                if self.path.startswith("/flaky") and seen < 3 or self.path.startswith("/down"):
                    status, body = 503, ""
                data = body.encode()
                self.send_response(status)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *args):
                pass

        class Server(ThreadingHTTPServer):
            request_queue_size = 256

        self.server = Server(("127.0.0.1", 0), Handler)
        self.port = self.server.server_port
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


@pytest.fixture
def site():
    s = Site()
    yield s
    s.server.shutdown()


QUICK = {"delay": 0, "retryDelay": 0.01, "initialDelay": 0.01, "timeout": 5}


def test_ten_thousand_urls_of_two_hosts(spark, site):
    hosts = [f"127.0.0.1:{site.port}", f"localhost:{site.port}"]
    urls = spark.range(10_000).select(F.concat(F.lit("http://"), F.when(F.col("id") % 3 == 0, hosts[1]).otherwise(hosts[0]), F.lit("/p/"), F.col("id").cast("string")).alias("url"), F.col("id").alias("position"))
    out = fetching.fetch_table(urls, rate=0, concurrency=8, slot_urls=2000, retryMode="once", timeout=20).select("position", "url", "success", "html").collect()
    assert len(out) == 10_000 and {r.position for r in out} == set(range(10_000)) and all(r.success for r in out)
    assert all(r.html == f"page /p/{r.position}" and r.url.endswith(f"/p/{r.position}") for r in out)
    assert Counter(h for _, h, _ in site.asked) == {hosts[0]: 6666, hosts[1]: 3334}


def test_rate_order_and_retries(spark, site):
    hosts = [f"127.0.0.1:{site.port}", f"localhost:{site.port}"]
    rows = [(f"http://{hosts[i % 2]}/a/{i}", i) for i in range(40)] + [(None, 40), (f"http://{hosts[0]}/flaky", 41), (f"http://{hosts[0]}/down", 42), ("http://127.0.0.1:9/x", 43)]
    began = time.monotonic()
    urls = spark.createDataFrame(rows, "url string, position long")
    out = {r.position: r for r in fetching.fetch_table(urls, rate=20, retryMode="exponential", **QUICK).collect()}
    assert time.monotonic() - began > 20 / 20
    assert all(out[i].success and out[i].attempts == 1 for i in range(40))
    assert (out[40].success, out[40].error_type, out[40].attempts) == (False, "unknown_error", 0)
    assert (out[41].success, out[41].attempts) == (True, 3) and (out[42].error_type, out[42].attempts) == ("server_error", 3) and out[43].error_type == "connection_error"
    for host in hosts:
        first = [p for _, h, p in site.asked if h == host and p.startswith("/a/")]
        assert first == sorted(first, key=lambda p: int(p[3:]))  # input order
        at = sorted(t for t, h, _ in site.asked if h == host)
        assert all(b - a > 0.01 for a, b in zip(at, at[5:], strict=False)) and at[-1] - at[0] > (len(at) - 1) / 20 * 0.8
    # A host's slots share its rate.
    site.asked.clear()
    many = spark.createDataFrame([(f"http://{hosts[0]}/b/{i}", i) for i in range(30)], "url string, position long")
    assert fetching.fetch_table(many, rate=30, slot_urls=10, retryMode="once", **QUICK).where("success").count() == 30
    at = [t for t, _, _ in site.asked]
    assert max(at) - min(at) > 0.6


def test_retry_budget_and_jitter(spark, site):
    fetcher = fetching.Fetcher({"retryMode": "exponential", **QUICK})
    rows = [("k", i, f"http://127.0.0.1:{site.port}/down/{i}") for i in range(6)]
    out = list(fetching.Courier(fetcher, lambda key: 0.0, budget=3).run(rows))
    assert sum(row[7] for _, row in out) == 6 + 3 and len(out) == 6
    waits = [fetching.Fetcher({"retryMode": "exponential", "initialDelay": 1}).wait(2) for _ in range(200)]
    assert min(waits) >= 1.0 and max(waits) <= 3.0 and max(waits) - min(waits) > 1.0
    assert fetching.Fetcher({"retryMode": "exponential", "initialDelay": 1, "jitter": "false"}).wait(7) == 60.0
    assert fetching.Fetcher({"retryDelay": 2}).wait(3) == 6.0


def test_error_names_are_the_same_in_both_forms(spark):
    cases = [(k, s) for k in ("connection", "timeout", "response", "other") for s in (None, 200, 201, 403, 404, 418, 429, 499, 500, 599, 600)]
    rows = spark.createDataFrame(cases, "kind string, status int").select("kind", "status", R.error_name(F.col("kind"), F.col("status")).alias("name"), R.is_retryable(F.col("kind"), F.col("status")).alias("again")).collect()
    for r in rows:
        if r.kind != "response" or r.status is not None:
            assert r.name == R.name_of_error(r.kind, r.status) and r.again == R.worth_another_try(r.kind, r.status)


def graph(site, n=23):
    """A site of n pages with links to two others each, a file, an address elsewhere and broken pages."""
    root = f"http://127.0.0.1:{site.port}"
    edges = defaultdict(list)
    for i in range(n):
        links = [f"/p/{(2 * i + 1) % n}", f"{root}/p/{(3 * i + 2) % n}?x=1#part", f"/files/{i % 5}.pdf", "https://elsewhere.test/a", "style.css"]
        site.pages[f"/p/{i}"] = (404 if i in (7, 8) else 200, "".join(f'<a href="{h}">x</a>' for h in links))
        site.pages[f"/p/{i}?x=1"] = site.pages[f"/p/{i}"]
        if i not in (7, 8):
            for page in (f"{root}/p/{i}", f"{root}/p/{i}?x=1"):
                edges[page] = [f"{root}/p/{(2 * i + 1) % n}", f"{root}/p/{(3 * i + 2) % n}?x=1", f"{root}/files/{i % 5}.pdf"]
    return root, edges


def test_a_stopped_crawl_goes_on(spark, site, tmp_path, monkeypatch):
    monkeypatch.setattr(live_crawl, "COMPACT", 2)
    root, edges = graph(site)
    domains = [f"127.0.0.1:{site.port}"]
    fetch = lambda urls: fetching.fetch_table(urls, rate=0, retryMode="once", **QUICK)
    made = lambda name, **more: live_crawl.LiveCrawl(spark, f"file://{tmp_path}/{name}", [f"{root}/p/0"], domains, fetch, **more)
    rows = lambda df: sorted((r.url, r.depth, r.kind) for r in df.collect())
    whole = rows(made("whole").run())
    pairs = spark.createDataFrame([(a, b) for a, bs in edges.items() for b in bs], "src string, dst string")
    assert whole == rows(crawl.crawl(pairs, f"{root}/p/0", domains)) and len(whole) > 20
    assert Counter(p for _, _, p in site.asked).most_common(1)[0][1] == 1  # no page twice
    made("part").run(5)  # stopped in the middle of a step: what it left behind doesn't count
    half = tmp_path / "part"
    last = max(half.glob("round=*"), key=lambda p: int(p.name[6:]))
    (next(p for p in (last / "links", last / "pages", last / "frontier") if p.exists()) / "_SUCCESS").unlink()
    again = made("part")
    assert rows(again.run()) == whole and rows(again.run()) == whole
    assert sorted(r.url for r in again.pages().where("NOT success").collect()) == sorted(u for u, _, k in whole if k == "page" and u.split("/p/")[-1].split("?")[0] in ("7", "8"))
    few = made("few", max_pages=9)
    few.run()
    assert few.pages().where("success").count() == 9
    barred = made("barred", allowed=lambda urls: urls.where("url NOT LIKE '%x=1%'"))
    assert not [u for u, _, _ in rows(barred.run()) if "x=1" in u]


def test_a_stream_of_fetches_restarts_where_it_was(spark, site, tmp_path):
    plan, cache = f"file://{tmp_path}/plan", f"file://{tmp_path}/cache"
    urls = lambda lo, hi: spark.createDataFrame([(f"http://127.0.0.1:{site.port}/s/{i}", i) for i in range(lo, hi)], "url string, position long")
    assert fetching.add_to_plan(urls(0, 12), plan) == 0 and fetching.add_to_plan(urls(12, 20), plan) == 1

    def run(**more):
        stream = fetching.fetched_stream(spark, plan, rate=0, retryMode="once", **QUICK, **more).withColumnRenamed("timestamp", "last_scraped").select("url", "html", "success", "last_scraped")
        query = incremental.upsert_cache(stream, cache, f"{tmp_path}/checkpoint")
        if more:
            query = query.start()
            query.processAllAvailable()
            query.stop()
        else:
            query = query.trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None

    run()
    assert spark.read.parquet(cache).count() == 20 and len(site.asked) == 20
    assert fetching.add_to_plan(urls(20, 23), plan) == 2 and fetching.add_to_plan(urls(23, 25), plan) == 3
    (tmp_path / "plan" / "batch=4").mkdir()  # an unfinished batch
    run(maxBatches=1)
    rows = spark.read.parquet(cache).collect()
    assert Counter(r.url for r in rows) == {f"http://127.0.0.1:{site.port}/s/{i}": 1 for i in range(25)} and len(site.asked) == 25
    assert len({r.batch for r in rows}) == 3
