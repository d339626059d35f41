import random
from datetime import datetime

from pyspark.sql import functions as F

from lodeweave.operators import cache as C
from lodeweave.operators import chunks, crawl, dedupe, metrics, retrieval
from lodeweave.plans import catalogue
from lodeweave.sources import files

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]


def greedy_spec(docs):
    """One document after another, as the operator's description has it."""

    def shingles(t):
        w = t.lower().split()
        return {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}

    kept, hashes, out = [], {}, {}
    for i, t in docs:
        key = t.lower().strip()
        mine = shingles(t)
        if key in hashes:
            out[i] = (False, hashes[key], "exact_duplicate")
            continue
        for j, other in kept:
            union = mine | other
            if (len(mine & other) / len(union) if union else 1.0) >= 0.85:
                out[i] = (False, j, "near_duplicate")
                break
        else:
            hashes[key] = i
            kept.append((i, shingles(t[:5000])))
            out[i] = (True, None, None)
    return out


def test_greedy_dedupe_against_one_by_one(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(60)) for _ in range(8)]
    docs = []
    for i in range(60):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
        docs.append((i, " ".join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    docs += [(60, ""), (61, "two words"), (62, "  "), (63, "another pair"), (64, "")]
    got = {r.id: (r.is_unique, r.duplicate_of, r.reason) for r in dedupe.greedy(spark.createDataFrame(docs, "id long, content string")).collect()}
    assert got == greedy_spec(docs)
    assert dedupe.greedy(spark.createDataFrame([], "id long, content string")).count() == 0


def test_two_equal_of_four(spark):
    docs = [(1, "the same text here"), (2, "the same text here"), (3, "something else entirely"), (4, "and one more document")]
    got = dedupe.statistics(dedupe.greedy(spark.createDataFrame(docs, "id long, content string"))).first()
    assert (got.total_seen, got.unique_urls) == (4, 3)


def test_packed_chunks(spark):
    cases = [
        ("", 10, 3, []),
        (". . ", 10, 3, []),
        (" one ", 10, 3, ["one"]),
        ("aaaa. bbbb. cccc", 10, 3, ["aaaa. bbbb", "bbb. cccc"]),
        ("aaaa. bbbb. cccc", 10, 0, ["aaaa. bbbb", "cccc"]),
        ("x" * 20 + ". y", 10, 3, ["x" * 20, "xxx. y"]),
        ("a. b. c. d", 4, 1, ["a. b", "b. c", "c. d"]),
    ]
    for text, size, overlap, want in cases:
        row = spark.createDataFrame([(text,)], "t string")
        assert row.select(chunks.packed(F.col("t"), size, overlap)).first()[0] == want


def test_paragraph_and_header_chunks(spark):
    text = "\n\n".join(f"Paragraph {i}. " * 12 for i in range(4))
    assert all(chunks.by_paragraphs(text, 500, 50, 100))
    assert chunks.by_paragraphs("short") == []
    assert chunks.by_paragraphs("a" * 250 + "\n\n" + "b" * 100, 300, 50, 200) == ["a" * 250 + "\n\n" + "a" * 50 + "\n\n" + "b" * 100]
    assert chunks.by_paragraphs("a" * 290 + "\n\n" + "b" * 20, 300, 0, 200) == ["a" * 290 + "\n\n" + "b" * 20]
    assert chunks.by_sentences("One. Two! Three?", 6, 3) == ["One.", "ne. Two!", "wo! Three?"]
    made = chunks.by_headers("intro " * 50 + "\n# A\n" + "body " * 60 + "\n## B\n\n# C\n" + "last " * 60)
    assert [(m["header"], m["header_level"]) for m in made] == [(None, 0), ("A", 1), ("C", 1)]
    rows = spark.createDataFrame([("u", "t", None), ("v", "t", text)], "url string, title string, content string")
    out = chunks.chunk_documents(chunks.exploded(rows, "content", preserve_headers=False).withColumnRenamed("content", "text"))
    assert out.where("original_url = 'u'").count() == 0 and out.where("url = 'v#chunk_0'").count() == 1


CACHE = "url string, content_hash string, last_scraped timestamp, success boolean, status_code int, category string, word_count int, metadata string"


def test_cache(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    old = datetime(2023, 10, 1)
    cache = spark.createDataFrame([("https://h/a", "h1", datetime(2024, 1, 31, 12), True, 200, "test", 10, None), ("https://h/news/b", "h2", old, True, 200, None, 0, "{}"), ("https://h/c", "h3", old, False, 500, "news", 5, None)], CACHE)
    urls = spark.createDataFrame([(u,) for u in ("https://h/a", "https://h/news/b", "https://h/c", "https://h/new1", "https://h/new2")], "url string")
    got = {r.url: (r.bucket, r.reason) for r in C.decide(urls, cache, now).collect()}
    assert got["https://h/a"] == ("skipped", "fresh_cache_0d") and got["https://h/news/b"] == ("expired", "expired_cache_123d")
    assert got["https://h/c"][0] == "failed_before" and got["https://h/new1"] == ("new", "new_url")
    assert {r.bucket for r in C.decide(urls, cache, now, force=True).collect()} == {"forced"}
    assert {r.url: r.score for r in C.prioritised(urls, cache, now).collect()} == {"https://h/a": 30, "https://h/news/b": 100, "https://h/c": 70, "https://h/new1": 80, "https://h/new2": 80}
    assert C.get(cache, "https://h/a").first().metadata == "{}"
    assert C.without_category(cache, "news").count() == 2 and C.without_older(cache, now).count() == 1 and C.without_url(cache, "https://h/a").count() == 2
    newer = spark.createDataFrame([("https://h/a", "h9", datetime(2024, 2, 1), True, 200, "test", 1, None)], CACHE)
    after = C.put(cache, newer, ["last_scraped"])
    assert after.count() == 3 and C.get(after, "https://h/a").first().content_hash == "h9"
    assert C.statistics(cache, now).first().asDict() == {"total": 3, "successful": 2, "failed": 1, "fresh": 1, "expired": 2}
    empty = C.statistics(cache.limit(0), now).first()
    assert empty.total == 0 and empty.fresh == 0


def walk(links, n, most):
    """Depths of the pages of a plain walk from page 0, nearest first, ties by url."""
    page = lambda i: f"https://g.test/p/{i}"
    want, layer, depth = {page(0): 0}, [0], 0
    while layer and len(want) < most:
        depth += 1
        layer = sorted({d for i in layer if i < n for d in links(i) if page(d) not in want}, key=page)[: most - len(want)]
        want |= {page(d): depth for d in layer}
    return want


def test_crawl_graph_walks_all_documents(spark, tmp_path):
    spark.range(5000).select(F.col("id").alias("doc_id")).write.parquet(str(tmp_path / "documents.parquet"))
    rows = catalogue.QUERIES["crawl_graph"](spark, str(tmp_path)).collect()
    assert {r.url: r.depth for r in rows} == walk(lambda i: (2 * i + 1, 3 * i + 2), 5000, 6000)


def test_crawl_at_its_limit_of_pages(spark):
    page = lambda i: f"https://g.test/p/{i}"
    edges = spark.createDataFrame([(page(i), page(d)) for i in range(5000) for d in (2 * i + 1, 2 * i + 2)], "src string, dst string")
    rows = crawl.crawl(edges, page(0), ["g.test"]).collect()
    assert len(rows) == 6000 and {r.url: r.depth for r in rows} == walk(lambda i: (2 * i + 1, 2 * i + 2), 5000, 6000)


def test_crawl(spark):
    edges = spark.createDataFrame([("https://a/1", "https://a/2#x"), ("https://a/2", "https://a/1"), ("https://a/2", "https://a/3.pdf"), ("https://a/2", "https://b/4"), ("https://a/3.pdf", "https://a/5"), ("https://a/2", "https://a/s.css"), ("https://a/2", "https://a/6")], "src string, dst string")
    got = {(r.url, r.depth, r.kind) for r in crawl.crawl(edges, "https://a/1", ["a"]).collect()}
    assert got == {("https://a/1", 0, "page"), ("https://a/2", 1, "page"), ("https://a/3.pdf", 2, "pdf"), ("https://a/6", 2, "page")}
    assert crawl.crawl(edges, "https://a/1", ["a"], max_pages=1).count() == 1


def test_metrics_and_memory(spark):
    log = spark.createDataFrame([(True, 0.5, 1024, "test", None), (False, 2.0, None, None, "Timeout")], "success boolean, response_time double, content_size int, category string, error string")
    m = metrics.fetch_metrics(log, F.lit(2.0)).first()
    assert (m.urls_crawled, m.success_rate, m.avg_content_size, m.crawl_rate) == (2, 50.0, 1024, 1.0)
    assert metrics.fetch_metrics(log.limit(0), F.lit(2.0)).first().success_rate == 0
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(6)] + [(1, 9, "system", "s")], "conv_id int, turn int, role string, text string")
    assert metrics.conversation_summary(turns).first().asDict() == {"conv_id": 1, "total": 6, "human": 3, "ai": 3}
    assert metrics.memory(turns, 4).count() == 4


def test_store_and_search(spark, tmp_path):
    embed = retrieval.hashing_embedder(32)
    docs = spark.createDataFrame([(f"https://h/{i}", f"t{i}", "c", f"text number {i}. More words {i}", True) for i in range(5)] + [("https://h/x", "t", "c", " ", True), ("https://h/y", "t", "c", "z", False)], "url string, title string, category string, content string, success boolean")
    rows = chunks.stored_chunks(docs).select("id", "text", embed("text").alias("embedding"), "source_url", "title", "category", "chunk_index", "total_chunks", F.col("category").alias("collection"))
    path, after = str(tmp_path / "store"), str(tmp_path / "store2")
    assert files.add_to_store(rows, path, exists=False) == 5
    assert files.add_to_store(rows, path, exists=True) == 0
    files.delete_source(spark, path, "https://h/1", after)
    assert files.open_store(spark, after, "c").count() == 4 and [r[0] for r in files.collections(spark, after).collect()] == ["c"]
    q = retrieval.hashed_question("text number 2. More words 2", 32)
    hit = retrieval.search(files.open_store(spark, path), q, 3).first()
    assert hit.source_url == "https://h/2" and abs(hit.score - 1) < 1e-6
    text = retrieval.answer(retrieval.across_collections(files.open_store(spark, path), q), "bewerbung", ["c"]).first()[0]
    wording = retrieval.AnswerText()
    assert "Result 1 (source: t2)" in text and text.endswith(wording.hint)
    assert retrieval.answer(hit_none := retrieval.across_collections(files.open_store(spark, path), [0.0] * 32), "q", ["c"]).first()[0] == wording.nothing.format("q") and hit_none.count() == 0
    for bad in ({"backend": "faiss"}, {"embedding_provider": "none"}, {"persist_directory": "output/vector_db"}):
        try:
            retrieval.StoreConfig(**bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"url": "u", "content": "x", "success": true}, {"url": "v", "success": false}]')
    (tmp_path / "a.jsonl").write_text('{"url": "u", "success": true}\n')
    assert files.read_scraped(spark, str(tmp_path / "a.json")).count() == 1
    assert files.read_scraped(spark, str(tmp_path / "a.jsonl"), False).count() == 1
    (tmp_path / "x.pdf").write_bytes(b"%PDF broken")
    got = {r.url.rsplit("/")[-1]: r for r in files.read_pdfs(spark, str(tmp_path), lambda b: (b.decode(), 1, "plain")).collect()}
    assert got["x.pdf"].text == "%PDF broken" and got["x.pdf"].title == "x"
    assert not files.read_pdfs(spark, str(tmp_path)).first().success
    assert files.page_part(2, "t", [[["a", None]]]) == "--- Page 2 ---\nt\n\n[Table 1]\na\tNone"
    spark.dataSource.register(files.WebSource)
    assert spark.read.format("pages").option("urls", "").load().count() == 0
    assert not files.robots_rules("User-agent: *\nDisallow: /x")("https://h/x")


def test_streams(spark, tmp_path):
    from lodeweave.streaming import incremental as S

    rows = [("u", "A", 1, datetime(2024, 1, 1), True, 0.5), ("u", "A", 1, datetime(2024, 1, 2), True, 0.5), ("u", "B", 5, datetime(2024, 1, 3), False, 1.0)]
    schema = "url string, content string, word_count long, ts timestamp, success boolean, response_time double"
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = S.changes(stream.withColumn("content_hash", F.sha2("content", 256))).writeStream.format("memory").queryName("changes").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.change_type for r in spark.sql("select * from changes").collect()) == ["identical", "modified", "new"]
    q = S.unique_pages(stream).writeStream.format("memory").queryName("uniq").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from uniq").count() == 2
    cached = stream.select("url", F.sha2("content", 256).alias("content_hash"), F.col("ts").alias("last_scraped"))
    q = S.upsert_cache(cached, str(tmp_path / "cache"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    history = spark.read.parquet(str(tmp_path / "cache"))
    assert history.count() == 3 and [r.content_hash for r in S.current(history).collect()] == [spark.range(1).select(F.sha2(F.lit("B"), 256)).first()[0]]


def test_chat_memory_stream(spark, tmp_path):
    from lodeweave.streaming import incremental as S

    schema = "conv_id long, turn long, role string, text string"
    for i, part in enumerate([[(1, t, "user" if t % 2 else "assistant", f"m{t}") for t in range(5)], [(1, 5, "user", "m5"), (1, 6, "system", "s"), (2, 0, "user", "x")]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = S.chat_memory(stream, 3).writeStream.format("memory").queryName("chat").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    last = {r.conv_id: r for r in spark.sql("select * from chat order by last_turn").collect()}
    assert last[1].messages == ["user: m3", "assistant: m4", "user: m5"] and last[2].n == 1


def test_expiry_stream(spark, tmp_path):
    from lodeweave.streaming import incremental as S

    rows = [("u", datetime(2024, 1, 1)), ("v", datetime(2024, 1, 2)), ("u", datetime(2024, 1, 9)), ("w", datetime(2024, 2, 1)), ("x", datetime(2024, 2, 2))]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], "url string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema("url string, ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = S.expiring(stream, days=10).writeStream.format("memory").queryName("expiry").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = [(r.url, r.event) for r in spark.sql("select * from expiry").collect()]
    assert sorted(u for u, e in got if e == "expired") == ["u", "v"] and len([1 for _, e in got if e == "stored"]) == 5


def test_dedupe_in_batches_equals_one_by_one(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(40)) for _ in range(5)]
    docs = []
    for i in range(40):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
        docs.append((i, " ".join(w)))
    docs += [(40, ""), (41, None), (42, "two words")]
    want, accepted, got = greedy_spec([(i, t or "") for i, t in docs]), None, {}
    for lo, hi in ((0, 15), (15, 30), (30, 43)):
        unique, gone, accepted = dedupe.batch(spark.createDataFrame(docs[lo:hi], "id long, content string"), accepted)
        got |= {r.id: (True, None) for r in unique.collect()} | {r.id: (False, r.duplicate_of) for r in gone.collect()}
        assert all(r.duplicate_reason.startswith(want[r.id][2]) for r in gone.collect())
    assert got == {i: w[:2] for i, w in want.items()}


class Site:
    """A web server on this machine that counts what it was asked."""

    def __init__(self):
        import threading
        from collections import Counter
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

        asked = self.asked = Counter()

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                asked[self.path] += 1
                status = {"/missing": 404, "/created": 201, "/down": 503}.get(self.path, 503 if self.path == "/flaky" and asked[self.path] < 3 else 200)
                body = {"/robots.txt": b"User-agent: *\nDisallow: /private", "/f.pdf": b"%PDF some text"}.get(self.path, b'<a href="/next#x">n</a><a href="/s.css">s</a>')
                self.send_response(status)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.root = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


def test_fetching(spark):
    site = Site()
    quick = {"delay": 0, "retryDelay": 0, "initialDelay": 0, "timeout": 5, "retries": 3}
    urls = [f"{site.root}/{p}" for p in ("ok", "missing", "created", "down", "flaky")] + ["http://127.0.0.1:9/closed"]

    def outcomes(mode):
        site.asked.clear()
        return {r.url.rsplit("/", 1)[-1]: (r.success, r.error_type, r.attempts) for r in files.fetched(spark, urls, retryMode=mode, **quick).collect()}

    # Only status 200 is a success; a linear retry doesn't look at what went wrong.
    assert outcomes("linear") == {"ok": (True, None, 1), "missing": (False, "not_found", 3), "created": (False, "http_201", 3), "down": (False, "server_error", 3), "flaky": (True, None, 3), "closed": (False, "connection_error", 3)}
    # An exponential one gives up at once where another try can't help.
    assert outcomes("exponential") == {"ok": (True, None, 1), "missing": (False, "not_found", 1), "created": (False, "http_201", 1), "down": (False, "server_error", 3), "flaky": (True, None, 3), "closed": (False, "connection_error", 3)}
    once = outcomes("once")
    assert once["created"] == (True, None, 1) and once["down"] == (False, "server_error", 1) and all(v == 1 for v in site.asked.values())
    pages = files.fetched(spark, urls[:2], retryMode="once", **quick)
    assert {r.error_message for r in pages.where("NOT success").collect()} == {"HTTP error: 404"}
    assert [(r.link, r.kind) for r in files.crawled_links(pages, [site.root[7:]]).collect()] == [(f"{site.root}/next", "page")]
    seen, progress = files.observed(pages)
    seen.count()
    assert progress.get == {"fetched": 2, "failed": 1}
    try:
        files.WebReader({"retryMode": "always"})
    except ValueError:
        return
    raise AssertionError


def test_pdfs_and_robots_over_the_web(spark):
    site = Site()
    quick = {"delay": 0, "retryDelay": 0, "timeout": 5, "binary": "true"}
    got = files.downloaded_pdfs(files.fetched(spark, [f"{site.root}/f.pdf", f"{site.root}/missing"], **quick)).collect()
    assert [(r.content, r.file_size) for r in got] == [(b"%PDF some text", 14)] and got[0].filename.startswith("f_")
    pdfs = spark.createDataFrame([("https://h/bachelor/po-bwl.pdf?x=1", b"abc", 3), ("https://h/z.PDF", b"", 0), ("https://h/bad.pdf", b"!", 1)], "url string, content binary, file_size long")

    def read(data):
        if data == b"!":
            raise ValueError("broken")
        return data.decode(), 2, "plain", "Own title" if data else None

    rows = {r.url: r for r in files.pdf_documents(pdfs, read).collect()}
    first = rows["https://h/bachelor/po-bwl.pdf?x=1"]
    assert (first.title, first.success, first.degree, first.num_pages) == ("Own title", True, "Bachelor", 2) and first.document_type is not None
    assert not rows["https://h/z.PDF"].success and rows["https://h/z.PDF"].title == "z" and rows["https://h/bad.pdf"].error == "broken"
    urls = spark.createDataFrame([(f"{site.root}/private/x",), (f"{site.root}/open",), ("https://other.test/private",)], "url string")
    hosts = files.robots_addresses(urls.limit(2))
    texts = files.fetched(spark, [r.robots_url for r in hosts.collect()], delay=0).select(F.regexp_extract("url", "//([^/]+)", 1).alias("netloc"), F.col("html").alias("text"))
    assert {r.url.rsplit("/", 1)[-1]: r.may_fetch for r in files.allowed_by_robots(urls, texts).collect()} == {"x": False, "open": True, "private": True}


def test_store_versions_and_settings(spark, tmp_path):
    rows = spark.createDataFrame([(f"i{k}", f"text {k}", [float(k), 1.0], f"https://h/{k % 2}", "t", "c", 0, 1, "c") for k in range(4)], files.STORE)
    store: retrieval.StoreBackend = files.ParquetStore(spark, str(tmp_path / "s"))
    assert store.count() == 0 and store.add(rows) == 4 and store.add(rows) == 0
    store.delete_by_source("https://h/1")
    assert store.count() == 2 and {r.id for r in store.search([2.0, 1.0], 5).collect()} == {"i0", "i2"}
    config = retrieval.from_environment({"CHUNK_SIZE": "700", "COLLECTION_NAME": "x", "MAX_RESULTS": ""})
    assert (config.chunk_size, config.collection_name, config.max_results) == (700, "x", retrieval.RESULTS)


def test_tools_and_mail(spark):
    from lodeweave.functions import mail
    from lodeweave.plans import tools

    embed = lambda t: retrieval.hashed_question(t, 16)
    store = spark.createDataFrame([("i", "apples and pears", embed("apples and pears"), "https://h", "", "c", 0, 1, "fruit")], files.STORE)
    tool = tools.knowledge_tool(store, embed)
    assert "apples" in tool(query="apples and pears").first()[0]
    page = tools.page_tool(lambda url: spark.createDataFrame([(url, "<p>hi</p><script>x</script>", None)], "url string, html string, error_message string"))
    assert page(url="u").first().text == "hi"
    for wrong in ({}, {"query": 1}, {"query": "a", "more": 1}):
        try:
            tool(**wrong)
        except ValueError:
            continue
        raise AssertionError(wrong)
    env = {"SMTP_SERVER": "s", "SMTP_PORT": "25", "SMTP_USERNAME": "u", "SMTP_PASSWORD": "p"}
    assert mail.mail_settings(env)["port"] == 25 and mail.mail_settings(env | {"SMTP_PASSWORD": ""}) is None


def test_distances_on_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [-2.0, 0.0]), (6, [])], "id int, embedding array<float>")
    assert {r.id: r.distance for r in retrieval.distances(rows, [3.0, 0.0]).collect()} == {1: 0.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 2.0, 6: 1.0}
