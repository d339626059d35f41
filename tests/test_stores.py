import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import cache as C
from lodeweave.operators import dedupe, minhash
from lodeweave.operators.cache_table import CacheTable
from lodeweave.operators.near_index import NearIndex
from lodeweave.sources.buckets import read_bucketed, write_bucketed


def shuffles(df):
    """What the plan deals anew, as it is before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    return [line for line in plan.split("\n") if "Exchange" in line and "BroadcastExchange" not in line]


def test_a_look_up_leaves_the_cache_where_it_lies(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = random.Random(1)
        rows = [(f"https://h.test/{rng.randrange(300)}", f"{i}", rng.randrange(50), i % 3 > 0, 200, rng.choice(["a", None]), "{}") for i in range(900)]
        kind = "url string, content_hash string, last_scraped long, success boolean, status_code int, category string, metadata string"
        df = spark.createDataFrame(rows, kind).select("url", "content_hash", F.timestamp_seconds("last_scraped").alias("last_scraped"), "success", "status_code", "category", "metadata")
        table = CacheTable(spark, f"file://{tmp_path}/cache", buckets=4, puts=3)
        assert table.current().count() == 0
        want, at = {}, lambda r: (r[2],)
        for lo in range(0, 900, 150):
            part = df.where(F.col("content_hash").cast("int").between(lo, lo + 149))
            table.put(part)
            for r in rows[lo : lo + 150]:
                if r[0] not in want or at(r) > at(want[r[0]]) or (at(r) == at(want[r[0]]) and int(want[r[0]][1]) // 150 < lo // 150):
                    want[r[0]] = r
            got = {r.url: r for r in table.current().collect()}
            assert set(got) == set(want) and all(int(got[u].last_scraped.timestamp()) == w[2] for u, w in want.items())
            assert all(got[u].content_hash == w[1] for u, w in want.items() if sum(r[0] == u and r[2] == w[2] for r in rows) == 1)
        assert table.versions.base() > 0 and len(table.versions.additions()) < 3
        (tmp_path / "cache" / f"v{table.versions.base()}.9").mkdir()  # a put that was interrupted
        assert table.current().count() == len(want)
        table.compact()
        urls = spark.createDataFrame([(f"https://h.test/{i}",) for i in range(0, 600, 7)], "url string")
        joined = table.joined(urls)
        assert {(r.url, r.cached) for r in joined.collect()} == {(f"https://h.test/{i}", f"https://h.test/{i}" in want) for i in range(0, 600, 7)}
        assert len(shuffles(joined)) == 1  # the urls, and not the cache
        assert not shuffles(table.current().groupBy("url").count())
        table.put(df.limit(5))
        plan = shuffles(table.joined(urls))
        assert len(plan) <= 3 and not any("v0/" in line for line in plan)
        table.remove(C.without_category(table.current(), "a"))
        assert {r.category for r in table.current().collect()} == {None}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_tables_are_known_by_their_path(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    before = {t.name for t in spark.catalog.listTables()}
    write_bucketed(spark.range(100).withColumn("v", F.col("id") * 2), path, "id", 5)
    write_bucketed(spark.range(50).withColumn("v", F.col("id") * 3), path, "id", 5)  # anew
    rows = read_bucketed(spark, path, "id bigint, v bigint", "id", 5)
    assert sorted(r.v for r in rows.collect()) == [3 * i for i in range(50)] and {t.name for t in spark.catalog.listTables()} == before
    assert len(list((tmp_path / "t").glob("*.parquet"))) == 5


def texts(seed, n=70):
    """Copies, near copies, texts without shingles and with few, very long ones, and nulls."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(90))
    bases = [[word() for _ in range(rng.choice([2, 4, 20, 60, 1500]))] for _ in range(9)]
    out = []
    for _ in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 3, 30])):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    return [*out, None, "", " ", "One two", "one two"]


def walk(rows):
    """The same decisions one document after another, over plain sets."""
    shingles = lambda t: {tuple(w[i : i + 3]) for w in [t.lower().split()] for i in range(len(w) - 2)}
    kept, out = [], {}
    for i, t in sorted(rows):
        t = t or ""
        h, s = t.lower().strip(), shingles(t)
        same = [j for j, x, _, _ in kept if x == h]
        near = []
        for j, _, c, bare in kept:
            both = len(s & c)
            if s and c and both / len(s | c) >= 0.85 or not s and bare:
                near.append(j)
        if same:
            out[i] = (False, min(same), "exact_duplicate")
        elif near:
            out[i] = (False, min(near), "near_duplicate")
        else:
            out[i] = (True, None, None)
            kept.append((i, h, shingles(t[:5000]), not shingles(t[:5000])))
    return out


def test_batches_through_an_index_on_disk_equal_one_walk(spark, tmp_path):
    rows = list(enumerate(texts(1)))
    want, path = walk(rows), f"file://{tmp_path}/near"
    got = {}
    for lo in range(0, len(rows), 30):
        index = NearIndex(spark, path, buckets=2, batches=1)  # opened anew for every batch
        part = spark.createDataFrame(rows[lo : lo + 30], "id long, content string")
        got |= {r.id: (r.is_unique, r.duplicate_of, r.reason) for r in index.add(part).collect()}
    assert got == want
    index = NearIndex(spark, path, buckets=2, batches=1)
    assert sorted(r.id for r in index.docs().collect()) == sorted(i for i, w in want.items() if w[0]) and len(index.parts()) == 1
    index.vacuum()
    assert sorted(r.id for r in index.docs().collect()) == sorted(i for i, w in want.items() if w[0])
    again = spark.createDataFrame([(1000 + i, t) for i, t in rows], "id long, content string")
    assert index.add(again).where("is_unique").count() == 0
    whole = dedupe.greedy(spark.createDataFrame(rows, "id long, content string"))
    assert {r.id: (r.is_unique, r.duplicate_of, r.reason) for r in whole.collect()} == want


def test_copies_of_a_template_are_not_compared_with_one_another(spark, tmp_path, monkeypatch):
    """2000 near copies of one text: each meets the one that is kept, not all others."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(2000):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    met, plain = [], dedupe._Sets.near

    def near(self, asked, kept):
        met.append((asked.count(), kept.count()))
        return plain(self, asked, kept)

    monkeypatch.setattr(dedupe._Sets, "near", near)
    monkeypatch.setattr(dedupe, "near_pairs", None)  # nothing is left for pairs
    out = dedupe.greedy(spark.createDataFrame(rows, "id long, content string").repartition(4)).collect()
    assert Counter(r.is_unique for r in out) == {True: 1, False: 1999} and {r.duplicate_of for r in out} == {None, 0}
    assert max(k for _, k in met) == 1


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, content string")
    assert dedupe.greedy(empty).count() == 0
    index = NearIndex(spark, f"file://{tmp_path}/near")
    assert index.add(empty).count() == 0 and index.add(empty).count() == 0


def folder_bytes(spark):
    """What intermediate tables hold."""
    top = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)


@pytest.mark.parametrize("name", ["greedy", "near_pairs", "minhash"])
def test_unlike_texts_leave_little_on_disk(spark, name):
    """Sets of texts that can't be near to any other aren't kept, nor are those of whole texts longer than any beginning."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(2000))) for i in range(120)]
    rows += [(1000 + i, t) for i, t in rows[:5]]
    docs = spark.createDataFrame(rows, "id long, content string").repartition(3)
    before = folder_bytes(spark)
    got = {"greedy": dedupe.greedy, "near_pairs": dedupe.near_pairs, "minhash": minhash.near_pairs}[name](docs).collect()
    assert len(got) == (len(rows) if name == "greedy" else 0)
    assert folder_bytes(spark) - before < 0.5 * sum(len(t) for _, t in rows)


def test_a_pair_is_found_whatever_order_its_copies_come_in(spark):
    """Copies stand for one another, but each pair has its own order: the larger id's whole text and the smaller one's beginning."""
    text = " ".join(f"w{i}" for i in range(100))
    other, long_ = text.replace("w50 ", "x "), " ".join(f"v{i}" for i in range(1300))
    rows = [(1, text), (2, other), (3, text), (4, other), (5, long_), (6, long_), (7, long_[:4990] + " end"), (8, long_)]
    sets = lambda t: {tuple(w[i : i + 3]) for w in [t.split()] for i in range(len(w) - 2)}
    want = set()
    for i, x in rows:
        for j, y in rows:
            s, t = sets(x), sets(y[:5000])
            if j < i and len(s & t) / len(s | t) >= 0.85:
                want.add((i, j, round(len(s & t) / len(s | t), 9)))
    docs = spark.createDataFrame(rows, "id long, content string")
    assert len(want) > 6
    for found in (dedupe.near_pairs(docs), minhash.near_pairs(docs)):
        assert {(r.i, r.j, round(r.jaccard, 9)) for r in found.collect()} == want
