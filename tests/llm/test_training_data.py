import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import same_rows
from llm_specs import SCHEMA, SF, groups_spec, make_docs, removal_spec
from pyspark.sql import functions as F

from lodeweave.llm import components, fingerprints, markup, ngram_join, packing, quality, queries, shared, substrings, text, topk, toxicity, warc


@pytest.mark.parametrize(("seed", "block", "hubs"), [(1, 1024, 3), (2, 2, 1)])
def test_ngram_join_against_all_pairs(spark, monkeypatch, seed, block, hubs):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "HUBS", hubs)
    rows = make_docs(seed)
    sets, comp = groups_spec(rows)
    least = {}
    for r, c in zip(rows, comp, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = sorted(((r[0], len(s), least.get(c) if s else r[0]) for r, s, c in zip(rows, sets, comp, strict=True)), key=repr)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in ngram_join.classes(docs).collect()), key=repr) == want
    kept = ngram_join.one_per_group(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id for r in kept.where(F.col("doc_id").isNotNull()).collect()))
    firsts = {least[c] for r, s, c in zip(rows, sets, comp, strict=True) if s and c in least and not any(q[0] is None and d == c for q, d in zip(rows, comp, strict=True))}
    assert got == sorted([*firsts, *(r[0] for r, s in zip(rows, sets, strict=True) if not s)])


def test_ngram_join_star_of_near_copies(spark):
    """Copies of one base that differ from one another more than the threshold allows are still one group."""
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for k in range(1, 25):
        w = list(base)
        for j in range(5):
            w[(k * 11 + j * 57) % 300] = f"e{k}x{j}"
        rows.append((k, " ".join(w)))
    out = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in out} == {0}


def test_trie_links_equals_set_arithmetic():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 5000, 300).astype(np.uint64))
    members = [np.unique(np.concatenate([rng.choice(base, rng.integers(200, len(base)), replace=False), rng.integers(0, 5000, rng.integers(0, 60)).astype(np.uint64)])) for _ in range(60)] + [base, base[:0], base[:200]]
    both = [len(np.intersect1d(base, m)) for m in members]
    want = [i for i, m in enumerate(members) if both[i] and 100 * both[i] >= 80 * (len(base) + len(m) - both[i])]
    assert sorted(ngram_join.trie_links(base, members, 80)) == want


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(50, 40), (50, 60), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[40] == got[50] == got[60] == 40
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    odd = spark.createDataFrame([(None, 1), (2, None), (None, None), (5, 5), (3, 4), (3, 4), (4, 3)], "a long, b long")
    assert sorted(tuple(r) for r in components.components(odd).collect()) == [(3, 3), (4, 3)]


def test_only_wanted_lets_all_wanted_rows_through(spark, monkeypatch):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    wanted = spark.range(500).select(F.xxhash64(F.col("id") * 7).alias("h"))
    few = shared.only_wanted(rows, wanted, "h")
    assert few.join(wanted, "h", "left_semi").count() == 500 and few.count() < 3000
    assert shared.only_wanted(rows, wanted.limit(0), "h").count() == 0 and shared.only_wanted(rows.limit(0), wanted, "h").count() == 0
    monkeypatch.setattr(shared, "FILTER_BITS", 1 << 16)  # a filter that is too small lets more through, but never less
    many = spark.range(0, 20_000, 2).select(F.xxhash64("id").alias("h"))
    assert shared.only_wanted(rows, many, "h").join(many, "h", "left_semi").count() == 10_000


@pytest.mark.parametrize(("seed", "window"), [(1, 35), (2, 35), (3, 12)])
def test_substrings_against_all_windows(spark, seed, window):
    rows = make_docs(seed)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in substrings.digests(docs, window).collect()), key=repr) == removal_spec(rows, window)
    cut = substrings.deduplicated(docs, window)
    assert cut.columns == docs.columns and cut.count() == len(rows)


def test_substring_index_over_batches(spark):
    index = substrings.FingerprintIndex()
    for k in range(6):
        index.add(spark.createDataFrame([(k,), (100,)], "a long"))
    assert len(index.runs) <= substrings.MAX_RUNS
    assert {(r.hash, r.n) for r in index.counts().collect()} == {*((k, 1) for k in range(6)), (100, 6)}
    assert [r.a for r in index.repeated(spark.createDataFrame([(3,), (100,)], "a long")).collect()] == [100]


def test_substrings_in_batches(spark):
    """A table in batches has the result of one pass, also for documents that only a later batch repeats."""
    rows = make_docs(1)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in substrings.digests(docs, 35, 6).collect()), key=repr) == removal_spec(rows, 35)
    first = " ".join(f"w{i}" for i in range(50))
    index = substrings.FingerprintIndex()
    _, cut = substrings.repeats(spark.createDataFrame([(1, "a " + first + " b")], "doc_id long, text string"), index=index, batches=1)
    assert cut.count() == 0
    known, cut = substrings.repeats(spark.createDataFrame([(2, first + " c"), (3, "other words")], "doc_id long, text string"), index=index, batches=1)
    assert {r.doc_id: (r.n_removed, r.kept) for r in cut.collect()} == {1: (50, "a b"), 2: (50, "c")}
    assert {r.doc_id for r in known.collect()} == {2, 3}


def test_substring_index_on_disk(spark, tmp_path):
    """Seven batches through an index that is saved and opened anew between them have the result of one pass; runs are compacted on the way."""
    rows = make_docs(6)
    folder = f"file://{tmp_path}/index"
    with pytest.raises(ValueError, match="no index"):
        substrings.FingerprintIndex.open(spark, folder)
    cut, known = None, {}
    for k in range(7):
        index = substrings.FingerprintIndex() if k == 0 else substrings.FingerprintIndex.open(spark, folder)
        part = spark.createDataFrame(rows[k::7], SCHEMA)
        summary, cut = substrings.repeats(part, 12, index, batches=1)
        for r in summary.collect():
            known.setdefault((r.doc_id, r.th), []).append((r.n_words, bytes(r.digest).hex()))
        index.save(folder)
        (tmp_path / "index" / f"index={k + 1}").mkdir(exist_ok=True)  # as a driver that was killed leaves it
    assert len(index.runs) <= substrings.MAX_RUNS
    lost = {(r.doc_id, r.th): (r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in cut.collect()}
    got = [(key[0], n, *lost.get(key, (0, digest))) for key, several in known.items() for n, digest in several]
    assert sorted(got, key=repr) == removal_spec(rows, 12)


def syncmers(data, k, s):
    """The hashes of the closed syncmers of a text, one k-mer after another."""
    small = lambda i: int(text.short_grams(np.frombuffer(data[i : i + s], np.uint8), s)[0]) >> 32
    hashes = [small(i) for i in range(len(data) - s + 1)]
    out = []
    for i in range(len(data) - k + 1):
        inner = hashes[i : i + k - s + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.append(int(text.hashes(np.frombuffer(data, np.uint8), np.array([i]), np.array([i + k]))[0]) >> 32)
    return out


def fingerprint_spec(data):
    return syncmers(data, fingerprints.K, fingerprints.S) or syncmers(data, *fingerprints.SHORT) or ([int.from_bytes(hashlib.blake2b(data, digest_size=4).digest(), "little")] if data else [])


def likeness_spec(one, two):
    """By pairs of the n-th of a kind, and all their rising subsequences' lengths."""
    if not one or not two:
        return float(one == two)
    place, seen = {}, Counter()
    for j, m in enumerate(two):
        place[m, seen[m]] = j
        seen[m] += 1
    seen, met = Counter(), []
    for m in one:
        if (m, seen[m]) in place:
            met.append(place[m, seen[m]])
        seen[m] += 1
    best = []
    for i, p in enumerate(met):
        best.append(1 + max((best[j] for j in range(i) if met[j] < p), default=0))
    return 2 * max(best, default=0) / (len(one) + len(two))


def near_spec(one, two):
    pair = [syncmers(x, fingerprints.K, fingerprints.S) for x in (one, two)]
    if not all(pair):
        pair = [syncmers(x, *fingerprints.SHORT) or ([int.from_bytes(hashlib.blake2b(x, digest_size=4).digest(), "little")] if x else []) for x in (one, two)]
    return likeness_spec(*pair)


@pytest.mark.parametrize("parts", [None, 9])
def test_edited_fingerprints_against_one_by_one(spark, monkeypatch, parts):
    rows = [(r[0], r[1] if r[1] is None else r[1][:1500]) for r in make_docs(4) if r[0] is not None]
    rows = list(dict(sorted(rows, key=lambda r: r[0])).items()) + [(None, f"null id {i} " + "ab c" * i) for i in range(12)]
    code = lambda t: spark.createDataFrame([(t or "",)], "t string").select(F.xxhash64("t")).first()[0]
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), code(r[1]) if r[0] is None else 0))
    if parts:
        plain = fingerprints.neighbours
        monkeypatch.setattr(fingerprints, "neighbours", lambda docs: plain(docs, parts))
    found = fingerprints.edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = []
    for i, (doc_id, here) in enumerate(ordered):
        here, after = here or "", ordered[(i + 1) % len(ordered)][1] or ""
        n = len(here)
        edit = here[: n - n // 3] + after[: n // 3]
        marks = [fingerprints.encoded(np.array(fingerprint_spec(t.encode()), np.uint32)) for t in (here, edit)]
        want.append((doc_id, n, hashlib.sha256(edit.encode()).hexdigest(), *marks, near_spec(here.encode(), edit.encode()), near_spec(here.encode(), after.encode())))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert fingerprints.edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_an_id_of_many_rows_is_dealt_over_parts(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i}") for i in range(900)]
    sizes = [r.n for r in fingerprints.neighbours(spark.createDataFrame(rows, "doc_id long, text string"), 12).groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 200 and sum(sizes) == 900 + len(sizes)


def test_likeness_hears_order():
    one, two = np.arange(100, dtype=np.uint32), np.arange(100, 200, dtype=np.uint32)
    whole, turned = np.concatenate([one, two]), np.concatenate([two, one])
    assert fingerprints.likeness(whole, whole) == 1 and fingerprints.likeness(whole, turned) == 0.5
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = (rng.integers(0, 12, rng.integers(0, 25)).astype(np.uint32) for _ in range(2))
        assert abs(fingerprints.likeness(a, b) - (1.0 if len(a) == len(b) == 0 else likeness_spec(a.tolist(), b.tolist()))) < 1e-12


def test_short_texts_are_compared_at_one_scale():
    """Where only one of two texts has a kept 32-byte k-mer, what they share still counts."""
    rng, mixed = random.Random(5), 0
    for _ in range(300):
        here, after = ("".join(rng.choice("abcdefghij ") for _ in range(45)) for _ in range(2))
        edit = here[:30] + after[:15]
        counts = [len(m) for _, m in fingerprints.of_texts([here.encode(), edit.encode()])]
        if (counts[0] == 0) != (counts[1] == 0):
            mixed += 1
            assert fingerprints.edited_rows([(1, here, after)])[0][5] > 0.2
    assert mixed > 10


def test_syncmers_are_context_free():
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400)).encode()
    one = fingerprints.of_texts([b"x" * 77 + passage])[0]
    two = fingerprints.of_texts([b"other start " + passage + b" and end"])[0]
    inside = lambda f, lo: [(p - lo, m) for p, m in zip(*f, strict=True) if lo <= p <= lo + len(passage) - fingerprints.K]
    assert inside(one, 77) == inside(two, 12) and len(inside(one, 77)) > 5
    assert all(b - a == 12 - 77 for a, b in fingerprints.matches(b"x" * 77 + passage, b"other start " + passage))


def topk_spec(rows, k):
    known = []
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            known.append((i, [int(np.floor(64.0 * float(np.float32(x)))) for x in v]))
    out = []
    for n, (q, v) in enumerate(known):
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), c) for m, (c, w) in enumerate(known) if m != n)[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"pivots": 6, "n_candidates": 13, "n_queries": 2, "cell_rows": 20}, {"pivots": 3, "n_candidates": 50, "n_queries": 3, "cell_rows": 1}])
def test_topk_against_all_pairs(spark, sizes):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 8) / 4], 1) for i in range(120)]
    rows += [(200, None, 1), (220, [None, 1.0], 1), (240, [float("nan")], 1), (260, [float("inf"), 0.0], 1), (280, [], 1), (300, [1.5], 1), (0, [0.25] * 8, 2), (0, [0.25] * 8, 2), (None, [1.0], 1), (320, [1e7, 2.0, -1e7], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    ready = df.where(topk.usable(F.col("embedding"))).select("vec_id", topk.whole_numbers(F.col("embedding")).alias("v"))
    got = topk.top_k(ready, F.col("vec_id") % 20 == 0, 20, **sizes)
    assert sorted(tuple(r) for r in got.collect()) == topk_spec(rows, 20)
    assert topk.top_k(ready.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def clustered(n, clusters, dim, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 60, (clusters, dim))
    return (middle[rng.integers(0, clusters, n)] + rng.normal(0, 6, (n, dim))).astype(np.int64)


def test_pivots_spare_work_in_a_block():
    c = clustered(2000, 12, 16)
    rows, floor = np.arange(2000), np.full(100, -np.inf)
    got = topk.block_best(c[:100], rows[:100], floor, c, rows, rows, topk.choose_pivots(c, 24), 20)
    assert got[3] < 100 * 2000 * 0.5
    want = [sorted((-int(s), i) for i, s in enumerate(c @ c[q]) if i != q)[:20] for q in range(100)]
    assert sorted(zip(got[0], got[2], got[1], strict=True)) == sorted((q, -s, i) for q, w in enumerate(want) for s, i in w)


def test_cells_spare_most_pairs_of_clustered_vectors(spark):
    c = clustered(3000, 20, 16)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(c.tolist())], "vec_id long, v array<long>")
    found, share = topk.search(df, F.col("vec_id") % 20 == 0, n_candidates=200, n_queries=50, cell_rows=150)
    assert share.first().evaluated < 0.3
    want = [(q, r, i, -s) for q in range(0, 3000, 20) for r, (s, i) in enumerate(sorted((-int(s), i) for i, s in enumerate(c @ c[q]) if i != q)[:20], 1)]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = make_docs(5) + [(9001, "ΑΣ Ας İ é it's 12345 <|endoftext|> x\x1cy, ﬁ ½ don't!!", *[None] * 6)]
    out = packing.pack(packing.pieces(spark.createDataFrame(rows, SCHEMA), path, 64), 64, group_items=20).collect()
    tokenizer, want = Tokenizer.from_file(path), []
    for r in rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r[0], k, s, len(ids[s : s + 64]), __import__("zlib").crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    assert sorted([tuple(r)[:5] for r in out], key=repr) == sorted(want, key=repr)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.1 * sum(r.length for r in out) / 64 + 2
    assert packing.pack(packing.pieces(spark.createDataFrame([], SCHEMA), path)).count() == 0


def test_ids_equal_the_tokenizers():
    """Every character that is taken word by word, in several surroundings, and many others; then random mixtures."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, rng = Tokenizer.from_file(path), random.Random(8)
    near = [*map(chr, range(0x530)), *map(chr, range(0x2000, 0x2070)), "\u20ac", "\u20ab"]
    far = [chr(c) for c in range(0x530, 0x20000, 37) if not 0xD800 <= c < 0xE000]
    texts = [t for c in near + far for t in (c, f"a{c}b 1{c}'s {c}{c}!")]
    texts += ["".join(rng.choice(near) if rng.random() < 0.5 else rng.choice("ab'S 1\n.Σß") for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["", " ", "<|endoftext|> a", "a <|startoftext|>", "<| a |>", "x" * 500 + " y"]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = packing.token_ids(texts, path)
    assert [t for t, g, w in zip(texts, got, want, strict=True) if g.tolist() != w] == []


def test_words_are_forgotten_and_learned_again(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"word{i % 70} some{i} more" for i in range(300)]
    want = [x.tolist() for x in packing.token_ids(texts, path)]
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    monkeypatch.setattr(packing, "CACHE_PARTS", 20)
    assert [x.tolist() for t in texts for x in packing.token_ids([t], path)] == want


def test_best_fit_where_nothing_fits():
    bins, place, fill = packing.best_fit(np.array([40] * 10), 64)
    assert len(fill) == 10 and set(place) == {0}


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>Menu</ul></nav><div id="cookie-notice">x<div>y</div></div><article><h1>T &amp; t</h1><p>One
 <b>bo</b>ld&nbsp;x<br>line<p>Two &lt;3<script>var a="</p>";</script></p><div class="share-buttons">s</div><section class="comments"><p>reader</p></section></article><aside>side</aside><form>f</form><footer>&copy; f</footer>"""


def test_main_text(spark):
    body = "<body><p>Same start of all pages</p><div>Buy now</div><ul><li>a</li><li>b</li></ul><p>{}</p><p>Same end of all</p><div>Call us</div><ul><li>c</li></ul></body>"
    rows = [(1, "http://h.test/a", PAGE, 1), (2, None, None, 2), (3, "bad url", "", 3), (4, "http://h.test/b", PAGE, 4), (5, "http://h.test/c", "<p>open <!-- c", 5), (6, "http://h.test/a", PAGE, 1)]
    rows += [(10 + i, f"http://k.test/{i}", body.format(f"unique words number {i}"), 0) for i in range(5)]
    got = {r.page_id: r for r in markup.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()}
    assert got[1].text == got[4].text == got[6].text == "T & t\nOne bold x line\nTwo <3"
    assert got[2].text == got[3].text == "" and got[5].text == "open" and got[1].n_chars == len(got[1].text)
    assert all(got[10 + i].text == f"unique words number {i}" for i in range(5))
    assert markup.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_of_a_host_in_parts(spark):
    """Runs that few pages share are repeated however many parts their host is dealt into."""
    menu = "<ul>" + "".join(f"<li>entry {i}</li>" for i in range(6)) + "</ul>"
    rows = [(i, f"http://{'k' if i < 60 else 'm'}.test/{i}", f"<p>alone {i}</p>" + menu.replace("entry", f"entry {i % 30}") * 2 + f"<div>end {i}</div>") for i in range(63)]
    rows += [(100, "http://k.test/z", "<h1>y</h1>" * 9), (101, "http://k.test/y", "<h2>none</h2><ul>" + "<li>own</li>" * 9), (102, "http://k.test/x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole, dealt = (sorted(tuple(r) for r in markup.extract(df, group_pages=n).collect()) for n in (256, 4))
    assert dealt == whole and len(whole) == len(rows)
    assert {r[0]: r[2] for r in dealt}[7] == "alone 7\nend 7" and "entry 1" in {r[0]: r[2] for r in dealt}[61]


def test_repeated_runs_against_all_runs():
    rng = random.Random(3)
    pages = [[rng.choice("abc") for _ in range(rng.randrange(0, 60))] for _ in range(12)]
    for least in (1, 4, 6, 8):
        where = {}
        for i, p in enumerate(pages):
            for k in range(len(p) - least + 1):
                where.setdefault(tuple(p[k : k + least]), set()).add(i)
        for p, covered in zip(pages, markup.repeated_runs(pages, least), strict=True):
            want = {q for k in range(len(p) - least + 1) if len(where[tuple(p[k : k + least])]) > 1 for q in range(k, k + least)}
            assert {q for q in range(len(p)) if covered[q]} == want


@pytest.mark.parametrize("version", [1, 2])
def test_archives(spark, version):
    rows = [(1, "http://h/a b", "<p>x</p>", 1), (2, "http://h/b", "<p>x</p>", 1), (3, "http://h/\n", "", 1), (4, None, None, 1), (5, "http://h/é", "ü\r\n\r\nWARC/1.1\r\n", 1), (None, "u", "<p>x</p>", 1), (2, "http://h/b", "<p>x</p>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.through_archives(df, version).collect()), key=repr)
    assert got == sorted([(1, 8, "revisit", 2), (2, 8, "response", None), (2, 8, "response", None), (None, 8, "revisit", 2), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 16, "response", None)], key=repr)
    assert {r.record_type for r in warc.through_archives(df, version, min_bytes=100).collect()} == {"response"}
    content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nhi\n\n"
    data = warc.arc_bytes([("http://a/ b", "1.2.3.4", "20240102030405", "text/html", content), ("u", "0.0.0.0", "20240102030405", "text/html", b"")], version)
    parsed = list(warc.parse_arc(data))
    assert [p["content"] for p in parsed] == [content, b""] and parsed[0]["URL"] == "http://a/%20b"
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-20]))
    assert warc.through_archives(df.limit(0), version).count() == 0
    files = [r.archive for r in warc.warc_archives(warc.deduplicated(warc.converted(warc.legacy_archives(df, version)))).collect()]
    kinds = [[f["WARC-Type"] for f, _ in warc.parse_warc(bytes(x))] for x in files]
    assert all(k[0] == "warcinfo" and "warcinfo" not in k[1:] for k in kinds) and sum(map(len, kinds)) - len(kinds) == 7


@pytest.mark.parametrize(("op", "column"), [(toxicity, "toxicity"), (quality, "quality_score")])
def test_classifiers_on_odd_tables(spark, op, column):
    docs = spark.createDataFrame(make_docs(6), SCHEMA)
    labels = spark.createDataFrame([(3, 1, 1), (6, 0, 0), (6, 0, 1), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        out = op.score(docs, op.fit(docs, known))
        rows = out.collect()
        assert len(rows) == docs.count() and all(0 <= r[column] <= 1 for r in rows) and set(docs.columns) <= set(out.columns)
        same = {r[column] for r in rows if not (r.text or "").strip()}
        assert len(same) <= 1
    assert op.score(docs.limit(0), op.fit(docs.limit(0), labels)).count() == 0


@pytest.mark.parametrize(("name", "label", "least"), [("op1_toxicity", "toxic", 0.8), ("op2_quality", "quality", 0.95)])
def test_held_out_rows_are_ranked_well(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES[name](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", label).collect()
    pos, neg = ([r.score for r in rows if r[1] == v] for v in (1, 0))
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc >= least


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    mine, theirs = same_rows(queries.QUERIES[name](spark, SF), duck, queries.ORACLE_SQL[name])
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
