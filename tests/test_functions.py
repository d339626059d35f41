import hashlib
import re

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeweave.functions import html as H
from lodeweave.functions import retry as R
from lodeweave.functions import text as T
from lodeweave.functions import urls as U


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


ODD = ["", "   ", "x" * 1000, "Äöü ß 😀 x y", "a\tb\nc\r\nd", "\x1ca\x1fb\x85", "Eins zwei. Drei? Vier!"]


def test_white_space_words_and_hashes(spark):
    x = F.col("x")
    assert values(spark, ODD, T.strip(x)) == [s.strip() for s in ODD]
    assert values(spark, ODD, T.word_count(x)) == [len(s.split()) for s in ODD]
    assert values(spark, ODD, T.dedupe_hash(x)) == [hashlib.sha256(s.lower().strip().encode()).hexdigest() for s in ODD]
    assert values(spark, ODD, T.content_hash(x)) == [hashlib.sha256(s.encode()).hexdigest() for s in ODD]
    got = values(spark, ODD, T.shingles(x))
    for s, g in zip(ODD, got, strict=True):
        w = s.lower().strip().split()
        assert set(g) == {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}


def test_clean_text(spark):
    rows = ["Cookie-Richtlinie hier", "COOKIES Notice und Datenschutzerklärung  x", "© 2024 alle an der Universität ende", "Impressum | Kontakt", "a\n\n b\tc", "DATENSCHUTZERKLÄRUNG"]

    def spec(s):
        for p in T.BOILERPLATE:
            s = re.sub(p, "", s, flags=re.I)
        return re.sub(r"\s+", " ", s).strip()

    assert values(spark, rows, T.clean_text(F.col("x"))) == [spec(s) for s in rows]
    assert values(spark, ["a \t b\n \n\nc"], T.clean_text(F.col("x"), preserve_newlines=True)) == ["a b\n\nc"]


def test_repeated_lines_and_substance(spark):
    text = "\n".join(["a long enough line"] * 3 + ["short"] * 5 + ["another line that stays", " a long enough line "])
    assert values(spark, [text], T.drop_repeated_lines(F.col("x"))) == ["\n".join(["short"] * 5 + ["another line that stays"])]
    good = "words that are long " * 10
    assert values(spark, [good, "a b " * 60, "short", ""], T.is_substantial(F.col("x"))) == [True, False, False, False]


def test_snippets(spark):
    quoted, late, closed = "w" * 210 + '." und weiter ' + "x" * 300, "z" * 399 + ".abc " + "z" * 50, "b" * 205 + "!) c " * 10
    rows = ["kurz", quoted, "y" * 500, late, "a " * 300, closed]
    # the end of the window ends a sentence as well as white space does
    want = ["kurz", quoted[:212], "y" * 200 + "…", late[:400], ("a " * 100).rstrip() + "…", closed[:207]]
    assert values(spark, rows, T.trim_snippet(F.col("x"))) == want
    assert values(spark, ["y" * 250], T.trim_snippet(F.col("x"), gate=300)) == ["y" * 250]


@pytest.mark.parametrize(("address", "ok"), [("a@b.de", True), ("first.last+tag@sub.host.org", True), ("no-at.de", False), ("@host.de", False), ("a@host", False), ("a@b.de\n", True)])
def test_email(spark, address, ok):
    assert values(spark, [address], T.is_email(F.col("x"))) == [ok]


def test_urls(spark):
    u = F.col("x")
    rows = ["https://a:b@H.test:8/de/Studium/x;p?q=1#f", "https://host.test/po-2020/plan.pdf", "no url", "https://host.test", "https://host.test/dekanat/"]
    from urllib.parse import urlparse

    assert values(spark, rows, U.netloc(u)) == [urlparse(r).netloc for r in rows]
    assert values(spark, rows, U.path(u)) == [urlparse(r).path for r in rows]
    assert values(spark, rows, U.query(u)) == [urlparse(r).query for r in rows]
    assert values(spark, rows, U.category(u)) == ["studium", "pruefungsordnungen", "allgemein", "allgemein", "fakultaet"]
    assert values(spark, rows, U.language(u)) == ["de", "unknown", "unknown", "unknown", "de"]
    assert values(spark, rows, U.document_type(u)) == [None, "Prüfungsordnung", None, None, None]
    assert values(spark, rows[1:2], U.pdf_filename(u)) == ["plan_" + hashlib.md5(rows[1].encode()).hexdigest()[:12] + ".pdf"]
    assert values(spark, rows[:1], U.document_id(u, F.lit(3))) == [hashlib.sha256(f"{rows[0]}#3".encode()).hexdigest()[:16]]


def test_retry(spark):
    config = R.RetryConfig(max_retries=3, initial_delay=0.1, max_delay=1.0)
    got = spark.range(6).select(R.backoff(F.col("id"), config).alias("d"), R.linear_backoff(F.col("id")).alias("l")).collect()
    assert all(0.05 * min(2**i, 10) <= r.d <= 0.15 * min(2**i, 10) + 1e-9 for i, r in enumerate(got))
    assert [r.l for r in got] == [2.0 * (i + 1) for i in range(6)]


PAGE = """<html><head><title>T &amp; t</title><meta name="description" content="d"><meta name=keywords content="a, b"></head><body><nav><a href="/n">N</a></nav>
<header>H</header><article class="post x"><p>One <b>bold</b><p>Two<img src="i.png" alt="A"></article><a href="../up#f">Up</a><script>var x="<p>";</script><div class="ads">buy</div><!-- c --></body></html>"""


def test_html():
    got = H.extract("https://h.test/d/e/", PAGE)
    assert got["title"] == "T & t" and got["description"] == "d" and got["keywords"] == ["a", " b"] and got["domain"] == "h.test"
    assert got["content"] == "OneboldTwo\n\nOneboldTwo\n\nTwo"  # unclosed paragraphs nest
    assert got["links"] == [{"url": "https://h.test/d/up#f", "text": "Up"}]
    assert got["images"] == [{"url": "https://h.test/d/e/i.png", "alt": "A", "title": ""}]
    assert H.crawl_links("https://h.test/d/e/", PAGE) == ["https://h.test/n", "https://h.test/d/up"]
    assert "buy" not in H.cleaned(PAGE) and H.cleaned(PAGE).startswith("One")
    assert H.extract(None, None)["content"] == "" and H.cleaned("") == "" and H.crawl_links("", "<a href='http://[x'>") == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/abp \n\"'=!-&;", max_size=80))
def test_html_never_fails(page):
    H.extract("https://h.test/", page)
    H.cleaned(page)
    H.crawl_links("https://h.test/", page)


def test_fields_of_few_pages_are_held_at_a_time(monkeypatch):
    assert list(H.runs([3, 4, 9, 1, 1], 8)) == [(0, 2), (2, 3), (3, 5)] and list(H.runs([], 8)) == []
    monkeypatch.setattr(H, "TOGETHER", 300)
    pages = [f"<a href='/{i}'>x{i}</a>" * (i + 1) for i in range(20)]
    batch = (pd.Series(["https://h.test/"] * 20), pd.Series(pages))
    out = list(H.extracted(iter([batch]), ["links"]))
    assert len(out) > 5 and [c for part in out for c in part["links"]] == [H.extract("https://h.test/", p)["links"] for p in pages]
