"""The SQL twins of page functions and chunkers as second implementations, over made-up pages and texts."""

import random

import duckdb
import pytest

from lodeweave.functions import html as H
from lodeweave.operators import chunks, retrieval
from lodeweave.plans import catalogue

WORDS = ["one", "two &amp; three", "four", "&quot;five&quot;", " six ", "&lt;seven&gt;", "\n", "acht &middot; neun", "&copy;"]
TAGS = ["p", "p", "div", "article", "main", "nav", "header", "footer", "ul", "li", "b", "h1", "title", "section"]
CLASSES = ["", "", "", ' class="ads"', ' class="x post"', ' class="menu"', ' class="sidebar big"', ' class="content"', ' role="main"']


def made_up_page(rng):
    """Tags that nest, stay open, end what isn't open, and stand around comments and scripts."""
    out, open_ = ["<html><body>"], []
    for _ in range(rng.randrange(40)):
        kind = rng.random()
        if kind < 0.35:
            tag = rng.choice(TAGS)
            out.append(f"<{tag}{rng.choice(CLASSES)}>")
            open_.append(tag)
            if tag == "title":  # holds characters only
                out += ["A title", "</title>"]
                open_.pop()
        elif kind < 0.6 and open_:
            out.append(f"</{open_.pop(rng.randrange(len(open_)))}>")
        elif kind < 0.65:
            out.append(rng.choice(["<br>", "<img src='a.png'>", "<!-- <p>not this</p> -->", "<script>var a = '<p>no</p>';</script>", "<style>p{}</style>", "</td>"]))
        else:
            out.append(rng.choice(WORDS))
    return "".join(out) + rng.choice(["", "</body>", "</body></html>"])


def test_pages_by_a_second_parser():
    rng = random.Random(11)
    pages = [(i, f"https://h.test/{i}?q", made_up_page(rng)) for i in range(1500)] + [(1500, "https://h.test", ""), (1501, "https://h.test/x", "no tags")]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    found = {r[0]: r[1:] for r in con.sql(f"WITH {catalogue._EXTRACT} SELECT page_id, title, content, domain, word_count FROM extracted").fetchall()}
    main = dict(con.sql(f"WITH {catalogue._MAIN} SELECT page_id, {catalogue.D.sql_strip('t')} FROM lines").fetchall())
    seen = dict(con.sql(f"WITH {catalogue._VISIBLE} SELECT page_id, text FROM seen").fetchall())
    for i, url, html in pages:
        e = H.extract(url, html)
        assert found[i] == (e["title"], e["content"], e["domain"], e["word_count"]), html
        assert (main[i] or "") == H.cleaned(html), html
        assert seen[i] == H.visible_text(html), html


@pytest.mark.parametrize("seed", range(3))
def test_header_chunks_by_sql(seed):
    rng = random.Random(seed)
    line = lambda: rng.choice(["", "", "# A", "## B b", "#", "#no", "### ", "#  C ", "  # D", "x. " * rng.randrange(1, 900), "word " * rng.randrange(1, 120)])
    texts = [(i, "\n".join(line() for _ in range(rng.randrange(12)))) for i in range(150)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", texts)
    got = con.sql(f"WITH {catalogue._sql_sections('doc_id', 't')} SELECT doc_id, text, header, header_level, chunk_index, total FROM headed").fetchall()
    want = [(i, c["text"], c["header"], c["header_level"], c["chunk_index"], c["total"]) for i, t in texts for c in chunks.by_headers(t)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_question_is_embedded_like_a_column(spark):
    texts = ["", "one", "One two  two\tthree", None, "ä ö ü ß", "same same same", "\n \n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", retrieval.hashing_embedder(16)("t").alias("e")).collect()
    assert {r.i: r.e for r in rows} == {i: retrieval.hashed_question(t, 16) for i, t in enumerate(texts)}
    assert spark.createDataFrame([], "t string").select(retrieval.hashing_embedder(16)("t").alias("e")).count() == 0
