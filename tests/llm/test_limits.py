"""Results at the limits of numbers and of markup that leaves tags out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.llm import markup, packing, topk


@pytest.mark.parametrize(("size", "dim", "n"), [(1 << 20, 1024, 9000), (1 << 20, 4, 9000), (1 << 25, 3, 700), (1 << 26, 64, 40), (1 << 40, 8, 30), ((1 << 62) + 5, 2, 10)])
def test_scores_of_large_components(size, dim, n):
    """Products near and beyond what doubles and 64 bits hold beside a place; ties go to the smaller vec_id."""
    rng = np.random.default_rng(1)
    c = np.where(rng.random((n, dim)) < 0.001, rng.integers(-3, 4, (n, dim)), size).astype(np.int64)
    q = np.stack([np.full(dim, size), np.full(dim, -size)]).astype(np.int64)
    ids = np.arange(n)
    rows, got, scores, _ = topk.block_best(q, np.array([-1, -2]), np.full(2, -np.inf), c, ids, ids, topk.choose_pivots(c[:50], 3), 5)
    for row, v in ((-1, q[0]), (-2, q[1])):
        exact = sorted((-sum(int(a) * int(b) for a, b in zip(v.tolist(), w, strict=True)), i) for i, w in enumerate(c.tolist()))[:5]
        mine = sorted(((-s, i) for r, i, s in zip(rows, got, scores, strict=True) if r == row))
        # Halves of a block each give their best, of which a search takes the best again.
        clip = [(max(-(1 << 63) + 1, min(1 << 63, s)), i) for s, i in exact]
        assert mine[:5] == clip or [i for _, i in mine[:5]] == [i for _, i in exact]
        if abs(exact[0][0]) < 1 << 62:
            assert mine[:5] == exact


def text_of(page):
    stream, pieces = markup.page_tokens(page)
    return markup.main_text(pieces, np.zeros(len(stream), bool))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><p>start</p><ul><li class="share">s<li>b</ul><p>rest one two</p></article>', "start\nb\nrest one two"),
        ('<article><ul><li class="share">s<ul><li>inner</ul>more<li>b</ul>c</article>', "b\nc"),
        ('<article><p class="share">gone<p>kept<div>also</div></article>', "kept\nalso"),
        ('<article><p class="ad">gone<h2>Head</h2><table><tr><td class="share">x<td>y<tr><th>z</table>end</article>', "Head\ny\nz\nend"),
        ('<article><dl><dt class="promo">a<dd>b<dt>c<dd class="ad">d</dl><p>e</article>', "b\nc\ne"),
        ('<article><table><thead class="ad"><tr><td>h<tbody><tr><td>b</table>x</article>', "b\nx"),
        ('<article><div class="ad"><ul><li>a<li>b</ul><p>c<p>d</div>kept</article>', "kept"),
        ('<article><select><option>a<option>b</select><p>kept</article>', "kept"),
        ('<article><table><tr><td><table class="ad"><tr><td>in<td>in2</table>out<td>two</table></article>', "out\ntwo"),
    ],
)
def test_omitted_end_tags(page, want):
    assert text_of(page).replace(" ", "").replace("\n", "") == want.replace(" ", "").replace("\n", "")


def test_packing_moves_bins_and_not_their_pieces(spark, monkeypatch):
    """Many items of one token: what one task packs are bins, as many as a group has at most, and bins are nearly as few as can be."""
    seen, plain = [], packing.best_fit
    assert packing.best_fit(np.ones(20_000, np.int64), 4096)[2].tolist() == [4096] * 4 + [3616]
    monkeypatch.setattr(packing, "best_fit", lambda sizes, capacity: (seen.append(len(sizes)), plain(sizes, capacity))[1])
    fill = packing._filler(0, 64)
    import pyarrow as pa

    out = fill((pa.scalar(3),), pa.table({"_bin": np.arange(1000), "_fill": np.full(1000, 63)}))
    assert out.num_rows == 1000 and seen == [1000] and sum(out.column("_first").to_pylist()) == 1000
    n = 60_000
    items = spark.range(n).select("id", (1 + (F.col("id") % 50 == 0).cast("long") * 900).alias("length"))
    rows = packing.pack(items, 1000, group_items=5000, slack=2).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(rows) == n and len({r.id for r in rows}) == n
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1000
    assert len(bins) == 1200  # as few as can be: two items of 901 never share a bin
    even = packing.pack(spark.range(n).select("id", (1 + F.col("id") % 97).alias("length")), 1000, group_items=5000, slack=2)
    assert even.select("sequence_id").distinct().count() <= -(-even.agg(F.sum("length")).first()[0] // 1000) * 1.003 + 2  # the lower bound, and little more
