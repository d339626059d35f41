import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from lodeweave.llm import segments as G

PATH = public_tokenizers.path("piece_bpe_32k.model")


def every(lattice, unit):
    """All segmentations with their weights, by recursion."""
    if not unit:
        return [((), 0.0)]
    return [((p[0], *s), p[1] + w) for i in range(1, len(unit) + 1) if (p := lattice.piece.get(unit[:i])) for s, w in every(lattice, unit[i:])]


def test_samples_against_enumeration():
    lattice, k, n = G._lattice(PATH), 3, 4000
    text = "the cat"
    drawn = G.drawn_ids(lattice, [text] * n, k, list(range(n)))
    found = every(lattice, lattice.model.normalize(text))
    total = np.logaddexp.reduce([w for _, w in found])
    prob = {s: math.exp(w - total) for s, w in found}
    first, pair, mean = Counter(), Counter(), 0.0
    for seed in range(n):
        got = drawn[seed]
        ids = [tuple(g[0].tolist()) for g in got]
        assert len(set(ids)) == k and [g[2] for g in got] == sorted((g[2] for g in got), reverse=True)
        assert all(abs(math.exp(g[1]) - prob[i]) < 1e-9 and 0 < g[3] <= 1 for g, i in zip(got, ids, strict=True))
        first[ids[0]] += 1
        pair[ids[:2] and (ids[0], ids[1])] += 1
        mean += sum(math.exp(g[1]) / g[3] * len(g[0]) for g in got) / n
    top = sorted(prob, key=prob.get, reverse=True)[:3]
    for a in top:
        assert abs(first[a] / n - prob[a]) < 0.03
        for b in top:
            if a != b:
                assert abs(pair[a, b] / n - prob[a] * prob[b] / (1 - prob[a])) < 0.03
    assert abs(mean - sum(p * len(s) for s, p in prob.items())) < 0.05


TEXTS = ["", " ", "   ", "  a", "a ", " ▁ b▁", "\n \n", "a  b\n①c\t", "x" * 300, "trail  ", "Ünï ﬁ 😀", "long words " * 3000, "a", "it's  two   spaces"]


def test_samples_decode_and_repeat():
    lattice = G._lattice(PATH)
    keys = [11] * len(TEXTS)
    got = G.drawn_ids(lattice, TEXTS, 4, keys)
    assert G.decode(G.encode(TEXTS, PATH), PATH) == [t.replace("▁", " ") for t in TEXTS]
    for text, f in zip(TEXTS, got, strict=True):
        text = text.replace("▁", " ")  # the mark itself reads as a space
        assert G.decode([g[0] for g in f], PATH) == [text] * len(f) == [lattice.model.decode(g[0].tolist()) for g in f]
        assert len({g[0].tobytes() for g in f}) == len(f)


def test_encoding_equals_the_models():
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab cdé  ①\nÜß-9") for _ in range(rng.randrange(60))) for _ in range(300)]
    model = G._lattice(PATH).model
    assert [e.tolist() for e in G.encode(texts, PATH)] == [model.encode(t) for t in texts]


def test_samples_depend_on_key_and_text_alone():
    """Neither the texts drawn together nor what the worker has seen before matters."""
    lattice = G._lattice(PATH)
    together = G.drawn_ids(lattice, TEXTS, 3, [7 + i % 3 for i in range(len(TEXTS))])
    lattice.clear()
    for i in reversed(range(len(TEXTS))):
        alone = G.drawn_ids(lattice, [TEXTS[i]], 3, [7 + i % 3])[0]
        assert [(g[0].tolist(), *g[1:]) for g in alone] == [(g[0].tolist(), *g[1:]) for g in together[i]]
    other = G.drawn_ids(lattice, ["long words " * 3000], 3, [99])[0]
    assert {g[0].tobytes() for g in other}.isdisjoint(g[0].tobytes() for g in together[TEXTS.index("long words " * 3000)])


def test_probabilities_against_enumeration_of_many_samples():
    """All segmentations of a short text come out, each once, with their probabilities, and noisy values that fall."""
    lattice = G._lattice(PATH)
    found = every(lattice, lattice.model.normalize("cats"))
    total = np.logaddexp.reduce([w for _, w in found])
    got = G.drawn_ids(lattice, ["cats"], len(found) + 5, [3])[0]
    assert {tuple(g[0].tolist()): round(g[1], 9) for g in got} == {s: round(w - total, 9) for s, w in found}
    assert len(got) == len(found) and all(g[3] == 1 for g in got) and [g[2] for g in got] == sorted((g[2] for g in got), reverse=True)


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a b", 5), (3, "one two", 5), (3, "one two", 5), (4, "x y " * 2000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sample int")
    out = G.sampled(df, PATH, 3).collect()
    assert all(r.decoded for r in out)
    assert sum(r.doc_id == 1 for r in out) == 1 and sum(r.doc_id == 4 for r in out) == 3
    twins = sorted(tuple(r) for r in out if r.doc_id == 3)
    assert twins[::2] == twins[1::2]
    assert G.sampled(df.limit(0), PATH).count() == 0


class Wide:
    """A unigram model whose pieces differ by more than a double's digits."""

    pieces = [("<unk>", 0.0), ("ab", -0.5), ("a", -30.25), ("b", -30.5), ("c", -1.5), ("bc", -400.5), ("abc", -0.25)]

    def get_piece_size(self):
        return len(self.pieces)

    def id_to_piece(self, i):
        return self.pieces[i][0]

    def get_score(self, i):
        return self.pieces[i][1]

    def is_unknown(self, i):
        return i == 0

    def is_byte(self, i):
        return False

    is_control = is_unused = is_byte

    def unk_id(self):
        return 0

    def normalize(self, text):
        return text

    def encode(self, texts, num_threads=1):
        return [[1]] * len(texts) if isinstance(texts, list) else [1]


@pytest.mark.parametrize("text", ["ab", "abc", "aab", "abcab"])
@pytest.mark.parametrize("k", [2, 3, 40])
def test_no_segmentation_is_too_unlikely(text, k):
    """Alternatives whose share is below what is left of 1 - p are drawn all the same, as many as are asked for."""
    lattice = G.Lattice(Wide())
    found = every(lattice, text)
    total = np.logaddexp.reduce([w for _, w in found])
    weights = {s: w - total for s, w in found}
    for key in range(20):
        got = G.drawn_ids(lattice, [text], k, [key])[0]
        assert len(got) == min(k, len(found)) == len({g[0].tobytes() for g in got})
        assert all(abs(weights[tuple(g[0].tolist())] - g[1]) < 1e-6 for g in got)
        assert [g[2] for g in got] == sorted((g[2] for g in got), reverse=True)


def test_all_segmentations_of_pieces_with_rare_parts():
    lattice = G._lattice(PATH)
    units = [p for p in lattice.piece if len(p) in (4, 5) and p[0] == "\u2581" and "\u2581" not in p[1:]]
    found = [every(lattice, u) for u in units]
    for f, got in zip(found, G.drawn_ids(lattice, [u[1:] for u in units], 20, [3] * len(units)), strict=True):
        assert {tuple(g[0].tolist()) for g in got} == {s for s, _ in f} and len(got) == len(f)


def test_rare_edges_are_drawn_directly(monkeypatch):
    """An edge whose share is less than 32 bits resolve is taken where the noise falls on it, and not beside it."""
    lattice = G._lattice(PATH)
    units, counts = G.unit_numbers(lattice, ["a"])
    node = int(lattice.base.data[units[0]]) + 1
    first, share = int(lattice.first.data[node]), math.exp(lattice.lp.data[int(lattice.first.data[node]) + 1])
    assert share < 2**-25
    for u, edge in ((1 - share / 2, first + 1), (1 - 2 * share, first)):
        monkeypatch.setattr(G, "noise", lambda seed, stream, place, u=u: np.full(len(place), u))
        edges, _ = lattice.draw(np.zeros(1, np.uint64), 0, units, lattice.size.data[units], np.zeros(1, np.int64))
        assert edges[0] == edge


def test_texts_that_do_not_decode_leave_others_alone(spark):
    """The mark itself reads as a space; rows behind such a text are compared with their own texts."""
    rows = [(1, "one two"), (2, "a \u2581 b"), (3, "three four"), (4, ""), (5, "five")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {(r.doc_id, r.decoded) for r in G.sampled(df, PATH, 3).collect()} == {(1, True), (2, False), (3, True), (4, True), (5, True)}


def test_segmentations_are_whole_and_give_the_digests(spark):
    words = {1: "one two", 2: "a \u2581 b", 3: None, 4: "x \u2460 y " * 2000}
    df = spark.createDataFrame(list(words.items()), "doc_id long, text string")
    out = G.segmentations(df, PATH, 3).collect()
    assert {r.doc_id: r.ids for r in out if not r.sample} == dict(zip(words, [e.tolist() for e in G.encode([w or "" for w in words.values()], PATH)], strict=True))
    assert all(r.decoded_text == (words[r.doc_id] or "").replace("\u2581", " ") == G.decode([np.array(r.ids, np.uint32)], PATH)[0] for r in out)
    crc = {(r.doc_id, r.sample): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in out}
    scores = {(r.doc_id, r.sample): (len(r.ids), r.log_prob, r.noisy, r.inclusion) for r in out if r.sample}
    digests = G.sampled(df, PATH, 3).collect()
    assert {(r.doc_id, r.sample): (r.n_pieces, r.log_prob, r.noisy, r.inclusion) for r in digests} == scores
    assert all(r.ids_crc32 == crc[r.doc_id, r.sample] and r.best_crc32 == crc[r.doc_id, 0] for r in digests)
    assert G.segmentations(df.limit(0), PATH).count() == 0


def test_a_full_memory_keeps_what_was_met_again(monkeypatch):
    """Beyond CACHE_NODES only what is rare is learned anew, and nothing that is drawn or encoded changes."""
    lattice = G._lattice(PATH)
    lattice.clear()
    texts = [*TEXTS, *(f"common words {i}  here ①②\n {'z' * (i % 7)}" for i in range(200))]

    def drawn():
        return [[(g[0].tolist(), *g[1:]) for g in f] for f in G.drawn_ids(lattice, texts, 3, list(range(len(texts))))]

    before, met = drawn(), lattice.size.n
    monkeypatch.setattr(G, "CACHE_NODES", lattice.first.n - 1)
    assert G._lattice(PATH) is lattice and 0 < lattice.size.n < met
    assert lattice.first.n <= G.CACHE_NODES // 4
    learned, learn = [], lattice._learn
    monkeypatch.setattr(lattice, "_learn", lambda units: (learned.extend(units), learn(units)))
    for _ in range(2):
        assert drawn() == before
        assert [e.tolist() for e in G.encode(texts, PATH)] == [lattice.model.encode(t) for t in texts]
    assert learned and {"▁common", "▁words", "▁▁here", "▁long"}.isdisjoint(learned)


@pytest.mark.parametrize("names", [None, [], ["a"], ["ab", "a", "b", "abc", "\U0010ffff"]])
def test_trie_leads_to_every_piece_and_to_nothing_else(names):
    names = list(G._lattice(PATH).piece) if names is None else names
    trie, index, rng = G.Trie(names), {n: i for i, n in enumerate(names)}, random.Random(2)
    number, base, parent, piece = (x.tolist() for x in (trie.number, trie.base, trie.parent, trie.piece))

    def walk(word):
        state = 0
        for c in word:
            to = base[state] + number[min(ord(c), len(number) - 1)]
            if parent[to] != state:
                return -1
            state = to
        return piece[state]

    others = ["".join(rng.choice("abcet▁①\U0001f600") for _ in range(rng.randrange(1, 6))) for _ in range(20000)]
    assert all(walk(w) == index.get(w, -1) for w in [*names, *others, "\U0010fffe", "\0"])


@pytest.mark.parametrize("k", [1, 2, 5])
def test_no_decision_among_the_largest_is_left_out(k):
    """Also where the noise is as small or as large as 52 bits allow."""
    rng = np.random.default_rng(k)
    for _ in range(300):
        at, ceiling = -np.cumsum(rng.exponential(2, 200)), float(rng.normal(0, 5))
        at[rng.random(200) < 0.3] = -np.inf
        u = rng.choice([2.0**-53, 0.5, 1 - 2.0**-53], 200)
        value = at - np.log(np.exp(np.minimum(at - ceiling, 700)) - np.log(u))
        last = np.sort(value)[-k]
        assert set(np.flatnonzero((value >= last) & (value > -np.inf)).tolist()) <= set(G.able(at, k, ceiling).tolist())
