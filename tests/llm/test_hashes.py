"""Different words whose hashes without a key are equal, through every operator that compares words by hash."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lodeweave.llm import ngram_join, packing, segments, substrings, text

PAIRS = [("qybaxhunaeaaaaaa", "yjtpmmxxnzerfmpt")]


def unmixed(h):
    """The value that `mix` scrambles to h."""
    mask = (1 << 64) - 1

    def back(x, k):
        out = x
        for _ in range(64 // k + 1):
            out = x ^ (out >> k)
        return out

    h = back(h, 31) * pow(0x94D049BB133111EB, -1, 1 << 64) & mask
    h = back(h, 27) * pow(0xBF58476D1CE4E5B9, -1, 1 << 64) & mask
    return back(h, 30)


def made_pairs(n, seed=3):
    """Pairs of 24-byte words with equal keyless hashes: the last blocks make up for what differs before. Any bytes but white space may occur."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        states, words = [], []
        for _ in range(2):
            w = bytes(rng.integers(97, 123, 16, np.uint8))
            h = int(text.mix(np.array([24 * int(text._STEP) % 2**64 ^ int.from_bytes(w[:8], "little")], np.uint64))[0])
            h = int(text.mix(np.array([h ^ int.from_bytes(w[8:], "little")], np.uint64))[0])
            states.append(h)
            words.append(w)
        last = [rng.integers(97, 123, 8, np.uint8).tobytes()]
        last.append((states[0] ^ states[1] ^ int.from_bytes(last[0], "little")).to_bytes(8, "little"))
        if not set(last[1]) & set(b" \t\n\v\f\r"):
            out.append((words[0] + last[0], words[1] + last[1]))
    return out


def test_the_pairs_are_equal_without_a_key():
    for a, b in [*((x.encode(), y.encode()) for x, y in PAIRS), *made_pairs(20)]:
        buf = np.frombuffer(a + b, np.uint8)
        start, end = np.array([0, len(a)]), np.array([len(a), len(a) + len(b)])
        plain, keyed = text.hashes(buf, start, end), text.hashes(buf, start, end, key=text.new_key())
        assert plain[0] == plain[1] and keyed[0] != keyed[1] and a != b
        strings = text.Strings()
        assert len(set(strings.numbers(buf, start, end, lambda f, t: None).tolist())) == 2
    assert unmixed(int(text.mix(np.array([12345], np.uint64))[0])) == 12345


@pytest.mark.parametrize("pair", PAIRS)
def test_ids_and_segments(pair):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    assert [x.tolist() for x in packing.token_ids([*pair, " ".join(pair)], path)] == [plain.encode(t, add_special_tokens=False).ids for t in [*pair, " ".join(pair)]]
    lattice = segments._lattice(public_tokenizers.path("piece_bpe_32k.model"))
    buf, offs = text.column_bytes(pa.array(pair))
    found = lattice.numbers(buf, offs[:-1], offs[1:], np.ones(2, np.int64))
    assert found[0] != found[1]
    assert lattice.numbers(buf, offs[:-1], offs[1:], np.array([2, 1]))[0] not in found.tolist()


@pytest.mark.parametrize("pair", PAIRS)
def test_joins_and_removals(spark, pair):
    few = "one two three four "
    docs = spark.createDataFrame([(1, few + pair[0]), (2, few + pair[1]), (3, few + pair[0])], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.classes(docs).collect()} == {1: 1, 2: 2, 3: 1}
    many = " ".join(f"w{i}" for i in range(34)) + " "
    docs = spark.createDataFrame([(1, many + pair[0]), (2, many + pair[1])], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.digests(docs).collect()} == {1: 0, 2: 0}
    docs = spark.createDataFrame([(1, many + pair[0]), (2, many + pair[1]), (3, many + pair[1])], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.digests(docs).collect()} == {1: 0, 2: 35, 3: 35}
