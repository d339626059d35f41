import os
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeweave.llm import text

ROOT = str(Path(__file__).resolve().parents[2])
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab Cß\t\n\x0b \x1cé", max_size=40)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 64))
def test_words_and_hashes(texts, limit):
    seen = {}
    got = []
    for _, _, buf, offs in text.groups(pa.array(texts, pa.string()), limit):
        starts, ends, rows = text.words(buf, offs)
        h = text.hashes(buf, starts, ends)
        for i in range(len(offs) - 1):
            words = [bytes(buf[a:b]).decode() for a, b in zip(starts[rows[i] : rows[i + 1]], ends[rows[i] : rows[i + 1]], strict=True)]
            got.append(words)
            for w, x in zip(words, h[rows[i] : rows[i + 1]].tolist(), strict=True):
                assert seen.setdefault(w, x) == x
    assert got == [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_sequences_depend_on_their_values_only():
    v = np.array([5, 6, 7, 5, 6, 7, 8], np.uint64)
    h = text.sequences(v, 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 4
    assert len(text.sequences(v, 8)) == 0


def test_sliced_and_large_columns():
    col = pa.array(["aa", None, "b c", ""], pa.string())
    for c in (col.slice(1), col.cast(pa.large_string()).slice(1)):
        buf, offs = text.column_bytes(c)
        assert bytes(buf) == b"b c" and offs.tolist() == [0, 0, 3, 3]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab C1!\t", max_size=30), max_size=6), st.integers(1, 9))
def test_runs_in_passes(texts, step):
    """Runs don't depend on how many bytes a pass handles."""
    kind = np.zeros(256, np.uint8)
    kind[[97, 98, 67]], kind[49], kind[33] = 1, 2, 3
    buf, offs = text.column_bytes(pa.array(texts, pa.string()))
    whole, before = text.runs(buf, offs, kind), text.PASS_BYTES
    try:
        text.PASS_BYTES = step
        parts = text.runs(buf, offs, kind)
    finally:
        text.PASS_BYTES = before
    assert all(a.tolist() == b.tolist() for a, b in zip(whole, parts, strict=True))
    got = [bytes(buf[a:b]).decode() for a, b in zip(*whole[:2], strict=True)]
    assert got == [m for t in texts for m in re.findall("[abC]+|1+|!+", t)]


def thue_morse(n, a, b):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return [(a, b)[x] for x in bits], [(b, a)[x] for x in bits]


@pytest.mark.parametrize("n", [64, 256, 1024, 2048, 4096])
def test_patterns_do_not_collide(n):
    one, two = ("".join(x) for x in thue_morse(n, "a", "b"))
    buf, offs = text.column_bytes(pa.array([one, two]))
    assert len(set(text.hashes(buf, *text.words(buf, offs)[:2]).tolist())) == 2
    words = [np.array(x, np.uint64) for x in thue_morse(n, 5, 9)]
    assert text.sequences(words[0], n)[0] != text.sequences(words[1], n)[0]


def test_hash_follows_table_length_and_content():
    buf, offs = text.column_bytes(pa.array(["Abcdefgh", "abcdefgh", "abcdefg", "abcdefgh\0", "x" * 300, "X" * 300, "x" * 301]))
    starts, ends, _ = text.words(buf, offs)
    assert len(set(text.hashes(buf, starts, ends).tolist())) == 7
    low = text.hashes(buf, starts, ends, text.LOWER)
    assert low[0] == low[1] and low[4] == low[5] and len(set(low.tolist())) == 5
    every = text.short_grams(np.frombuffer(b"abcabcab", np.uint8), 3)
    at = np.arange(6)
    assert every.tolist() == text.hashes(np.frombuffer(b"abcabcab", np.uint8), at, at + 3).tolist() and every[0] == every[3]


MEASURE = """
import resource
import numpy as np, pyarrow as pa
from lodeweave.llm import fingerprints, ngram_join, quality, substrings, text, toxicity

rng = np.random.default_rng(0)
data = rng.integers(97, 123, 100_000_000).astype(np.uint8)
data[rng.random(len(data)) < 0.15] = 32
column = pa.array([data.tobytes()], pa.large_binary()).cast(pa.large_string())
del data
words = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for _, _, buf, offs in text.groups(column):
    {call}
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss) / 1024)
"""


@pytest.mark.parametrize("call", ["ngram_join.shingle_sets(buf, offs)", "fingerprints.anchors(buf, offs)", "toxicity.word_features(buf, offs)", "quality.token_features(buf, offs)", "ngram_join.twofold_sets(buf, offs, (1, 2))", "list(substrings._word_hashes(column)); substrings.stretches(text.hashes(buf, *text.words(buf, offs)[:2]), text.words(buf, offs)[2])"])
def test_text_of_100_mb_fits_into_an_executor(call):
    out = subprocess.run([sys.executable, "-c", MEASURE.replace("{call}", call)], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": ROOT}, timeout=300)
    assert float(out.stdout) < 2500
