import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm_specs import SCHEMA, SF, make_docs
from tokenizers import Tokenizer

from lodeweave.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = Tokenizer.from_file(A)
TOKENIZER.encode_special_tokens = True
MODEL = sentencepiece.SentencePieceProcessor(model_file=B)
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE = {chr(b): b for b in SHOWN} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in SHOWN)}


def tokens(t):
    """(id, bytes) of both sides, or nothing."""
    if not t:
        return [], []
    a = [(i, bytes(BYTE[c] for c in TOKENIZER.id_to_token(i))) for i in TOKENIZER.encode(" " + t, add_special_tokens=False).ids]
    b = [(i, bytes([int(MODEL.id_to_piece(i)[3:5], 16)]) if MODEL.is_byte(i) else MODEL.id_to_piece(i).replace("▁", " ").encode()) for i in MODEL.encode(t)]
    whole = (" " + t).encode()
    return (a, b) if b"".join(x for _, x in a) == b"".join(x for _, x in b) == whole else ([], [])


def spec(rows):
    """The rows from plain loops over all pairs of tokens that may overlap."""
    found, holders = [], defaultdict(int)
    for r in rows:
        a, b = tokens(r[1])
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links, lo = [], 0
        for i, s, e in spans[0]:
            while lo < len(spans[1]) and spans[1][lo][2] <= s:
                lo += 1
            k = lo
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        shared = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, at = [], 0
        for e in shared:
            groups.append("|".join(",".join(str(i) for i, s, t in side if at <= s and t <= e) for side in spans))
            at = e
        for p in set(links):
            holders[p] += 1
        found.append((r[0], len(a), len(b), links, groups))
    most = defaultdict(int)
    for (a, _), n in holders.items():
        most[a] = max(most[a], n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return sorted(((d, na, nb, len(g), len(ls), sum(holders[p] == most[p[0]] for p in ls), sum(holders[p] for p in ls), digest(g)) for d, na, nb, ls, g in found), key=repr)


def odd_texts(seed, n):
    rng = random.Random(seed)
    alphabet = [*"abcdeéXY'ß€漢🙂1234 .,!<|>-;)}{", "\n", "\t", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "　", "▁", "<|endoftext|>", "<s>", "<0x41>", "'s", "  ", "\x00", "​"]
    return ["".join(rng.choice(alphabet if rng.random() < 0.2 else alphabet[:12] + [" "] * 4 + ["\r", ";", "\n"]) for _ in range(rng.randrange(0, 50))) for _ in range(n)]


@pytest.mark.parametrize("block", [12 << 20, 100])
def test_alignment_against_loops(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "CACHE_UNITS", block)
    rows = make_docs(2) + [(1000 + i, t, "en", 0.0, "", 0, 0, "") for i, t in enumerate(odd_texts(block, 700))]
    rows += [(1, " leading", None, 0.0, "", 0, 0, ""), (2, "trailing  ", None, 0.0, "", 0, 0, ""), (3, " ", None, 0.0, "", 0, 0, ""), (4, "\r", None, 0.0, "", 0, 0, ""), (5, "\n", None, 0.0, "", 0, 0, "")]
    got = alignment.aligned(spark.createDataFrame(rows, SCHEMA).repartition(3), A, B)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == spec(rows)


def test_alignment_of_an_empty_table(spark):
    assert alignment.aligned(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    assert [tuple(r) for r in alignment.aligned(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_query_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op11_alignment(spark, SF).collect()), key=repr) == spec(rows)


def test_overlaps():
    a, b = np.array([2, 5, 9]), np.array([3, 5, 6, 9])
    end, in_a, in_b, shared = alignment.overlaps(a, b)
    assert end.tolist() == [2, 3, 5, 6, 9] and in_a.tolist() == [0, 1, 1, 2, 2] and in_b.tolist() == [0, 0, 1, 2, 3] and shared.tolist() == [False, False, True, False, True]
