import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from conftest import same_rows
from llm_specs import SF
from pyspark.sql import functions as F

from lodeweave.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, name string, depth int"


def spec(rows, borrow=lambda c: zlib.crc32(str(c).encode()) % 9):
    """The trie's rows from plain dictionaries."""
    known = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            known[c].append((turn is not None, turn or 0, key, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in known.items()}
    base = lambda c: c - (c % 5 if c >= 0 else -(-c % 5))
    full = {c: own.get(base(c), [])[: borrow(c)] + ts[borrow(c) :] for c, ts in own.items()}
    members = defaultdict(list)
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, cs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(cs) - 1) * len(node[-1][1].encode()) if node else 0
    digest = lambda cs: hashlib.sha256(",".join(map(str, sorted(cs))).encode()).hexdigest()
    out = [(min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), len(kids[n]), leaves[n], saved[n], digest([c for c in cs if len(full[c]) == len(n)])) for n, cs in members.items()]
    return sorted(out, key=repr)


def made(seed, convs=60, most=14):
    """Conversations of few different turns, with copies, ties, nulls, one very long one and clashing columns."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 3 * convs), convs):
        for k in range(rng.randrange(1, most)):
            rows.append((c, rng.choice([k, k, k, None, 3]), rng.choice(["user", "user", "bot", None]), rng.choice(["a", "a", "bé", "", None]), "x", 1))
    rows += [(7000 + k, i, "user", "same", "x", 1) for k in range(12) for i in range(9)]
    rows += [(9001, i, "user", f"turn {i % 3}", None, None) for i in range(40)] + [(None, 1, "user", "no id", "x", 1)]
    rows += [rows[0], rows[0]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_dictionaries(spark, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "CHUNK_BYTES", 20)
    rows = made(seed)
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == spec(rows)


def test_trie_without_borrowing(spark):
    rows = made(4, 20)
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), F.lit(0))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == spec(rows, lambda c: 0)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(c, 0, "user", "one", "", 0) for c in range(1, 40) if c % 5]  # no base exists, so short ones lose all their turns
    got = sorted((tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == spec(rows) and any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in got)


def test_query_equals_its_sql(spark, duck):
    mine, theirs = same_rows(queries.op13_prefix_trie(spark, SF), duck, queries.ORACLE_SQL["op13_prefix_trie"])
    assert mine == theirs and len(mine) > 30
