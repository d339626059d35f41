"""The prefix trie of conversations: every distinct sequence of first turns is a node.

Sequences get names by prefix doubling. Turns get dense numbers by their role and text; a
block of 2^k turns that begins at a multiple of 2^k is named by the names of its two halves,
one round for each k. A prefix of d turns is the chain of blocks that d's binary digits give,
the longest first: from the prefixes whose length is a multiple of 2^(k+1), round k makes
those that one more block of 2^k turns ends. So rounds are logarithmic in the longest
conversation and all of them together handle about two rows for each turn; equal names mean
equal sequences, since names are joined on and never hashed.

Prefixes with one name are a node. What a node sums over its subtree is gathered in log rounds
as well, by pointers to the ancestor 2^k levels up, and only for nodes with two members or
more: below a node with one member there is one leaf and nothing to save.

Turns are put in order by a range sort, not by one task for each conversation: a conversation
may hold any share of the rows. Its place in a range and the ranges before it give a turn's number.

Defined results: null role or text is empty; turns of equal number are ordered by the hash of role
and text; repeated rows are turns of their own; rows with null conv_id take no part; c % 5 has the
sign of c; an empty table has no node, not even the root; other columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.shared import discard, tidy, written

#: Members' ids, as text, that one row of an unfinished list holds, in bytes.
CHUNK_BYTES = 1 << 14


def turn_key(role: Column, text: Column) -> Column:
    """What tells turns apart: SHA-256 of role and text, and where the one ends."""
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def in_turn(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, key, bytes) of conversations (conv_id, turn, role, text): pos is 0 for the first turn."""
    role, body = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    keyed = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_key(role, body).alias("key"), F.octet_length(body).cast("long").alias("bytes"))
    ordered = keyed.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "key").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "key")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, 0  # the conversation that the batch before ended in, and how many of its turns are through
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            pos = np.arange(len(conv)) - np.repeat(starts, np.diff(np.append(starts, len(conv))))
            if last == conv[0]:
                pos[: starts[1] if len(starts) > 1 else len(conv)] += done
            last, done = conv[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(pos), batch.column("key"), batch.column("bytes")], ["conv_id", "pos", "key", "bytes"])

    counted = ordered.select("conv_id", "key", "bytes").mapInArrow(tidy(count), "conv_id long, pos long, key string, bytes long")
    turns = written(counted.withColumn("part", F.spark_partition_id()), "turns")
    # One row for each partition: which conversations it begins and ends with, and how far it got in the last one.
    ends = turns.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "pos")).alias("last")).orderBy("part").collect()
    rows, last, done = [], None, 0
    for r in ends:
        before = done if r["first"] == last else 0
        rows.append((r.part, r["first"], before))
        done = r["last"].pos + 1 + (before if r["last"].conv_id == r["first"] else 0)
        last = r["last"].conv_id
    borders = F.broadcast(turns.sparkSession.createDataFrame(rows, "part int, first long, before long"))
    return turns.join(borders, "part").select("conv_id", (F.col("pos") + F.when(F.col("conv_id") == F.col("first"), F.col("before")).otherwise(0)).alias("pos"), "key", "bytes")


def rebuilt(turns: DataFrame, borrow: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, key, bytes) and (conv_id, n) of conversations whose first `borrow` turns come from the one c - c % 5."""
    h = F.crc32(F.col("conv_id").cast("string")) % 9 if borrow is None else borrow
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = sizes.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    theirs = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_n"))
    convs = convs.join(theirs, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = written(convs, "convs")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "bytes")
    most = convs.agg(F.max("h")).first()[0] or 0
    heads = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    lent = convs.select("conv_id", "base", "taken").join(heads, "base").where("pos < taken").select("conv_id", "pos", "key", "bytes")
    return own.unionByName(lent), convs.select("conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("n"))


def dense(distinct: DataFrame, first: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """The rows with `name` from `first` on, without gaps; the table behind them; the number after the last. Only the partitions' counts reach the driver."""
    rows = written(distinct.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "names")
    offsets = []
    for r in rows.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("at")).orderBy("_part").collect():
        offsets.append((r["_part"], first - r["at"]))
        first += r["n"]
    known = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_part int, _plus long"))
    return rows.join(known, "_part").withColumn("name", F.col("_at") + F.col("_plus")).drop("_part", "_at", "_plus"), rows, first


def named(rows: DataFrame, keys: list[str], first: int = 0) -> tuple[DataFrame, int]:
    """The rows with the dense name of their keys in place of these, as a written table."""
    names, behind, end = dense(rows.select(*keys).distinct(), first)
    out = written(rows.join(names, keys).drop(*keys), "named")
    discard(behind)
    return out, end


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, n, depth, name) of every prefix of every conversation (conv_id, n): name 0 is the empty one."""
    longest = convs.agg(F.max("n")).first()[0] or 0
    blocks, levels = [], longest.bit_length()
    if levels:
        blocks.append(named(turns.select("conv_id", F.col("pos").alias("j"), "key"), ["key"])[0])
    for _ in range(1, levels):
        odd, half = F.col("j") % 2 == 1, F.shiftright("j", 1)
        pairs = blocks[-1].groupBy("conv_id", half.alias("j")).agg(F.max(F.when(~odd, F.col("name"))).alias("a"), F.max(F.when(odd, F.col("name"))).alias("b")).where("b IS NOT NULL")
        blocks.append(named(pairs, ["a", "b"])[0])
    known, end, parts = convs.select("conv_id", "n", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name")), 1, []
    for k in reversed(range(levels)):
        block = blocks[k].select("conv_id", "j", F.col("name").alias("block"))
        on = known.where(F.col("n") - F.col("depth") >= 1 << k).withColumn("j", F.shiftright("depth", k)).join(block, ["conv_id", "j"])
        new, end = named(on.select("conv_id", "n", (F.col("depth") + (1 << k)).alias("depth"), F.col("name").alias("a"), "block"), ["a", "block"], end)
        parts.append(new)
        known = known.unionByName(new)
    out = written(known, "prefixes")
    discard(*blocks, *parts)
    return out


def member_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of (name, conv_id): the digest of each name's ids in order, comma-joined.

    A range sort cuts long lists into chunks, so a name with many ids is dealt out; only chunks of text go to the one task
    that, since a digest is a chain, takes them in turn, one at a time.
    """

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        name, parts, size, seq = None, [], 0, 0

        def close() -> None:
            nonlocal parts, size, seq
            if parts:
                held.append((name, seq, ",".join(parts)))
            parts, size, seq = [], 0, seq + 1

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["name", "seq", "ids"])
            held.clear()
            return out

        for batch in batches:
            for at, conv in zip(batch.column("name").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if at != name or size > CHUNK_BYTES:
                    close()
                    name = at
                parts.append(str(conv))
                size += len(parts[-1]) + 1
            if held:
                yield emit()
        close()
        if held:
            yield emit()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, chain = None, None
        for batch in batches:
            out = []
            for at, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if at == name:
                    chain.update(b",")
                else:
                    if chain is not None:
                        out.append((name, chain.hexdigest()))
                    name, chain = at, hashlib.sha256()
                chain.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["name", "ends_sha256"])
        if chain is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([chain.hexdigest()])], ["name", "ends_sha256"])

    chunks = ends.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(tidy(chunk), "name long, seq long, ids string")
    chunks = chunks.withColumn("part", F.spark_partition_id())
    return chunks.repartition("name").sortWithinPartitions("name", "part", "seq").select("name", "ids").mapInArrow(tidy(digest), "name long, ends_sha256 string")


def subtree_sums(nodes: DataFrame, columns: list[str], deepest: int) -> DataFrame:
    """`nodes` (name, parent, columns) with every column summed over the node's subtree, itself included."""
    state, old = nodes.select("name", F.col("parent").alias("up"), *columns), []
    for _ in range(deepest.bit_length()):
        gained = state.where("up IS NOT NULL").groupBy(F.col("up").alias("name")).agg(*[F.sum(c).alias(f"_{c}") for c in columns])
        further = state.where("up IS NOT NULL").select(F.col("name").alias("up"), F.col("up").alias("_up"))
        more = state.join(gained, "name", "left").join(further, "up", "left")
        state = written(more.select("name", F.col("_up").alias("up"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in columns]), "sums")
        discard(*old)
        old = [state]
    return state.select("name", *columns)


def trie(conversations: DataFrame, borrow: Column | None = None) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (conv_id, turn, role, text), as (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    turns, convs = rebuilt(in_turn(conversations), borrow)
    turns, convs = written(turns, "rebuilt"), written(convs, "lengths")
    steps = prefixes(turns, convs)
    nodes = steps.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"))
    before = steps.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    text = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "bytes")
    nodes = written(nodes.join(before, ["conv_id", "depth"], "left").join(text, ["conv_id", "depth"], "left"), "nodes")
    below = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single"))
    nodes = written(nodes.join(below, "name", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "single": F.coalesce("single", F.lit(0))}), "family")
    shared = nodes.where("n_convs > 1")
    sums = shared.select("name", "parent", ((F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0))).alias("saved"), (F.col("single") + F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long").alias("leaves"))
    sums = subtree_sums(sums, ["saved", "leaves"], shared.agg(F.max("depth")).first()[0] or 0)
    digests = member_digests(steps.where("depth = n"))
    parents = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, "name", "left").join(digests, "name", "left").join(parents, "parent", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
