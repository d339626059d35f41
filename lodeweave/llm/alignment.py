"""Alignment of two tokenizers' ids over the same bytes.

Both tokenizers cut a text's bytes into tokens. The union of both arrays of token ends gives
the elementary intervals; each lies in one token of either side, which binary search in the
ends tells, and is one overlapping pair, a link. An end that both sides share closes a group.

Texts are taken in units that both tokenizers read by themselves (see `units`), so tokens,
groups and links of a text are those of its units; a worker aligns a unit once, and what it
knows of units is compared by their bytes. How many documents of the corpus hold a pair of ids
linked is counted by blocks of documents: a block tells each of its pairs once, with its number
of documents, so what is shuffled is as small as a block's vocabulary; the corpus-wide counts
come back to the block, where its documents are the sums over their units. No pair table is
sent to all, no task holds more than a block, and no document's links are written out.

Defined results: texts that are null or empty, or that one side's tokens don't spell, have no
tokens: all numbers are 0, the digest is the empty string. Every row is a document of its own,
even if its doc_id repeats; a null doc_id is kept; an empty table gives an empty result; other
columns are left behind.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.llm import text, units
from lodeweave.llm.shared import tidy, written

MARK = "▁"
#: Bytes of text, and documents, of one block at most; a longer text is a block of its own.
BLOCK_BYTES, BLOCK_DOCS = 12 << 20, 20_000
#: Units and pairs that a worker remembers; beyond it starts afresh with the next block.
CACHE_UNITS, CACHE_PAIRS = 500_000, 2_000_000
_state: dict[str, object] = {}
BLOCKS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, units binary, counts binary, sizes binary, places binary, times binary, a array<int>, b array<int>, n array<long>"


class _Side:
    """One tokenizer: how it reads many texts, and its ids' bytes and decimals."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[text.ragged(self.start[ids], self.size[ids])]


class ByteLevel(_Side):
    def __init__(self, path: str):
        self.tokenizer, entries = units.byte_tokenizer(path, plain_specials=True)
        super().__init__(entries)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces(_Side):
    """A SentencePiece model; texts are given with the space that it adds."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        super().__init__([bytes([int(name[3:5], 16)]) if m.is_byte(i) else name.replace(MARK, " ").encode() for i, name in enumerate(names)])
        # White space that some piece has behind another character; the others always begin a piece.
        inside = {c for name in names for b, c in itertools.pairwise(name.replace(MARK, " ")) if ord(c) < 128 and text.SPACE[ord(c)] and not (ord(b) < 128 and text.SPACE[ord(b)])}
        self.glued = "".join(sorted(inside)).encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Texts that begin with white space; a letter before it keeps the model from adding a space, and goes again."""
        out = []
        for ids in self.model.encode(["x" + t for t in texts], num_threads=1):
            n = k = 0
            while n < 2 and k < len(ids):  # the space that it adds, and the letter
                n += self.size[ids[k]]
                k += 1
            out.append(ids[k:])
        return out


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(end, owner in a, owner in b, whether both end there) of the elementary intervals of two rising arrays of ends over the same bytes."""
    end = np.union1d(a, b)
    in_a, in_b = np.searchsorted(a, end), np.searchsorted(b, end)
    return end, in_a, in_b, (a[in_a] == end) & (b[in_b] == end)


def _decimals(size: int) -> tuple[list[bytes], np.ndarray]:
    """Every id followed by nothing, a comma, a bar, a semicolon."""
    table = [b"%d%s" % (i, s) for s in (b"", b",", b"|", b";") for i in range(size)]
    return table, np.array(list(map(len, table)), np.int64)


class Aligner:
    """What is known of units: tokens, groups, links, the groups' text, and their distinct pairs of ids."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        shown = [_decimals(len(s.size)) for s in (self.a, self.b)]
        self.table, self.table_size = shown[0][0] + shown[1][0], np.concatenate([shown[0][1], shown[1][1]])
        self.clear()

    def clear(self) -> None:
        self.units, self.pairs, self.strings = text.Strings(), text.Numbers(), []
        self.facts = np.zeros((4, 1 << 12), np.int64)  # numbers of tokens of either side, groups, links; -1 where bytes differ
        self.pair_of, self.times, self.used = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0
        self.start, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.pair_key = np.zeros(1 << 12, np.uint64)

    def _learn(self, buf: np.ndarray, first: np.ndarray, last: np.ndarray, alone: bool) -> None:
        many, k = len(first), self.units.n - len(first)
        ids, counts = [], []
        for side in (self.a, self.b):
            i, n = units.split_up(side.encode, lambda t, s=side: s.encode([t])[0], side.size, buf, first, last, alone)
            ids.append(i)
            counts.append(n)
        want = buf[text.ragged(first, last - first)]
        good = np.ones(many, bool)
        for side, i, n in zip((self.a, self.b), ids, counts, strict=True):
            got = side.spell(i)
            if len(got) != len(want) or (got != want).any():
                at, to = np.concatenate([[0], np.cumsum(n)]).tolist(), np.concatenate([[0], np.cumsum(last - first)]).tolist()
                good &= [np.array_equal(side.spell(i[at[u] : at[u + 1]]), want[to[u] : to[u + 1]]) for u in range(many)]
        ids = [i[np.repeat(good, n)] for i, n in zip(ids, counts, strict=True)]
        counts = [np.where(good, n, 0) for n in counts]
        borders = np.cumsum(np.where(good, last - first, 0))
        ends = [np.cumsum(side.size[i]) for side, i in zip((self.a, self.b), ids, strict=True)]
        end, in_a, in_b, shared = overlaps(*ends)
        unit = np.searchsorted(borders, end)
        links, groups = np.bincount(unit, minlength=many), np.bincount(unit[shared], minlength=many)
        self._spell_groups(ids, ends, end[shared], unit[shared], many)
        key = ids[0][in_a].astype(np.uint64) << np.uint64(32) | ids[1][in_b].astype(np.uint64)
        hashed = text.mix(key + np.uint64(1))  # one to one
        distinct, at = np.unique(hashed, return_index=True)
        fresh = self.pairs.find(distinct) < 0
        self.pair_key = text.grown(self.pair_key, self.pairs.n + int(fresh.sum()))
        self.pair_key[self.pairs.n : self.pairs.n + int(fresh.sum())] = key[at[fresh]]
        self.pairs.add(distinct[fresh])
        held, times = np.unique(unit << 32 | self.pairs.find(hashed), return_counts=True)
        self.start, self.n = text.grown(self.start, self.units.n), text.grown(self.n, self.units.n)
        self.pair_of, self.times = text.grown(self.pair_of, self.used + len(held)), text.grown(self.times, self.used + len(held))
        self.pair_of[self.used : self.used + len(held)], self.times[self.used : self.used + len(held)] = held & 0xFFFFFFFF, times
        self.n[k : self.units.n] = sizes = np.bincount(held >> 32, minlength=many)
        self.start[k : self.units.n] = self.used + np.cumsum(sizes) - sizes
        self.used += len(held)
        if self.units.n > self.facts.shape[1]:
            self.facts = np.concatenate([self.facts, np.zeros((4, max(self.units.n - self.facts.shape[1], self.facts.shape[1])), np.int64)], axis=1)
        self.facts[:, k : self.units.n] = np.where(good, np.stack([*counts, groups, links]), -1)

    def _spell_groups(self, ids: list[np.ndarray], ends: list[np.ndarray], closes: np.ndarray, unit: np.ndarray, many: int) -> None:
        """Append every unit's groups as text: of each group its A ids, then its B ids."""
        group = np.concatenate([np.searchsorted(closes, e) for e in ends])
        side = np.repeat([0, 1], [len(i) for i in ids])
        code = np.concatenate(ids).astype(np.int64)
        order = np.argsort(group * 2 + side, kind="stable")
        group, side, code = group[order], side[order], code[order]
        of_unit = unit[group]
        same_group, same_side, same_unit = (np.append(x[1:] == x[:-1], False) for x in (group, side, of_unit))
        mark = np.where(~same_unit, 0, np.where(~same_group, 3, np.where(same_side, 1, 2)))
        row = np.where(side == 0, mark * len(self.a.size) + code, 4 * len(self.a.size) + mark * len(self.b.size) + code)
        whole = b"".join(map(self.table.__getitem__, row.tolist()))
        to = np.concatenate([[0], np.cumsum(np.bincount(of_unit, weights=self.table_size[row], minlength=many).astype(np.int64))]).tolist()
        self.strings += [whole[i:j] for i, j in itertools.pairwise(to)]

    def numbers(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unit numbers of texts given by their bytes, each with a space before it, and the rows' offsets among them."""
        whole = units.aside(buf, offs)
        starts, ends, rows = units.cut(buf, offs, self.b.glued)
        row = np.repeat(np.arange(len(whole)), np.diff(rows))
        keep = ~whole[row]
        out = self.units.numbers(buf, starts[keep], ends[keep], lambda f, t: self._learn(buf, f, t, False))
        if not whole.any():
            return out, rows
        odd = self.units.numbers(buf, offs[:-1][whole], offs[1:][whole], lambda f, t: self._learn(buf, f, t, True))
        row = np.concatenate([row[keep], np.flatnonzero(whole)])
        order = np.argsort(row, kind="stable")
        return np.concatenate([out, odd])[order], np.searchsorted(row[order], np.arange(len(whole) + 1))


def with_space(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes with a space before each."""
    to = offs + np.arange(len(offs))
    out = np.full(len(buf) + len(offs) - 1, 0x20, np.uint8)
    own = np.ones(len(out), bool)
    own[to[:-1]] = False
    out[own] = buf
    return out, to


class _Block:
    """Documents of a block until it closes."""

    def __init__(self):
        self.docs, self.bytes, self.held = [], 0, np.zeros(0, np.int64)

    def add(self, aligner: Aligner, doc_ids: list[int | None], buf: np.ndarray, offs: np.ndarray) -> None:
        empty = offs[1:] == offs[:-1]
        numbers, rows = aligner.numbers(*with_space(buf, offs))
        facts = aligner.facts[:, numbers]
        sums = np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(facts, axis=1)], axis=1)
        totals = sums[:, rows[1:]] - sums[:, rows[:-1]]
        wrong = np.concatenate([[0], np.cumsum(facts[0] < 0)])
        none = empty | (wrong[rows[1:]] > wrong[rows[:-1]])
        row = np.repeat(np.arange(len(none)), np.diff(rows))
        distinct, counts = np.unique((row << 40 | numbers)[~none[row]], return_counts=True)
        row, unit = distinct >> 40, distinct & ((1 << 40) - 1)
        # The documents that hold each pair: every document's pairs once.
        n = aligner.n[unit]
        pairs = np.unique(np.repeat(row, n) << 32 | aligner.pair_of[text.ragged(aligner.start[unit], n)]) & 0xFFFFFFFF
        here = np.bincount(pairs, minlength=aligner.pairs.n)
        here[: len(self.held)] += self.held
        self.held = here
        at = np.searchsorted(row, np.arange(len(none) + 1)).tolist()
        numbers, rows = numbers.tolist(), rows.tolist()
        for i, doc_id in enumerate(doc_ids):
            digest = "" if none[i] else hashlib.sha256(b";".join(map(aligner.strings.__getitem__, numbers[rows[i] : rows[i + 1]]))).hexdigest()
            self.docs.append((doc_id, *([0] * 4 if none[i] else totals[:, i].tolist()), digest, unit[at[i] : at[i + 1]], counts[at[i] : at[i + 1]]))
        self.bytes += len(buf)

    def close(self, aligner: Aligner, block: int) -> Iterator[pa.RecordBatch]:
        """The block's documents, then the block: units are numbered anew, and so are pairs."""
        known = np.unique(np.concatenate([d[6] for d in self.docs]))
        size = aligner.n[known]
        at = text.ragged(aligner.start[known], size)
        pairs = np.flatnonzero(self.held)
        place = np.searchsorted(pairs, aligner.pair_of[at])
        key = aligner.pair_key[pairs]
        rows = [(block, *d[:6], np.searchsorted(known, d[6]).astype("<u4").tobytes(), d[7].astype("<u4").tobytes(), None, None, None, None, None, None) for d in self.docs]
        rows.append((block, *[None] * 8, size.astype("<u4").tobytes(), place.astype("<u4").tobytes(), aligner.times[at].astype("<u4").tobytes(), (key >> np.uint64(32)).astype(np.int32), (key & np.uint64(0xFFFFFFFF)).astype(np.int32), self.held[pairs]))
        kinds = [*[pa.int64()] * 6, pa.string(), *[pa.binary()] * 5, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        for lo in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 2000], strict=True), kinds, strict=True)], names)


def _aligner(path_a: str, path_b: str) -> Aligner:
    if _state.get("paths") != (path_a, path_b):
        _state.update(paths=(path_a, path_b), aligner=Aligner(path_a, path_b))
    return _state["aligner"]


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Documents with their tokens, groups and links, in blocks; of each block one more row has its units' pairs and the pairs' numbers of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block, seq = _aligner(path_a, path_b), _Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, buf, offs in text.groups(batch.column("text"), 4 * text.CHUNK_BYTES):
                if block.docs and (block.bytes + len(buf) > BLOCK_BYTES or len(block.docs) + hi - lo > BLOCK_DOCS):
                    yield from block.close(aligner, seq)
                    block, seq = _Block(), seq + 1
                    if aligner.units.n > CACHE_UNITS or aligner.pairs.n > CACHE_PAIRS:
                        aligner.clear()
                block.add(aligner, batch.column("doc_id").slice(lo, hi - lo).to_pylist(), buf, offs)
        if block.docs:
            yield from block.close(aligner, seq)
        if aligner.units.n > CACHE_UNITS or aligner.pairs.n > CACHE_PAIRS:
            aligner.clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), BLOCKS)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, n_docs, best) of all linked pairs of ids: how many documents hold it, and whether no pair of its A id is held by more."""
    each = rows.where("a IS NOT NULL").select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("p.a", "p.b", "p.n")
    counts = each.groupBy("a", "b").agg(F.sum("n").alias("n_docs"))
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))  # a group has B's vocabulary at most


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    rows = written(blocks(docs, path_a, path_b), "aligned")
    each = rows.where("a IS NOT NULL").select("block", F.posexplode(F.arrays_zip("a", "b")).alias("at", "p")).select("block", "at", "p.a", "p.b")
    scored = each.join(pair_counts(rows), ["a", "b"]).select(F.col("block").alias("of"), "at", "n_docs", "best")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def fold(mine: pa.Table, pairs: pa.Table) -> pa.Table:
        own = mine.column("sizes").is_valid()
        info, found = mine.filter(own).to_pylist(), mine.filter(pa.compute.invert(own))
        size, place, times = (np.frombuffer(info[0][c], "<u4").astype(np.int64) for c in ("sizes", "places", "times"))
        docs_of, best_of = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
        at = pairs.column("at").to_numpy()
        docs_of[at], best_of[at] = pairs.column("n_docs").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
        border = np.concatenate([[0], np.cumsum(size)])
        per_unit = [np.diff(np.concatenate([[0], np.cumsum(times * x[place])])[border]) for x in (best_of, docs_of)]
        data = [np.frombuffer(b"".join(found.column(c).to_pylist()), "<u4").astype(np.int64) for c in ("units", "counts")]
        ends = np.concatenate([[0], np.cumsum(pa.compute.binary_length(found.column("units")).to_numpy() // 4)])
        n_best, count_sum = (np.diff(np.concatenate([[0], np.cumsum(data[1] * x[data[0]])])[ends]) for x in per_unit)
        return pa.table([*(found.column(c) for c in names[:5]), pa.array(n_best), pa.array(count_sum), found.column("groups_sha256")], names)

    left = rows.select("block", *names[:5], "groups_sha256", "units", "counts", "sizes", "places", "times")
    return left.groupBy("block").cogroup(scored.groupBy("of")).applyInArrow(fold, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
