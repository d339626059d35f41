"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents become pieces of at most `capacity` tokens. Full pieces are sequences already.
The others are packed hierarchically: items are dealt into groups of bounded size, each
group is packed best-fit in order of falling length, nearly full bins leave, and the
underfull bins come back as items of fewer groups until one group holds them all or a
round no longer helps. A bin keeps the order and places of what it was made of.

Defined results: a null text is an empty one, whose only token is the end mark; every row
is a document of its own, even if its doc_id repeats; a null doc_id is kept; an empty
table gives an empty result; other columns are left behind.
"""

from __future__ import annotations

import itertools
import json
import unicodedata
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm import text
from lodeweave.llm.shared import tidy, written

END_ID = 1
#: Items that one task packs at a time.
GROUP_ITEMS = 20_000
#: A bin with at most this many free places is nearly full and leaves.
SLACK = 8
#: Words, and parts of them, whose ids a worker remembers; beyond it starts afresh.
CACHE_WORDS, CACHE_PARTS = 300_000, 100_000

_state: dict[str, object] = {}
# The normalizer and the pre-tokenizer's pattern of word_bpe_49k.json.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CUT = regex.compile(f"{_PRE_TOKENS}| ")
#: Bytes of texts that can't be taken word by word: separators that are no white space here, and first bytes of characters from
#: U+0530 on, whose classes differ between versions of Unicode. Up to there the tests hold every character against the tokenizer.
_ASIDE = np.zeros(256, bool)
_ASIDE[[*range(0x1C, 0x20), *range(0xD5, 0x100)]] = True
_ASIDE[0xE2] = False  # punctuation, see `aside`


def aside(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which rows hold something that only the tokenizer itself should read."""
    bad = _ASIDE[buf]
    after = np.concatenate([buf[1:], np.zeros(2, np.uint8)])
    wide = np.flatnonzero((buf == 0xC2) | (buf == 0xD4) | (buf == 0xE2) | (buf == 0x3C))
    one, two, three = buf[wide], after[wide], after[wide + 1]
    bad[wide] |= (one == 0xC2) & ((two == 0x85) | (two == 0xA0))  # white space beyond ASCII
    bad[wide] |= (one == 0xD4) & (two >= 0xB0)
    bad[wide] |= (one == 0x3C) & (two == 0x7C)  # perhaps a special token
    # U+2010 to 2027, U+2030 to 203E, U+20AC
    fine = (two == 0x80) & ((three >= 0x90) & (three <= 0xA7) | (three >= 0xB0) & (three <= 0xBE)) | (two == 0x82) & (three == 0xAC)
    bad[wide] |= (one == 0xE2) & ~fine
    sums = np.concatenate([[0], np.cumsum(bad)])
    return sums[offs[1:]] > sums[offs[:-1]]


class _Ids:
    """The ids of many strings, by number, in one growing array."""

    def __init__(self):
        self.flat, self.start, self.n, self.used, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0, 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        k, more = self.count, len(sizes)
        self.start, self.n, self.flat = _grown(self.start, k + more), _grown(self.n, k + more), _grown(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k : k + more] = self.used + np.cumsum(sizes) - sizes
        self.n[k : k + more] = sizes
        self.used += len(ids)
        self.count += more

    def of(self, numbers: np.ndarray) -> np.ndarray:
        n = self.n[numbers]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[numbers] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


def _tokenizer(path: str):
    """The tokenizer, and whether it works as _NORMALIZER and _PRE_TOKENS say, so that it may be asked word by word."""
    if _state.get("path") != path:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        parts = json.loads(Path(path).read_text(encoding="utf-8"))
        known = parts["model"].get("end_of_word_suffix") == "</w>" and parts["normalizer"] == _NORMALIZER and parts["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": _PRE_TOKENS}
        _state.update(path=path, tokenizer=Tokenizer.from_file(path), lean=None)
        if known:  # the same model for text that is normalised and cut already
            last = np.zeros(max(parts["model"]["vocab"].values()) + 1, bool)
            last[[k for word, k in parts["model"]["vocab"].items() if word.endswith("</w>")]] = True
            parts |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
            _state.update(lean=Tokenizer.from_str(json.dumps(parts)), last=last)
            _forget()
            _forget_parts()
    return _state["tokenizer"], _state["lean"] is not None


def _forget() -> None:
    _state.update(known=text.Strings(), words=_Ids())


def _forget_parts() -> None:
    _state.update(numbers={}, parts=_Ids())


def _learn(words: bytes) -> None:
    """Remember the ids of words, given with one space between: white space always ends a token, so a text's ids are those of its words in turn."""
    whole = words.decode()
    if not whole.isascii():
        whole = unicodedata.normalize("NFC", whole).replace("\u03a3", "\u03c3")  # lower() makes a final sigma, the tokenizer doesn't
    found = _CUT.findall(whole.lower())
    gaps = np.array([t == " " for t in found])
    tokens = [t for t in found if t != " "]
    per_word = np.diff(np.concatenate([[-1], np.flatnonzero(gaps), [len(found)]])) - 1
    if len(_state["numbers"]) > CACHE_PARTS:
        _forget_parts()
    number, parts = _state["numbers"], _state["parts"]
    look = lambda: np.fromiter(map(number.get, tokens, itertools.repeat(-1)), np.int64, len(tokens))
    numbers = look()
    fresh = list(dict.fromkeys(tokens[j] for j in np.flatnonzero(numbers < 0).tolist()))
    if fresh:
        # All are encoded as one text; an id that ends a word shows where the next one begins.
        ids = np.array(_state["lean"].encode_batch_fast([" ".join(fresh)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(_state["last"][ids]) + 1
        number.update(zip(fresh, range(parts.count, parts.count + len(fresh)), strict=True))
        parts.add(ids, np.diff(np.concatenate([[0], ends])))
        numbers = look()
    sizes = np.concatenate([[0], np.cumsum(parts.n[numbers])])
    borders = np.concatenate([[0], np.cumsum(per_word)])
    _state["words"].add(parts.of(numbers), np.diff(sizes[borders]))


def group_ids(buf: np.ndarray, offs: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts given by their bytes, as uint32 in turn, without special tokens added, and the texts' n + 1 offsets among them."""
    tokenizer, by_word = _tokenizer(path)
    alone = aside(buf, offs) if by_word else np.ones(len(offs) - 1, bool)
    counts, ids, numbers = np.zeros(len(offs) - 1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if not alone.all():
        starts, ends, rows = text.words(buf, offs)
        own = np.repeat(~alone, np.diff(rows))
        starts, ends = starts[own], ends[own]
        if _state["known"].n > CACHE_WORDS:
            _forget()
        numbers = _state["known"].numbers(buf, starts, ends, lambda first, last: _learn(text.joined(buf, first, last)))
        ids = _state["words"].of(numbers)
        borders = np.concatenate([[0], np.cumsum(np.where(alone, 0, np.diff(rows)))])
        counts = np.diff(np.concatenate([[0], np.cumsum(_state["words"].n[numbers], dtype=np.int64)])[borders])
    if alone.any():
        parts, at = [], 0
        for i in range(len(counts)):
            if alone[i]:
                found = np.array(tokenizer.encode(buf[offs[i] : offs[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
                counts[i] = len(found)
            else:
                found = ids[at : at + counts[i]]
                at += counts[i]
            parts.append(found)
        ids = np.concatenate(parts)
    return ids, np.concatenate([[0], np.cumsum(counts)])


def token_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """Every text's ids, as uint32, without special tokens added."""
    out = []
    for _, _, buf, offs in text.groups(pa.array(texts, pa.string())):
        ids, ends = group_ids(buf, offs, path)
        out += [ids[a:b] for a, b in itertools.pairwise(ends.tolist())]
    return out


def pieces(docs: DataFrame, path: str, capacity: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and end mark, cut at `capacity`."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text.groups(batch.column("text"), 4 * text.CHUNK_BYTES):
                rows: list[tuple] = []
                ids, ends = group_ids(buf, offs, path)
                ids = ids.astype("<u4", copy=False)
                for doc_id, (a, b) in zip(batch.column("doc_id").slice(lo, hi - lo).to_pylist(), itertools.pairwise(ends.tolist()), strict=True):
                    own = ids[a:b].tobytes() + end
                    for k, at in enumerate(range(0, len(own), 4 * capacity)):
                        part = own[at : at + 4 * capacity]
                        rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit in order of falling size: each item's bin, its place there, and every bin's fill."""
    order = np.argsort(-sizes, kind="stable")
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has r free places
    bins, place, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = open_bins[free].pop()
            if not open_bins[free]:
                mask ^= 1 << free
        else:
            b, free = len(fill), capacity
            fill.append(0)
        bins[i], place[i] = b, fill[b]
        fill[b] += size
        if left := free - size:
            if not open_bins[left]:
                mask |= 1 << left
            open_bins[left].append(b)
    return bins, place, np.array(fill, np.int64)


def _filler(level: int, capacity: int):
    """Packs one group's bins into larger ones, whose numbers carry the level and the group; `_first` marks one row of each larger bin."""

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        bins, place, full = best_fit(table.column("_fill").to_numpy(), capacity)
        base = (((level + 1) << 32) + key[0].as_py()) << 24
        first = np.zeros(len(bins), bool)
        first[np.unique(bins, return_index=True)[1]] = True
        return pa.table({"_bin": table.column("_bin"), "_into": base + bins, "_at": place, "_fill": full[bins], "_first": first})

    return fill


def pack(items: DataFrame, capacity: int = 4096, group_items: int = GROUP_ITEMS, slack: int = SLACK) -> DataFrame:
    """`items` (with length, from 1 to capacity) plus sequence_id and offset: which sequence each is in, and where.

    Only numbers of bins and their fills are packed, level by level; what a bin went into is kept in a table for each level, and
    places are put together from the last level down to the items. Columns with the names of the result, or _bin, are left behind.
    """
    names = [c for c in items.columns if c not in ("sequence_id", "offset", "_bin")]
    # Row numbers come from a written table, so a task that runs again gives the same ones.
    items = written(items.select(*names), "pieces").withColumn("_bin", F.monotonically_increasing_id())
    state = items.where(F.col("length") < capacity).select("_bin", F.col("length").alias("_fill"))
    count, levels = state.count(), []
    while count:
        n_groups = max(1, -(-count // group_items))
        dealt = state.withColumn("_group", F.pmod(F.xxhash64("_bin"), F.lit(n_groups)))
        moved = dealt.groupBy("_group").applyInArrow(_filler(len(levels), capacity), "_bin long, _into long, _at long, _fill long, _first boolean")
        levels.append(written(moved, f"bins{len(levels)}"))
        bins = levels[-1].where("_first").select(F.col("_into").alias("_bin"), "_fill")
        state = bins.where(F.col("_fill") < capacity - slack)
        left = state.count()
        if n_groups == 1 or left > 0.98 * count:  # what is left fits together no better
            break
        count = left
    places = items.sparkSession.createDataFrame([], "_bin long, sequence_id long, offset long")
    for moved in reversed(levels):  # a bin that went no further is a sequence
        up = places.select(F.col("_bin").alias("_into"), F.col("sequence_id").alias("_seq"), F.col("offset").alias("_base"))
        places = moved.join(up, "_into", "left").select("_bin", F.coalesce("_seq", "_into").alias("sequence_id"), (F.col("_at") + F.coalesce("_base", F.lit(0))).alias("offset"))
    out = items.join(places, "_bin", "left")
    full = -1 - F.col("_bin")
    return out.select(*names, F.coalesce("sequence_id", full).alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))
