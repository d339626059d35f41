"""Texts in units that tokenizers read by themselves: white space and what follows it up to the next white space.

No token of a byte-level BPE goes from other characters on to white space, and no piece of
a SentencePiece BPE does so to most white space, so a text's ids are those of its units in
turn; each worker encodes a unit once and remembers it. Rows for which that might not hold
(white space beyond ASCII, separators) are told, for their tokenizer to read them whole.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Callable

import numpy as np

from lodeweave.llm import text

#: Bytes of units that are encoded as one text.
JOINED_BYTES = 1 << 18
_ASCII_LETTER = text.LETTER & (np.arange(256) < 128)
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def cut(buf: np.ndarray, offs: np.ndarray, glued: bytes = b"", marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units, and the n + 1 unit offsets of the rows. White space in `glued` begins no unit.

    marks: an ASCII mark behind an ASCII letter begins one as well, as in byte-level BPE, where letters and marks share no token.
    """
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    opens = text.SPACE.copy()
    opens[list(glued)] = False
    first = opens[buf]
    first[1:] &= ~text.SPACE[buf[:-1]]
    if marks:
        first[1:] |= _MARK[buf[1:]] & _ASCII_LETTER[buf[:-1]]
    first[offs[:-1][offs[:-1] < offs[1:]]] = True
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], len(buf)), np.searchsorted(starts, offs)


def aside(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which rows hold white space beyond ASCII or control characters that may count as such."""
    bad = (buf >= 0x1C) & (buf <= 0x1F)
    after = np.concatenate([buf[1:], np.zeros(2, np.uint8)])
    wide = np.flatnonzero((buf == 0xC2) | (buf == 0xE1) | (buf == 0xE2) | (buf == 0xE3))
    one, two, three = buf[wide], after[wide], after[wide + 1]
    bad[wide] |= (one == 0xC2) & ((two == 0x85) | (two == 0xA0))  # U+0085, U+00A0
    bad[wide] |= (one == 0xE1) & (two == 0x9A) & (three == 0x80) | (one == 0xE1) & (two == 0xA0) & (three == 0x8E)  # U+1680, U+180E
    bad[wide] |= (one == 0xE2) & (two == 0x80) & ((three <= 0x8F) | (three >= 0xA8) & (three <= 0xAF))  # U+2000 to 200F, U+2028 to 202F
    bad[wide] |= (one == 0xE2) & (two == 0x81) & (three >= 0x9F) & (three <= 0xA4)  # U+205F
    bad[wide] |= (one == 0xE3) & (two == 0x80) & (three == 0x80)  # U+3000
    sums = np.concatenate([[0], np.cumsum(bad)])
    return sums[offs[1:]] > sums[offs[:-1]]


def split_up(encode: Callable[[list[str]], list[list[int]]], alone: Callable[[str], list[int]], size: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray, apart: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the units [start, end) in turn, and how many each has. `size`: the bytes of each id.

    Units that begin with white space and go on are encoded many as one text, cut again by the ids' bytes; the others, or all if `apart`, alone.
    """
    n = end - start
    counts, regular = np.zeros(len(n), np.int64), text.SPACE[buf[start]] & ~text.SPACE[buf[end - 1]] & (not apart)
    joint = np.flatnonzero(regular)
    data = buf[text.ragged(start[joint], n[joint])].tobytes()
    borders = np.cumsum(n[joint])
    lots = np.searchsorted(borders // JOINED_BYTES, np.arange(int(borders[-1]) // JOINED_BYTES + 2)) if len(joint) else np.zeros(1, np.int64)
    lots = np.unique(np.append(lots, len(joint))).tolist()
    edges = np.concatenate([[0], borders])[lots].tolist()
    ids = [np.array(x, np.uint32) for x in encode([data[a:b].decode() for a, b in itertools.pairwise(edges)])] if len(joint) else []
    ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    ends = np.cumsum(size[ids])
    at = np.searchsorted(ends, borders)
    if len(joint) and (at[-1] != len(ends) - 1 or (ends[at] != borders).any()):  # some ids' bytes aren't those of the text
        joint, ids, at = joint[:0], ids[:0], at[:0]
        regular[:] = False
    counts[joint] = np.diff(at, prepend=-1)
    rest = [np.array(alone(buf[a:b].tobytes().decode()), np.uint32) for a, b in zip(start[~regular].tolist(), end[~regular].tolist(), strict=True)]
    counts[~regular] = [len(x) for x in rest]
    first = np.cumsum(counts) - counts
    flat = np.zeros(int(counts.sum()), np.uint32)
    flat[text.ragged(first[joint], counts[joint])] = ids
    if rest:
        flat[text.ragged(first[~regular], counts[~regular])] = np.concatenate(rest)
    return flat, counts


def byte_tokenizer(path: str, plain_specials: bool):
    """The tokenizer of a byte-level BPE, and its ids' bytes. plain_specials: special tokens' strings in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain_specials
    # The byte-level alphabet: printable bytes stand for themselves, the others for the characters from U+0100 on.
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    entries: list[bytes] = [b""] * tokenizer.get_vocab_size(True)
    for name, k in tokenizer.get_vocab(True).items():
        entries[k] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
    return tokenizer, entries
