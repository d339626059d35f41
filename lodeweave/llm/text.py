"""Byte-level text kernels shared by the operators of this subpackage.

Texts are read straight from Arrow buffers: word borders, word hashes and hashes of word
sequences of a whole group of documents come from a few numpy passes over its bytes, so
no Python string is made for a word. A hash takes eight bytes at a time and scrambles
them before the next are added. Different texts can have equal hashes, and whoever knows
the key of the hashes can look for such texts; so hashes that decide anything are keyed
with a number drawn for the run, and `Strings` compares bytes.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one group of documents has at most; a longer document makes a group of its own.
CHUNK_BYTES = 1 << 18
#: Bytes of a long document that one numpy pass handles.
PASS_BYTES = 1 << 20
#: Byte ranges longer than this are hashed by a library call each.
LONG = 256

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: White space is \x20 and \x09-\x0D, in every contract of this subpackage.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
#: ASCII letters and every byte of a multi-byte character.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def eights(buf: np.ndarray, table: np.ndarray = SAME) -> np.ndarray:
    """The eight bytes from each place on as one number, as a view; zeros lie behind the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf if table is SAME else table[buf]
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = SAME, key: int = 0) -> np.ndarray:
    """Hashes of the byte ranges [start, end) under a key of 64 bits, their bytes taken through `table`."""
    if not len(start):
        return np.zeros(0, np.uint64)
    at, n = eights(buf, table), end - start
    out = n.astype(np.uint64) * _STEP
    if key:
        out = mix(out ^ np.uint64(key)) + np.uint64(key)
    out ^= at[start] & _MASK[np.minimum(n, 8)]
    out = mix(out)
    alive = np.flatnonzero((n > 8) & (n <= LONG))
    for k in range(8, LONG, 8):
        if not len(alive):
            break
        out[alive] = mix(out[alive] ^ (at[start[alive] + k] & _MASK[np.minimum(n[alive] - k, 8)]))
        alive = alive[n[alive] > k + 8]
    for i in np.flatnonzero(n > LONG).tolist():
        data = table[buf[start[i] : end[i]]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(data, digest_size=8, key=key.to_bytes(8, "little") if key else b"").digest(), "little")
    return out


def new_key() -> int:
    """A key for hashes that nobody knew before; the driver draws one for a run and sends it along."""
    return int.from_bytes(os.urandom(8), "little") | 1


def short_grams(buf: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every `width` consecutive bytes, 8 at most."""
    at = eights(buf)[: len(buf) - width + 1]
    return mix((at & _MASK[width]) ^ np.uint64(width * int(_STEP) % (1 << 64)))


def _chained(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """Hashes of sequences from those of their first parts and of their last `size` values."""
    out = first ^ (first >> np.uint64(32))
    out *= _STEP + np.uint64(2 * size)
    out ^= out >> np.uint64(29)
    out += second
    return out


def sequences(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every `width` consecutive values (64-bit); none if there are fewer."""
    n = len(values) - width + 1
    if n <= 0 or width <= 0:
        return np.zeros(0, np.uint64)
    part, size, out, done, rest = values, 1, None, 0, width
    while rest:
        if rest & 1:
            out = part if out is None else _chained(out[: len(part) - done], part[done:], size)
            done += size
        rest >>= 1
        if rest:
            part = _chained(part[:-size], part[size:], size)
            size *= 2
    return mix(out[:n])


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def groups(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bytes, offsets) of runs of rows with at most `limit` bytes, or of one longer row."""
    buf, offs = column_bytes(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def runs(buf: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes of one kind, and the n + 1 run offsets of the rows.

    kind: a table by byte, in which 0 belongs to no run. A run never crosses a row.
    """
    n, starts, ends = len(buf), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, n, PASS_BYTES):
        hi = min(n, lo + PASS_BYTES)
        here = np.zeros(hi - lo + 2, np.uint8)
        here[1:-1] = kind[buf[lo:hi]]
        here[0] = kind[buf[lo - 1]] if lo else 0
        here[-1] = kind[buf[hi]] if hi < n else 0
        turn = here[1:] != here[:-1]
        turn[offs[np.searchsorted(offs, lo) : np.searchsorted(offs, hi, "right")] - lo] = True
        inside = here[1:-1] > 0
        starts.append(np.flatnonzero(turn[:-1] & inside) + lo)
        ends.append(np.flatnonzero(turn[1:] & inside) + (lo + 1))
    first = np.concatenate(starts)
    return first, np.concatenate(ends), np.searchsorted(first, offs)


_NOT_SPACE = (~SPACE).astype(np.uint8)


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+`: starts, ends, row offsets."""
    return runs(buf, offs, _NOT_SPACE)


def joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words joined by one space."""
    if not len(starts):
        return b""
    size = ends - starts
    out = np.full(int(size.sum()) + len(size) - 1, 0x20, np.uint8)
    to = np.cumsum(size + 1) - size - 1
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + step] = buf[np.repeat(starts, size) + step]
    return out.tobytes()


class Numbers:
    """Numbers 0, 1, ... of 64-bit hashes in order of arrival, by open addressing in arrays."""

    def __init__(self):
        self.n = 0
        self._clear(1 << 12)

    def _clear(self, size: int) -> None:
        self.key, self.number, self.mask = np.zeros(size, np.uint64), np.zeros(size, np.int64), np.uint64(size - 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The hashes' numbers, -1 where unknown."""
        h = np.maximum(hashes, np.uint64(1))
        slot, out, todo = (h & self.mask).astype(np.int64), np.full(len(h), -1, np.int64), np.arange(len(h))
        while len(todo):
            there = self.key[slot[todo]]
            hit = there == h[todo]
            out[todo[hit]] = self.number[slot[todo[hit]]]
            todo = todo[~hit & (there > 0)]
            slot[todo] = (slot[todo] + 1) & int(self.mask)
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Number hashes that are distinct and unknown."""
        h, first = np.maximum(hashes, np.uint64(1)), self.n
        self.n += len(h)
        if 2 * self.n > len(self.key):
            known = self.key > 0
            old, numbers = self.key[known], self.number[known]
            self._clear(1 << int(4 * self.n).bit_length())
            self._put(old, numbers)
        self._put(h, np.arange(first, self.n))

    def _put(self, h: np.ndarray, numbers: np.ndarray) -> None:
        slot, todo = (h & self.mask).astype(np.int64), np.arange(len(h))
        while len(todo):
            free = todo[self.key[slot[todo]] == 0]
            self.key[slot[free]] = h[free]  # of several for one place the last gets it
            won = self.key[slot[todo]] == h[todo]
            self.number[slot[todo[won]]] = numbers[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & int(self.mask)


def grown(a: np.ndarray, n: int) -> np.ndarray:
    """`a` with room for n values at least; what is behind its own is zero."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


class Strings:
    """Numbers 0, 1, ... of byte strings: two have one number only if all their bytes are equal, whatever their hashes are."""

    def __init__(self):
        self.key = new_key()
        self.clear()

    def clear(self) -> None:
        self.n = self.used = 0
        self._hashes, self._odd = Numbers(), {}  # odd: strings whose hash another one has
        self._of = np.zeros(1 << 12, np.int64)  # a string's number by that of its hash
        self._flat, self._start, self._size = np.zeros(1 << 16, np.uint8), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def numbers(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, learn: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
        """The numbers of the byte ranges; `learn` gets the starts and ends of new strings, each once, in order of their numbers."""
        h = hashes(buf, start, end, key=self.key)
        out = self._find(buf, start, end, h)
        new = np.flatnonzero(out < 0)
        while len(new):
            _, at = np.unique(h[new], return_index=True)
            own = new[at]
            self._add(buf, start[own], end[own], h[own])
            learn(start[own], end[own])
            out[new] = self._find(buf, start[new], end[new], h[new])
            new = new[out[new] < 0]
        return out

    def ranges(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes that hold strings, and where those of the numbers start and end."""
        return self._flat[: self.used], self._start[numbers], self._start[numbers] + self._size[numbers]

    def _find(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        place = self._hashes.find(h)
        out = np.where(place >= 0, self._of[np.maximum(place, 0)], -1)
        known = np.flatnonzero(out >= 0)
        other = known[~self._same(buf, start[known], end[known], out[known])]
        for i in other.tolist():
            out[i] = self._odd.get(buf[start[i] : end[i]].tobytes(), -1)
        return out

    def _same(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether the ranges' bytes are those of the strings."""
        size, theirs = end - start, self._start[number]
        same = size == self._size[number]
        alive = np.flatnonzero(same & (size <= LONG))
        mine, kept = eights(buf), np.ndarray((len(self._flat) - 7,), "<u8", self._flat, strides=(1,))
        for k in range(0, LONG, 8):
            if not len(alive):
                break
            differ = (mine[start[alive] + k] ^ kept[theirs[alive] + k]) & _MASK[np.minimum(size[alive] - k, 8)]
            same[alive[differ > 0]] = False
            alive = alive[(differ == 0) & (size[alive] > k + 8)]
        for i in np.flatnonzero(same & (size > LONG)).tolist():
            same[i] = np.array_equal(buf[start[i] : end[i]], self._flat[theirs[i] : theirs[i] + size[i]])
        return same

    def _add(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> None:
        size = end - start
        total, numbers = int(size.sum()), np.arange(self.n, self.n + len(h))
        self._flat = grown(self._flat, self.used + total + 16)
        self._start, self._size = grown(self._start, self.n + len(h)), grown(self._size, self.n + len(h))
        to = self.used + np.cumsum(size) - size
        self._start[numbers], self._size[numbers] = to, size
        self._flat[self.used : self.used + total] = buf[ragged(start, size)]
        taken = self._hashes.find(h) >= 0
        for i in np.flatnonzero(taken).tolist():
            self._odd[buf[start[i] : end[i]].tobytes()] = int(numbers[i])
        self._of = grown(self._of, self._hashes.n + len(h))
        self._of[self._hashes.n : self._hashes.n + int((~taken).sum())] = numbers[~taken]
        self._hashes.add(h[~taken])
        self.n, self.used = self.n + len(h), self.used + total


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start[0], start[0] + 1, ... of every range in turn."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
