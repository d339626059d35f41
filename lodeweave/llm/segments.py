"""SentencePiece encoding, decoding, and sampled segmentations without replacement.

All segmentations of a text into pieces form a lattice; one has the probability that its
pieces' weights give it among all. Adding Gumbel noise to every segmentation's log
probability and taking the k largest gives k distinct samples. They are found without
enumerating: a forward pass makes the exact log mass behind every node, and a best-first
(A*) search holds, for each partial path, the largest noisy value below it. A path's best
continuation keeps its value, so it is drawn in one go; what branches off at a node has a
truncated Gumbel value of its own and waits in the agenda. Noise is a hash of the row's
key, the sample and the place in the text, so a row has the same samples wherever it is run.

No piece goes from other characters on to a space mark, so the lattice falls into units (space marks and
what follows them); the forward pass, and the model's own encoding, are done once for each
different unit that a worker meets, and all texts of a batch are drawn together. A vocabulary
for which that doesn't hold is handled as one unit for each text. Characters without a
piece are single edges that stand for their bytes.

Weights: for unigram models the pieces' scores; the scores of BPE models are ranks, and a
piece weighs -log(2 + rank).

Defined results: a null or empty text has one segmentation, without pieces, of probability
one; a text with fewer than k segmentations returns all, however unlikely; a null key counts as -1;
repeated rows have equal samples; an empty table gives an empty result; other columns are left behind.
Noise has 52 bits, so an edge whose share is below that is never drawn in one go, only as what branches off.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm import text
from lodeweave.llm.shared import tidy
from lodeweave.llm.text import mix

SAMPLES = 2
#: Lattice nodes that a worker remembers; beyond it forgets units that are rare.
CACHE_NODES = 4_000_000
#: Texts, and about how many characters of them, that are drawn together.
TEXTS, CHARS = 256, 1 << 19
MARK = "▁"
_NOT_BLANK = np.ones(256, np.uint8)
_NOT_BLANK[0x20] = 0
_ROUNDED = 2.0**-24  # the most by which a number below 1 is rounded down to 32 bits
_NOISE = 37.0  # -log u and log(-log u) are not above it, as u has 52 bits
_STEP = np.uint64(0x9E3779B97F4A7C15)
_state: dict[str, object] = {}


def noise(seed: np.ndarray, stream: int, place: np.ndarray) -> np.ndarray:
    """Numbers above 0 and below 1 by hash of seed, stream and place."""
    h = mix(seed + (place.astype(np.uint64) + np.uint64(stream << 44)) * _STEP)
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class _Array:
    """A numpy array that grows at its end."""

    def __init__(self, dtype: type):
        self.data, self.n = np.zeros(1 << 12, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        more = len(values)
        if self.n + more > len(self.data):
            grown = np.zeros(max(len(self.data) * 3 // 2, self.n + more), self.data.dtype)
            grown[: self.n] = self.data[: self.n]
            self.data = grown
        self.data[self.n : self.n + more] = values
        self.n += more

    def keep(self, at: np.ndarray) -> None:
        """Only the values at these places, in order."""
        self.data[: len(at)], self.n = self.data[at], len(at)


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start[0], start[0] + 1, ... of every range in turn."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Trie:
    """The pieces as a trie in arrays: from place p a character with number c leads to place q = base[p] + c if parent[q] is p; piece[q] is what ends there, or -1."""

    def __init__(self, names: list[str]):
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        codes, at = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(sizes) - sizes
        chars, often = np.unique(codes, return_counts=True)
        self.number = np.zeros(int(chars.max(initial=0)) + 2, np.int64)  # the last stands for all characters beyond
        self.number[chars[np.argsort(-often, kind="stable")]] = np.arange(1, len(chars) + 1)
        many, state, n = len(chars) + 1, np.zeros(len(names), np.int64), 1
        parents, steps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for length in range(1, int(sizes.max(initial=0)) + 1):
            alive = np.flatnonzero(sizes >= length)
            step, inverse = np.unique(state[alive] * many + self.number[codes[at[alive] + length - 1]], return_inverse=True)
            state[alive] = n + inverse
            parents.append(step // many)
            steps.append(step % many)
            n += len(step)
        parent, step = np.concatenate(parents), np.concatenate(steps)  # of the states from 1 on
        own, start, count = np.unique(parent, return_index=True, return_counts=True)
        base, busy, lo = np.zeros(n, np.int64), np.zeros(2 * n + 4 * many, bool), 0
        busy[0] = True  # the root's place
        for k in np.argsort(-count, kind="stable")[: int((count > 1).sum())].tolist():
            here, found = step[start[k] : start[k] + count[k]], np.zeros(0, np.int64)
            while True:
                if lo + 256 + many > len(busy):
                    busy = np.concatenate([busy, np.zeros(len(busy) + 256, bool)])
                free = ~busy[lo + here[0] : lo + here[0] + 256]
                for c in here[1:].tolist():
                    free &= ~busy[lo + c : lo + c + 256]
                found = np.flatnonzero(free)
                if len(found):
                    break
                lo += 256
            base[own[k]] = lo + found[0]
            busy[base[own[k]] + here] = True
        single = np.flatnonzero(count == 1)
        free = np.flatnonzero(~np.concatenate([busy, np.zeros(len(single) + many, bool)])[many:])[: len(single)] + many
        base[own[single]] = free - step[start[single]]
        place = np.concatenate([[0], base[parent] + step])
        room = int(max(place.max(), base.max())) + many
        self.base, self.parent, self.piece = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int32)
        self.base[place], self.parent[place[1:]], self.piece[place[state]] = base, place[parent], np.arange(len(names))


class Lattice:
    """The lattices of all units seen: nodes are a unit's places 1..n, edges the pieces that end there, the longest first.

    Of an edge it keeps the place before it, its log probability among the edges of its node, log((1 - p) / p), and the
    sum of probabilities up to it, rounded down; all of these depend on the unit alone.
    """

    def __init__(self, model: object):
        self.model = model
        size = model.get_piece_size()
        scores = [model.get_score(i) for i in range(size)]
        ranks = all(float(s).is_integer() for s in scores)
        self.piece: dict[str, tuple[int, float]] = {}
        self.byte: dict[int, int] = {}
        shown: list[bytes] = []
        for i in range(size):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(name[3:5], 16)] = i
                shown.append(bytes([int(name[3:5], 16)]))
            elif model.is_unknown(i):
                shown.append(" \u2047 ".encode())
            elif model.is_control(i) or model.is_unused(i):
                shown.append(b"" if model.is_control(i) else name.replace(MARK, " ").encode())
            else:
                shown.append(name.replace(MARK, " ").encode())
                weight = scores[i] if not ranks else -float(np.log(2 + min(-scores[i], size)))
                self.piece[name] = (i, weight)
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.array([len(x) for x in shown], np.int64)
        self.shown_start = np.cumsum(self.shown_size) - self.shown_size
        self.prefixed = model.normalize("a") == MARK + "a"
        self.rare = min((w for _, w in self.piece.values()), default=0.0)
        self.longest = max(map(len, self.piece), default=1)
        self.apart = not any(MARK in p.lstrip(MARK) for p in self.piece)
        self.unknown = model.unk_id()
        self.trie = Trie(list(self.piece))
        self.ids = np.array([i for i, _ in self.piece.values()], np.int64)
        self.weights = np.array([w for _, w in self.piece.values()], np.float64)
        self.clear()

    def clear(self) -> None:
        self.units, self.bodies = text.Numbers(), text.Strings()
        self.single, self.other = _Array(np.int64), _Array(np.int64)  # units by their bodies' numbers, behind one mark, and by those in `units`
        self.key, self.used = _Array(np.int64), _Array(np.int64)  # of each unit: its body and marks, how often it was met
        self.base, self.size = _Array(np.int64), _Array(np.int64)
        self.best, self.best_at, self.best_n = _Array(np.uint32), _Array(np.int64), _Array(np.int64)
        self.odd: set[int] = set()  # units that the model reads otherwise by themselves
        self.first = _Array(np.int64)  # of each node's edges
        self.before, self.id, self.opens = _Array(np.int32), _Array(np.int32), _Array(bool)
        self.lp, self.against, self.reached = _Array(np.float64), _Array(np.float32), _Array(np.float32)
        self.strange: dict[int, tuple[int, float]] = {}
        self.spelled: list[list[int]] = []  # ids of edges with id -1 - k

    def shed(self, nodes: int) -> None:
        """Forget the units that were met once since the last time, and of the others the rarest, so that at most so many nodes are left."""
        used, sizes = self.used.data[: self.used.n], self.size.data[: self.size.n]
        order = np.argsort(-used, kind="stable")[: int((used > 1).sum())]
        kept = np.sort(order[np.cumsum(sizes[order]) <= nodes])
        self.odd = set(np.flatnonzero(np.isin(kept, np.array(sorted(self.odd), np.int64))).tolist())
        begin, sizes = self.base.data[kept], sizes[kept]
        self.first.extend(np.array([self.id.n]))
        lo, hi = self.first.data[begin], self.first.data[begin + sizes]
        moved = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), sizes)
        self.first.keep(_ragged(begin, sizes))
        self.first.data[: self.first.n] -= moved
        at = _ragged(lo, hi - lo)
        for array in (self.before, self.id, self.opens, self.lp, self.against, self.reached):
            array.keep(at)
        self.best.keep(_ragged(self.best_at.data[kept], self.best_n.data[kept]))
        for array in (self.key, self.size, self.best_n):
            array.keep(kept)
        for array, n in ((self.base, self.size), (self.best_at, self.best_n)):
            array.n = 0
            array.extend(np.cumsum(n.data[: n.n]) - n.data[: n.n])
        self.used.n = 0
        self.used.extend(np.zeros(len(kept), np.int64))
        buf, start, end = self.bodies.ranges(self.key.data[: len(kept)] >> 31)
        self.units, self.bodies = text.Numbers(), text.Strings()
        self.single, self.other = _Array(np.int64), _Array(np.int64)
        bodies, marks = self.bodies.numbers(buf, start, end, lambda first, last: None), self.key.data[: len(kept)] & (1 << 31) - 1
        self.key.data[: len(kept)] = bodies << 31 | marks
        self._number(bodies, marks, np.arange(len(kept)))

    def _number(self, bodies: np.ndarray, marks: np.ndarray, units: np.ndarray) -> None:
        """Have new units, of distinct bodies and marks, found from now on."""
        self.single.extend(np.full(self.bodies.n - self.single.n, -1))
        one = marks == 1
        self.single.data[bodies[one]] = units[one]
        self.units.add(self._hashed(bodies[~one], marks[~one]))
        self.other.extend(units[~one])

    @staticmethod
    def _hashed(bodies: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return mix((bodies << 31 | marks).astype(np.uint64) + np.uint64(1))  # one to one

    def numbers(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The numbers of units, each so many space marks and the bytes from start to end; new ones are learned."""
        bodies = self.bodies.numbers(buf, start, end, lambda first, last: None)
        self.single.extend(np.full(self.bodies.n - self.single.n, -1))
        found = self.single.data.take(bodies)
        rest = np.flatnonzero(marks != 1)
        at = self.units.find(self._hashed(bodies[rest], marks[rest]))
        found[rest] = np.where(at >= 0, self.other.data[np.maximum(at, 0)], -1)
        new = np.flatnonzero(found < 0)
        if len(new):
            distinct, at, inverse = np.unique(bodies[new] << 31 | marks[new], return_index=True, return_inverse=True)
            own = new[at]
            words = text.joined(buf, start[own], end[own]).decode().split(" ") if self.apart else [buf[i:j].tobytes().decode().replace(" ", MARK) for i, j in zip(start[own], end[own], strict=True)]
            units = self.size.n + np.arange(len(own))
            self._learn([MARK * k + w for k, w in zip(marks[own].tolist(), words, strict=True)])
            self.key.extend(distinct)
            self.used.extend(np.zeros(len(own), np.int64))
            self._number(bodies[own], marks[own], units)
            found[new] = units[inverse]
        self.used.data[: self.used.n] += np.bincount(found, minlength=self.used.n)
        return found

    def _encode(self, units: list[str]) -> None:
        """The model's own ids of each unit."""
        texts = [u.replace(MARK, " ") for u in units]
        if self.prefixed:
            texts = [t[1:] if t[:1] == " " else t for t in texts]
        ids = self.model.encode(texts, num_threads=1)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.odd.update(self.base.n + j for j, t in enumerate(texts) if not t)  # the model adds no mark to nothing
        whole = " ".join(texts)
        if self.model.normalize(whole) != (MARK if self.prefixed else "") + whole.replace(" ", MARK):
            self.odd.update(self.base.n + j for j, t in enumerate(texts) if self.model.normalize(t) != units[j])
        self.best_at.extend(self.best.n + np.cumsum(sizes) - sizes)
        self.best_n.extend(sizes)
        self.best.extend(np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum())))

    def _learn(self, units: list[str]) -> None:
        """The forward pass over all units at once, one numpy step for each place in a unit."""
        self._encode(units)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        total = int(sizes.sum())
        begin = np.cumsum(sizes) - sizes
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(units)), sizes)
        here = np.arange(total)
        place = here - begin[owner] + 1  # of the node behind each character
        trie, found, many = self.trie, [], np.zeros(total, np.int64)
        steps = np.zeros(total + len(units), np.int64)  # numbers of the characters; a zero behind each unit leads nowhere
        steps[here + owner] = trie.number[np.minimum(codes, len(trie.number) - 1)]
        start, at, state = here, here + owner, np.zeros(total, np.int64)
        for length in itertools.count(1):
            to = trie.base.take(state) + steps.take(at)
            on = np.flatnonzero(trie.parent.take(to) == state)
            if not len(on):
                break
            start, at, state = start.take(on), at.take(on) + 1, to.take(on)
            piece = trie.piece.take(state)
            hit = np.flatnonzero(piece >= 0)
            end, piece = start.take(hit) + (length - 1), piece.take(hit)
            found.append((end, length, self.ids.take(piece), self.weights.take(piece)))
            many[end] += 1
            if length == 1:
                alone = np.ones(total, bool)
                alone[end] = False
        rest = np.flatnonzero(alone) if found else here
        strange = [self._spelled(c) for c in codes[rest].tolist()]
        found.insert(0, (rest, 1, np.array([i for i, _ in strange], np.int64), np.array([w for _, w in strange], np.float64)))
        many[rest] += 1
        # A node's edges in turn, the longest first.
        firsts = np.cumsum(many) - many
        free, n = firsts.copy(), int(many.sum())
        span, ids, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        for end, length, piece, w in found[::-1]:
            to = free[end]
            span[to], ids[to], weight[to] = length, piece, w
            free[end] = to + 1
        before = np.repeat(place, many) - span
        mass = np.zeros(total + len(units))  # one place more for each unit's start
        # Edges by the place of their node, so that each step has its own side by side.
        turn = np.argsort(place.astype(np.uint16) if sizes.max(initial=0) < 1 << 16 else place, kind="stable")
        each, to = many[turn], (here + owner + 1)[turn]
        by_place = _ragged(firsts[turn], each)
        since, step = np.repeat(to, each) - span[by_place], weight[by_place]
        opening = np.append(np.cumsum(each) - each, n)
        borders = np.searchsorted(place[turn], np.arange(1, int(sizes.max(initial=0)) + 2))
        lps, shares = np.zeros(n), np.ones(n)
        for lo, hi in itertools.pairwise(borders.tolist()):
            a, b = int(opening[lo]), int(opening[hi])
            first, count = opening[lo:hi] - a, each[lo:hi]
            value = mass.take(since[a:b]) + step[a:b]
            top = np.maximum.reduceat(value, first)
            part = np.exp(value - np.repeat(top, count))
            sums = np.add.reduceat(part, first)
            found_mass = top + np.log(sums)
            mass[to[lo:hi]] = found_mass
            lps[a:b] = value - np.repeat(found_mass, count)
            shares[a:b] = part / np.repeat(sums, count)
        lp, share = np.zeros(n), np.ones(n)
        lp[by_place], share[by_place] = lps, shares
        reached, on = share.copy(), np.flatnonzero(many > 1)
        for j in itertools.count(1):
            if not len(on):
                break
            at = firsts[on] + j
            reached[at] += reached[at - 1]
            on = on[many[on] > j + 1]
        lp[firsts[many == 1]] = 0.0
        share[firsts[many == 1]] = 1.0
        reached[firsts + many - 1] = 2.0  # the last edge takes what rounding left over
        short = reached.astype(np.float32)  # never above the sum itself, so only what lies just above it needs a closer look
        reached = np.where(short > reached, np.nextafter(short, np.float32(-1)), short)
        with np.errstate(divide="ignore"):
            against = np.where(share < 1, np.log1p(-np.minimum(share, 1)) - lp, -np.inf)
        # Where one edge has nearly all, 1 - p has lost the others: they are added up by themselves.
        tight = np.flatnonzero(share > 1 - 1e-9)
        node = np.searchsorted(firsts, tight, "right") - 1
        tight, node = tight[many[node] > 1], node[many[node] > 1]
        if len(tight):
            count = many[node]
            at = _ragged(firsts[node], count)
            others = np.where(at == np.repeat(tight, count), -np.inf, lp[at])
            against[tight] = np.logaddexp.reduceat(others, np.cumsum(count) - count) - lp[tight]
        edges = self.id.n
        opens = np.repeat(place == sizes[owner], many)
        for array, values in ((self.base, self.first.n + begin), (self.size, sizes), (self.before, before), (self.id, ids), (self.opens, opens), (self.lp, lp), (self.against, against), (self.reached, reached), (self.first, edges + firsts)):
            array.extend(values)

    def _spelled(self, code: int) -> tuple[int, float]:
        """Id and weight of a character without a piece; -1 - k for more bytes than one."""
        if code not in self.strange:
            data = chr(code).encode("utf-8", "surrogatepass")
            ids = [self.byte.get(b, self.unknown) for b in data] if self.byte else [self.unknown]
            if len(ids) > 1:
                self.spelled.append(ids)
            self.strange[code] = ids[0] if len(ids) == 1 else -len(self.spelled), self.rare * len(ids)
        return self.strange[code]

    def draw(self, seed: np.ndarray, stream: int, units: np.ndarray, place: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Random paths from `place` back to the start of each unit, all at once: their edges, unit by unit, and how many each has.

        offset: where a unit begins in its text, for the noise.
        """
        before, reached, first = self.before.data, self.reached.data, self.first.data
        alive = np.flatnonzero(place > 0)
        at, node = place.take(alive), self.base.data.take(units.take(alive)) - 1
        seed = seed.take(alive) + (offset.take(alive).astype(np.uint64) + np.uint64(stream << 44)) * _STEP  # as `noise` adds them up
        count = np.zeros(len(units), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        while len(alive):
            edge = first.take(node + at)
            u = noise(seed, 0, at)
            on = np.flatnonzero(u >= reached.take(edge))
            while len(on):
                near = np.flatnonzero(u[on] - reached[edge[on]] < _ROUNDED)
                if len(near):
                    own = on[near]
                    low = first[node[own] + at[own]].tolist()
                    exact = np.array([np.exp(self.lp.data[a : b + 1]).sum() for a, b in zip(low, edge[on[near]].tolist(), strict=True)])
                    on = np.delete(on, near[u[on[near]] < exact])
                edge[on] += 1
                on = on[u[on] >= reached[edge[on]]]
            parts.append((alive, edge))
            count[alive] += 1
            at = before.take(edge)
            on = np.flatnonzero(at)
            alive, at, node, seed = alive.take(on), at.take(on), node.take(on), seed.take(on)
        start = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int64)
        for k, (which, edge) in enumerate(parts):
            out[start[which] + k] = edge
        return out, count

    def ids_of(self, edges: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of paths of so many edges each, from left to right, and how many each has; inside a unit a path was drawn from right to left."""
        n = len(edges)
        start = np.flatnonzero(self.opens.data[edges])
        size = np.diff(np.append(start, n))
        ids = self.id.data[edges[np.repeat(2 * start + size - 1, size) - np.arange(n)]]
        if (ids >= 0).all():
            return ids.astype(np.uint32), sizes
        many = np.array([len(x) for x in self.spelled], np.int64)
        flat = np.array([i for x in self.spelled for i in x], np.int64)
        n_ids = np.ones(n, np.int64)
        long = np.flatnonzero(ids < 0)
        n_ids[long] = many[-1 - ids[long]]
        out = np.repeat(ids, n_ids)
        at = np.cumsum(n_ids) - n_ids
        out[_ragged(at[long], n_ids[long])] = flat[_ragged((np.cumsum(many) - many)[-1 - ids[long]], n_ids[long])]
        ends = np.concatenate([[0], np.cumsum(n_ids)])
        borders = np.concatenate([[0], np.cumsum(sizes)])
        return out.astype(np.uint32), np.diff(ends[borders])

    def decoded(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The texts of so many ids each."""
        n = self.shown_size[ids]
        flat = self.shown[_ragged(self.shown_start[ids], n)]
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        out = [flat[a:b].tobytes() for a, b in itertools.pairwise(ends)]
        return [x[1:] if self.prefixed and x[:1] == b" " else x for x in out]


def _lattice(path: str) -> Lattice:
    if _state.get("path") != path:
        import sentencepiece

        _state.update(path=path, lattice=Lattice(sentencepiece.SentencePieceProcessor(model_file=path)))
    lattice = _state["lattice"]
    if lattice.first.n > CACHE_NODES:
        lattice.shed(CACHE_NODES // 4)
    return lattice


def unit_numbers(lattice: Lattice, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' units by number, in turn, and how many each text has; what is new in any of them is learned at once."""
    skip = 1 if lattice.prefixed else 0
    bodies = [(lattice.model.normalize(t)[skip:].replace(MARK, " ") if t else "").encode() for t in texts]
    full = np.array([bool(t) for t in texts], bool)
    buf = np.frombuffer(b"".join(bodies), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
    lo, hi = offs[:-1], offs[1:]
    if not lattice.apart:  # a text is one unit
        own = np.flatnonzero(full)
        return lattice.numbers(buf, lo[own], hi[own], np.full(len(own), skip)), full.astype(np.int64)
    start, end, rows = text.runs(buf, offs, _NOT_BLANK)
    first, last = rows[:-1], rows[1:]
    row = np.repeat(np.arange(len(texts)), last - first)
    before = np.where(np.arange(len(start)) == first[row], lo[row], np.concatenate([[0], end])[: len(start)]) if len(start) else np.zeros(0, np.int64)
    marks = start - before + skip * (np.arange(len(start)) == first[row])
    # Marks behind a text's last run, or all of a text without one, are a unit of their own.
    rest = hi - np.where(last > first, end[np.maximum(last - 1, 0)] if len(end) else 0, lo) + skip * (last == first) * full
    more = np.flatnonzero(rest > 0)
    at = np.concatenate([np.arange(len(start)) + np.searchsorted(more, row, "left"), last[more] + np.arange(len(more))])
    order = np.argsort(at, kind="stable")
    start, end = np.concatenate([start, hi[more]])[order], np.concatenate([end, hi[more]])[order]
    marks = np.concatenate([marks, rest[more]])[order]
    return lattice.numbers(buf, start, end, marks), (last - first) + (rest > 0)


def best_ids(lattice: Lattice, texts: list[str], units: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The model's own ids of every text, put together from those of its units."""
    ids = lattice.best.data[_ragged(lattice.best_at.data[units], lattice.best_n.data[units])]
    ends = np.concatenate([[0], np.cumsum(lattice.best_n.data[units])])[np.concatenate([[0], np.cumsum(counts)])]
    out = [ids[a:b] for a, b in itertools.pairwise(ends.tolist())]
    if lattice.odd:
        strange = np.isin(units, np.array(sorted(lattice.odd)))
        for i in set(np.repeat(np.arange(len(counts)), counts)[strange].tolist()):
            out[i] = np.array(lattice.model.encode(texts[i]), np.uint32)
    return out


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """The model's own segmentations."""
    lattice = _lattice(path)
    return best_ids(lattice, texts, *unit_numbers(lattice, texts))


def decode(ids: list[np.ndarray], path: str) -> list[str]:
    """The texts of lists of ids; bytes that are no character become U+FFFD."""
    lattice = _lattice(path)
    flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int64)
    return [x.decode("utf-8", "replace") for x in lattice.decoded(flat, np.fromiter(map(len, ids), np.int64, len(ids)))]


def able(at: np.ndarray, k: int, ceiling: float) -> np.ndarray:
    """The places of those decisions whose noisy value can be among the k largest, by their log masses: noise moves none by more than _NOISE."""
    if len(at) <= k:
        return np.arange(len(at))
    last = float(np.partition(at, len(at) - k)[len(at) - k])
    return np.flatnonzero(at >= last - math.log(math.exp(min(last - ceiling, 700)) + _NOISE) - _NOISE)


def samples(lattice: Lattice, units: np.ndarray, counts: np.ndarray, k: int, keys: np.ndarray) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For every text up to k distinct segmentations as (edges, log probability, noisy value, inclusion score), the largest noisy value first.

    The texts' units come in turn, with how many each has; keys seed the noise. The inclusion score is the probability of
    a noisy value above the largest one that was left out.
    """
    n = len(counts)
    seeds = mix(mix(keys.astype(np.int64).view(np.uint64)) ^ _STEP)
    border = np.concatenate([[0], np.cumsum(counts)])
    sizes = lattice.size.data[units]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    offset = ends[:-1] - np.repeat(ends[border[:-1]], counts)
    paths: list[list[tuple[np.ndarray, np.ndarray, float]]] = [[] for _ in range(n)]  # (edges, log probability so far, noisy value)
    agenda: list[list[tuple]] = [[] for _ in range(n)]

    def branch(turn: int, texts: list[int], since: list[int], flat: np.ndarray, so_far: np.ndarray, length: np.ndarray) -> None:
        """Put what leaves the newest paths at one of their decisions from `since` on into the agenda: the k largest are enough."""
        which = np.array(texts, np.int64)
        ceiling = np.array([paths[i][-1][2] for i in texts])
        at = so_far + lattice.against.data.take(flat)
        ends = np.cumsum(length)
        kept = [able(at[b - n + s : b], k, c) + (b - n + s) for b, n, s, c in zip(ends.tolist(), length.tolist(), since, ceiling.tolist(), strict=True)]
        begin, length = ends - length, np.fromiter(map(len, kept), np.int64, len(kept))
        full = np.flatnonzero(length)
        if not len(full):
            return
        start, kept = np.cumsum(length) - length, np.concatenate(kept)
        flat, at, index = flat[kept], at[kept], kept - np.repeat(begin, length)
        with np.errstate(divide="ignore", invalid="ignore"):
            u = noise(np.repeat(seeds[which], length), 2 * turn + 1, index + 1)
            value = at - np.log(np.exp(np.minimum(at - np.repeat(ceiling, length), 700)) - np.log(u))
        value[np.isnan(value)] = -np.inf
        for _ in range(k):
            best = np.maximum.reduceat(value, start[full])
            hit = np.flatnonzero((value == np.repeat(best, length[full])) & (value > -np.inf))
            if not len(hit):
                return
            own = np.repeat(full, length[full])[hit]
            hit, own = hit[np.append(True, own[1:] != own[:-1])], own[np.append(True, own[1:] != own[:-1])]
            for p, j, v in zip(hit.tolist(), own.tolist(), value[hit].tolist(), strict=True):
                i = texts[j]
                heapq.heappush(agenda[i], (-v, len(paths[i]) - 1, int(index[p]), (int(flat[p]),)))
            value[hit] = -np.inf

    def summed(flat: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Log probabilities added up text by text, so that no text's rounding depends on another."""
        out, lp = np.zeros(len(flat)), lattice.lp.data[flat]
        edge = np.concatenate([[0], np.cumsum(length)]).tolist()
        for a, b in itertools.pairwise(edge):
            np.cumsum(lp[a:b], out=out[a:b])
        return out

    flat, per_unit = lattice.draw(np.repeat(seeds, counts), 0, units, sizes, offset)
    length = np.diff(np.concatenate([[0], np.cumsum(per_unit)])[border])
    so_far = summed(flat, length)
    ends_of = np.concatenate([[0], np.cumsum(length)]).tolist()
    first = -np.log(-np.log(noise(seeds, 1, np.zeros(n, np.int64))))
    for i in range(n):
        part = slice(ends_of[i], ends_of[i + 1])
        paths[i].append((flat[part], so_far[part], float(first[i])))
    branch(0, list(range(n)), [0] * n, flat, so_far, length)
    lp_of, firsts = lattice.lp.data, lattice.first.data
    for turn in range(1, k):
        texts = [i for i in range(n) if agenda[i]]
        if not texts:
            break
        pick = noise(seeds[texts], 2 * turn, np.zeros(len(texts), np.int64)).tolist()
        again = noise(seeds[texts], 2 * turn + 1, np.zeros(len(texts), np.int64)).tolist()
        heads, since, todo_units, todo_place, todo_offset, todo_seed, values = [], [], [], [], [], [], []
        for i, u, v in zip(texts, pick, again, strict=True):
            low, parent, t, taken = heapq.heappop(agenda[i])
            edges, before, _ = paths[i][parent]
            opens = np.flatnonzero(lattice.opens.data[edges[: t + 1]])
            unit = border[i] + len(opens) - 1
            # The node of the decision: of its unit, at the place where the decision before it ended.
            spot = int(lattice.size.data[units[unit]]) if opens[-1] == t else int(lattice.before.data[edges[t - 1]])
            node = int(lattice.base.data[units[unit]]) + spot - 1
            lo = int(firsts[node])
            hi = int(firsts[node + 1]) if node + 1 < lattice.first.n else lattice.lp.n
            open_ = [e for e in range(lo, hi) if e not in taken]
            weights = lp_of[open_]
            shares = np.exp(weights - weights.max()).tolist()
            target, edge = u * sum(shares), open_[-1]
            for e, p in zip(open_, shares, strict=True):
                target -= p
                if target < 0:
                    edge = e
                    break
            heads.append(np.append(edges[:t], edge))
            since.append(t + 1)
            values.append(-low)
            rest = units[unit : border[i + 1]]
            place = lattice.size.data[rest]
            place[0] = lattice.before.data[edge]
            todo_units.append(rest)
            todo_place.append(place)
            todo_offset.append(offset[unit : border[i + 1]])
            todo_seed.append(np.full(len(rest), seeds[i]))
            if len(open_) > 1:  # however little is left
                left = float(np.logaddexp.reduce(np.delete(weights, open_.index(edge))))
                at = (float(before[t - 1]) if t else 0.0) + left
                noisy = at - math.log(math.exp(min(at + low, 700)) - math.log(v))
                heapq.heappush(agenda[i], (-noisy, parent, t, (*taken, edge)))
        drawn, per_unit = lattice.draw(np.concatenate(todo_seed), 2 * turn, np.concatenate(todo_units), np.concatenate(todo_place), np.concatenate(todo_offset))
        cuts = np.concatenate([[0], np.cumsum(per_unit)])[np.concatenate([[0], np.cumsum([len(x) for x in todo_units])])].tolist()
        made = [np.concatenate([h, drawn[a:b]]) for h, (a, b) in zip(heads, itertools.pairwise(cuts), strict=True)]
        length = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.concatenate(made)
        so_far = summed(flat, length)
        for i, edges, at, value in zip(texts, made, np.split(so_far, np.cumsum(length)[:-1]), values, strict=True):
            paths[i].append((edges, at, value))
        branch(turn, texts, since, flat, so_far, length)
    out = []
    for i in range(n):
        border_value = -agenda[i][0][0] if agenda[i] else -math.inf
        lps = [float(at[-1]) if len(at) else 0.0 for _, at, _ in paths[i]]
        out.append([(edges, lp, value, -math.expm1(-math.exp(min(lp - border_value, 50.0)))) for (edges, _, value), lp in zip(paths[i], lps, strict=True)])
    return out


def drawn_ids(lattice: Lattice, words: list[str], k: int, keys: list[int]) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """`samples` of texts, with ids in the place of edges."""
    found = samples(lattice, *unit_numbers(lattice, words), k, np.array(keys, np.int64))
    ids, sizes = lattice.ids_of(np.concatenate([*(p[0] for f in found for p in f), np.zeros(0, np.int64)]), np.array([len(p[0]) for f in found for p in f], np.int64))
    parts = iter(np.split(ids, np.cumsum(sizes)[:-1]))
    return [[(next(parts), *p[1:]) for p in f] for f in found]


def drawn_texts(path: str, k: int, keys: list[int | None], words: list[str]) -> tuple[list[np.ndarray], list[bytes], list[list[tuple[np.ndarray, bytes, float, float, float]]]]:
    """The model's own ids of every text, what they decode to, and up to k samples of it: (ids, decoded bytes, log probability, noisy value, inclusion score)."""
    lattice = _lattice(path)
    units, counts = unit_numbers(lattice, words)
    own = best_ids(lattice, words, units, counts)
    found = samples(lattice, units, counts, k, np.array([-1 if i is None else i for i in keys], np.int64))
    edges = [p[0] for f in found for p in f]
    flat, sizes = lattice.ids_of(np.concatenate(edges), np.fromiter(map(len, edges), np.int64, len(edges)))
    plain = lattice.decoded(np.concatenate(own).astype(np.int64), np.fromiter(map(len, own), np.int64, len(own)))
    shown, parts = lattice.decoded(flat.astype(np.int64), sizes), np.split(flat, np.cumsum(sizes)[:-1])
    each = zip(parts, shown, strict=True)
    return own, plain, [[(*next(each), *p[1:]) for p in f] for f in found]


def _by_texts(docs: DataFrame, path: str, k: int, key: str, rows_of: Callable[..., Iterator[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """The rows that `rows_of` makes of (doc_id, text, own ids, what they decode to, samples) of every text."""

    def of_texts(ids: list[int | None], words: list[str]) -> pa.RecordBatch:
        rows = [row for doc in zip(ids, words, *drawn_texts(path, k, ids, words), strict=True) for row in rows_of(*doc)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            lo = used = 0
            for hi, w in enumerate(words, 1):
                used += len(w)
                if hi - lo >= TEXTS or used >= CHARS or hi == len(words):
                    yield of_texts(ids[lo:hi], words[lo:hi])
                    lo, used = hi, 0

    return docs.select(F.col(key).cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), ddl)


def segmentations(docs: DataFrame, path: str, k: int = SAMPLES, key: str = "doc_id") -> DataFrame:
    """(doc_id, sample, ids, log_prob, noisy, inclusion, decoded_text): k distinct segmentations of every text, by row key; sample 0 is the model's own, without noise.

    decoded_text is what the ids read as; bytes that are no character become U+FFFD.
    """
    ids_type = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("ids", ids_type), ("log_prob", pa.float64()), ("noisy", pa.float64()), ("inclusion", pa.float64()), ("decoded_text", pa.string())])

    def rows_of(doc_id: int | None, _: str, best: np.ndarray, plain: bytes, found: list[tuple]) -> Iterator[tuple]:
        yield doc_id, 0, best.astype(np.int32), None, None, None, plain.decode("utf-8", "replace")
        for i, (ids, shown, *scores) in enumerate(found, 1):
            yield doc_id, i, ids.astype(np.int32), *scores, shown.decode("utf-8", "replace")

    return _by_texts(docs, path, k, key, rows_of, schema, "doc_id long, sample int, ids array<int>, log_prob double, noisy double, inclusion double, decoded_text string")


def sampled(docs: DataFrame, path: str, k: int = SAMPLES, key: str = "doc_id") -> DataFrame:
    """(doc_id, sample, n_pieces, ids_crc32, log_prob, noisy, inclusion, best_crc32, decoded): digests of `segmentations`, made where the ids are.

    best_crc32 is of the model's own segmentation; decoded is whether its pieces and the sample's give the text back.
    """
    names = ["doc_id", "sample", "n_pieces", "ids_crc32", "log_prob", "noisy", "inclusion", "best_crc32", "decoded"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]

    def rows_of(doc_id: int | None, word: str, best: np.ndarray, plain: bytes, found: list[tuple]) -> Iterator[tuple]:
        body, crc = word.encode(), zlib.crc32(best.astype("<u4").tobytes())
        for i, (ids, shown, *scores) in enumerate(found, 1):
            yield doc_id, i, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *scores, crc, plain == body and shown == body

    return _by_texts(docs, path, k, key, rows_of, pa.schema(list(zip(names, kinds, strict=True))), "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, noisy double, inclusion double, best_crc32 long, decoded boolean")
