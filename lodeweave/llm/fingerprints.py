"""Document fingerprints from closed syncmers.

A k-mer of a text's bytes is kept if the smallest hash among its inner s-mers stands at
either edge. Whether it is kept depends on its own bytes only, so a passage gives the same
anchors wherever it stands, and the anchors of an edited text are those of the untouched
part plus those of a small rest. A fingerprint is the hashes of all anchors in text order.
Two fingerprints are matched by position: the n-th anchor of a kind in one meets the n-th in
the other, and of these pairs the most that run in the same order in both count. The
likeness is twice that number over the number of anchors that the two have.

Defined results: a null text is empty; an empty text has an empty fingerprint, which is
like another empty one (1) and unlike any other (0); a text without a kept k-mer has the
anchors of shorter k-mers, or else one, the hash of all of it; an empty table gives an empty
result. In `neighbours`, rows with equal ids follow in order of hashes of their texts and null
ids come last.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm import text
from lodeweave.llm.shared import tidy

K, S = 32, 5
#: For texts in which no k-mer is kept.
SHORT = (6, 2)


def anchors(buf: np.ndarray, offs: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of the kept k-mers of every row, and the rows' anchor offsets."""
    n, width = len(buf), k - s + 1
    places, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for lo in range(0, n - k + 1, text.PASS_BYTES):
        part = buf[lo : lo + text.PASS_BYTES + k - 1]
        small = (text.short_grams(part, s) >> np.uint64(32)).astype(np.uint32)
        reach, low = 1, small
        while reach * 2 <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        last = len(part) - k + 1
        if reach < width:
            low = np.minimum(low[:last], low[width - reach :][:last])
        low = low[:last]
        kept = np.flatnonzero((small[:last] == low) | (small[width - 1 :][:last] == low))
        row = np.searchsorted(offs, kept + lo, "right") - 1
        kept = kept[kept + lo + k <= offs[row + 1]]
        places.append(kept + lo)
        marks.append((text.hashes(part, kept, kept + k) >> np.uint64(32)).astype(np.uint32))
    place = np.concatenate(places)
    return place, np.concatenate(marks), np.searchsorted(place, offs)


def whole_hash(data: bytes) -> np.ndarray:
    """The anchors of a text without kept k-mers: those of much shorter ones, or else the hash of all of it; none if empty."""
    if not data:
        return np.zeros(0, np.uint32)
    _, marks, _ = anchors(np.frombuffer(data, np.uint8), np.array([0, len(data)]), *SHORT)
    return marks if len(marks) else np.frombuffer(hashlib.blake2b(data, digest_size=4).digest(), "<u4").astype(np.uint32)


def encoded(marks: np.ndarray) -> str:
    return base64.b64encode(marks.astype("<u4").tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def _numbered(marks: np.ndarray) -> np.ndarray:
    """Each anchor with how many like it stand before it, as one number."""
    order = np.argsort(marks, kind="stable")
    ranked = marks[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    out = np.empty(len(marks), np.uint64)
    out[order] = np.arange(len(marks)) - np.repeat(first, np.diff(np.append(first, len(marks))))
    return out | (marks.astype(np.uint64) << np.uint64(32))


def longest_rise(places: np.ndarray) -> int:
    """The length of the longest rising subsequence."""
    if (places[1:] > places[:-1]).all():
        return len(places)
    ends: list[int] = []
    for p in places.tolist():
        at = bisect.bisect_left(ends, p)
        ends[at : at + 1] = [p]
    return len(ends)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """2 * anchors matched in order / all anchors; 1 if there are none at all."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    _, here, there = np.intersect1d(_numbered(a), _numbered(b), assume_unique=True, return_indices=True)
    return 2 * longest_rise(there[np.argsort(here)]) / (len(a) + len(b)) if len(here) else 0.0


def near(a: np.ndarray, a_text: bytes, b: np.ndarray, b_text: bytes) -> float:
    """The likeness of two texts with kept k-mers a and b; where either has none, both are compared by their shorter ones."""
    return likeness(a, b) if len(a) and len(b) else likeness(whole_hash(a_text), whole_hash(b_text))


def matches(a: bytes, b: bytes) -> list[tuple[int, int]]:
    """Places (in a, in b) of the anchors that stand exactly once in either text, in order of a."""
    found = []
    for data in (a, b):
        buf = np.frombuffer(data, np.uint8)
        place, marks, _ = anchors(buf, np.array([0, len(buf)]))
        ids, first, n = np.unique(marks, return_index=True, return_counts=True)
        found.append({int(m): int(place[i]) for m, i, c in zip(ids, first, n, strict=True) if c == 1})
    return sorted((p, found[1][m]) for m, p in found[0].items() if m in found[1])


def of_texts(data: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every text's anchors as (positions, hashes), without the stand-in for texts that have none."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    lo = 0
    while lo < len(data):
        hi, size = lo, 0
        while hi < len(data) and (hi == lo or size + len(data[hi]) <= text.CHUNK_BYTES):
            size += len(data[hi])
            hi += 1
        offs = np.concatenate([[0], np.cumsum([len(d) for d in data[lo:hi]])])
        place, marks, rows = anchors(np.frombuffer(b"".join(data[lo:hi]), np.uint8), offs)
        out += [(place[rows[i] : rows[i + 1]] - offs[i], marks[rows[i] : rows[i + 1]]) for i in range(hi - lo)]
        lo = hi
    return out


def fingerprint(docs: DataFrame) -> DataFrame:
    """`docs` with fingerprint (string) of text."""
    from lodeweave.llm.shared import widened

    docs = docs.drop("fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(t or "").encode() for t in batch.column("text").to_pylist()]
            made = [encoded(m if len(m) else whole_hash(d)) for d, (_, m) in zip(data, of_texts(data), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "fingerprint"])

    return docs.mapInArrow(tidy(run), widened(docs.schema, "fingerprint string"))


def edited_rows(rows: list[tuple[int | None, str, str]]) -> list[tuple]:
    """The result rows of (doc_id, text, next document's text)."""
    own, after, tails, edits = [], [], [], []
    for _, here, following in rows:
        n = len(here)
        head = here[: n - n // 3]
        head_bytes, tail = head.encode(), following[: n // 3].encode()
        own.append(here.encode())
        after.append(following.encode())
        edits.append((len(head_bytes), head_bytes + tail))
        tails.append(head_bytes[max(0, len(head_bytes) - K + 1) :] + tail)
    known: dict[int, np.ndarray] = {}
    places = of_texts(own)
    full = [m for _, m in places]
    # The next document is mostly the next row, whose anchors are known already.
    for i in range(len(rows) - 1):
        if rows[i][2] is rows[i + 1][1]:
            known[i] = full[i + 1]
    rest = [i for i in range(len(rows)) if i not in known]
    for i, (_, m) in zip(rest, of_texts([after[i] for i in rest]), strict=True):
        known[i] = m
    out = []
    for i, (doc_id, here, _) in enumerate(rows):
        cut, edit = edits[i]
        out.append([doc_id, len(here), hashlib.sha256(edit).hexdigest(), full[i], known[i], cut, edit])
    result = []
    for i, (row, (place, marks), (_, tail_marks)) in enumerate(zip(out, places, of_texts(tails), strict=True)):
        doc_id, n, digest, mine, following, cut, edit = row
        changed = np.concatenate([marks[: np.searchsorted(place, cut - K, "right")], tail_marks])
        near_edited, near_next = near(mine, own[i], changed, edit), near(mine, own[i], following, after[i])
        mine, changed = (m if len(m) else whole_hash(d) for m, d in ((mine, own[i]), (changed, edit)))
        result.append((doc_id, n, digest, encoded(mine), encoded(changed), near_edited, near_next))
    return result


def neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, text, part, closing), sorted within partitions so that each row's next one, by falling doc_id, follows it.

    Ids are cut into ranges, and the rows of an id that fills more than one range into parts by the hash of their texts;
    a part also gets a copy (closing) of the first row of the next one, and the last part that of the first. Only the
    parts' borders and first rows' keys come to the driver.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if parts is None:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    keys = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("h"))
    cuts = keys.approxQuantile("id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    # Ids that more than one cut falls on hold so many rows each; there are fewer of them than parts.
    often = sorted({int(c) for c, n in zip(*np.unique(np.array(cuts, np.float64), return_counts=True), strict=True) if n > 1})
    many = {r.id: r.n for r in keys.where(F.col("id").cast("double").isin([float(c) for c in often])).groupBy("id").agg(F.count("*").alias("n")).collect()} if often else {}
    share = max(1, keys.count() // parts)
    alone = np.array(sorted(many), np.int64)
    shares = np.array([max(1, -(-many[c] // share)) for c in alone.tolist()], np.int64)
    borders = np.unique(np.array([c for c in cuts if int(c) not in many], np.float64))

    def part_of(id_: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Numbers of parts, rising as ids fall and hashes rise."""
        # An id of its own stands between the two halves of the range it lies in.
        before = len(borders) - np.searchsorted(borders, id_.astype(np.float64), "left")
        larger = len(alone) - np.searchsorted(alone, id_, "right")  # ids of their own that come first
        used = np.concatenate([[0], np.cumsum(shares[::-1])])
        own = np.isin(id_, alone)
        width = np.ones(len(id_), np.int64)
        if own.any():
            width[own] = shares[np.searchsorted(alone, id_[own])]
        spot = ((h.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(33)).astype(np.int64) * width >> 31
        return before + larger + used[larger] + np.where(own, spot + 1, 0)

    @F.arrow_udf("int")
    def numbered(id_: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array(part_of(id_.to_numpy(zero_copy_only=False), h.to_numpy(zero_copy_only=False)).astype(np.int32))

    known = keys.groupBy(numbered("id", "h").alias("part")).agg(F.max(F.struct("id", (-1 - F.col("h")).alias("g"))).alias("first")).collect()
    first = {r.part: (r.first.id, -1 - r.first.g) for r in known}
    full = sorted(first)
    closes = {first[p]: full[i - 1] for i, p in enumerate(full)}  # the first part's first row closes the last part

    @F.arrow_udf("array<int>")
    def parts_of(id_: pa.Array, h: pa.Array) -> pa.Array:
        ids, hs = id_.to_numpy(zero_copy_only=False), h.to_numpy(zero_copy_only=False)
        rows = zip(part_of(ids, hs).tolist(), ids.tolist(), hs.tolist(), strict=True)
        return pa.array([[p, closes[i, x]] if (i, x) in closes else [p] for p, i, x in rows], pa.list_(pa.int32()))

    keyed = docs.withColumns({"h": F.xxhash64("text")})
    dealt = keyed.select("doc_id", "text", "h", F.posexplode(parts_of(F.coalesce("doc_id", F.lit(-(1 << 63))), "h")).alias("closing", "part"))
    return dealt.repartition(parts, "part").sortWithinPartitions("part", "closing", F.col("doc_id").desc_nulls_last(), "h", "text").drop("h")


def edits(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and its likeness to that and to the next document.

    The edited text has its last floor(n / 3) code points replaced by the first as many of the next document.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*edited_rows(rows), strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: tuple | None = None
        for batch in batches:
            rows, size = [], 0
            for doc_id, here, part, closing in zip(*(batch.column(c) for c in ("doc_id", "text", "part", "closing")), strict=True):
                here, part = here.as_py(), part.as_py()
                if pending is not None and pending[2] == part:
                    rows.append((pending[0], pending[1], here))
                    size += len(here)
                pending = None if closing.as_py() else (doc_id.as_py(), here, part)
                if size >= 2 * text.CHUNK_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

    return neighbours(docs).mapInArrow(tidy(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
