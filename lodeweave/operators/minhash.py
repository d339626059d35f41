"""Near-duplicate candidates by MinHash bands, verified exactly.

A document's signature has the smallest of its shingles' hashes under many hash functions; two
documents agree in one of them with the probability of their likeness. Bands of a signature that
are equal bring documents together. Candidates are verified on the shingle sets themselves, so a
pair that is reported is right; what bands miss is missed, which `recall` measures against `near_pairs`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import text as T
from lodeweave.operators.dedupe import KEPT_CHARS, SHINGLE_WORDS, THRESHOLD, classes, for_all, shingled, verified

#: Bands, and hash functions of a band: a pair of likeness s is missed with probability (1 - s ** ROWS) ** BANDS, 0.2 % at 0.85.
BANDS, ROWS = 24, 8


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def signatures(flat: np.ndarray, sizes: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """n smallest hashes of each set; sets follow one another in `flat` and none is empty."""
    starts = np.cumsum(sizes) - sizes
    keys = np.random.default_rng(seed).integers(1, 1 << 63, (n, 2), np.uint64)
    out = np.zeros((len(sizes), n), np.uint64)
    for k, (a, b) in enumerate(keys):
        out[:, k] = np.minimum.reduceat(_mixed((flat ^ a) * (b | np.uint64(1))), starts)
    return out


def banded(sets: DataFrame, column: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, size, keys) of documents (id, a set of 64-bit hashes): a key for each band; empty sets have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column_ = batch.column("s")
            sizes = np.diff(column_.offsets.to_numpy())
            full = np.flatnonzero(sizes)
            if not len(full):
                continue
            made = signatures(column_.flatten().to_numpy().astype(np.int64).view(np.uint64), sizes[full], bands * rows)
            keys = np.zeros((len(full), bands), np.uint64)
            for r in range(rows):
                keys = _mixed(keys + made[:, r::rows][:, :bands] * np.uint64(2 * r + 3))
            held = pa.ListArray.from_arrays(np.arange(len(full) + 1, dtype=np.int32) * bands, keys.ravel().view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(full)), pa.array(sizes[full].astype(np.int64)), held], ["id", "size", "keys"])

    return sets.select(F.col("id").cast("long").alias("id"), F.col(column).alias("s")).mapInArrow(run, "id long, size long, keys array<bigint>")


def _met(sets: DataFrame, asked: DataFrame, threshold: float, bands: int, rows: int) -> DataFrame:
    """(i, j) of ids `asked` (id, last) that share a band, j smaller than i's `last`, with sizes that allow the likeness; of `dedupe.shingled` sets."""
    whole = banded(sets.where("s IS NOT NULL"), "s", bands, rows)
    cut = banded(sets.select("id", F.coalesce("t", "s").alias("s")).where("s IS NOT NULL"), "s", bands, rows)
    left = whole.join(asked.select("id", "last"), "id").select(F.col("id").alias("i"), F.col("size").alias("a"), "last", F.posexplode("keys").alias("band", "key"))
    right = cut.join(asked.select("id"), "id", "left_semi").select(F.col("id").alias("j"), F.col("size").alias("b"), F.posexplode("keys").alias("band", "key"))
    close = (F.col("b") >= threshold * F.col("a") - 1e-9) & (F.col("a") >= threshold * F.col("b") - 1e-9)
    return left.join(right, ["band", "key"]).where((F.col("j") < F.col("last")) & (F.col("j") != F.col("i")) & close).select("i", "j").distinct()


def candidates(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE_WORDS, kept_chars: int = KEPT_CHARS, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(i, j) of documents j < i that share a band, with sizes that allow the likeness; and the documents' sets (id, s, t), as `dedupe.shingled` has them."""
    sets = shingled(docs, threshold, k, kept_chars)
    return _met(sets, docs.select("id", F.col("id").alias("last")), threshold, bands, rows), sets


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE_WORDS, kept_chars: int = KEPT_CHARS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(i, j, jaccard) as `dedupe.near_pairs` has them, but for what the bands miss; copies stand for one another until pairs are given out."""
    known = classes(docs)
    sets = shingled(docs, threshold, k, kept_chars)
    found = verified(_met(sets, known.where("id = first"), threshold, bands, rows), sets, threshold)
    return for_all(found, known, docs, threshold, k, kept_chars)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: how many true pairs there are, how many reported ones aren't, and the share of the true ones that was found."""
    met = truth.select("i", "j", F.lit(1).alias("true")).join(found.select("i", "j", F.lit(1).alias("hit")), ["i", "j"], "full")
    return met.agg(F.count("true").alias("pairs"), F.count_if(F.col("true").isNull()).alias("wrong"), F.coalesce(F.count_if(F.col("true").isNotNull() & F.col("hit").isNotNull()) / F.count("true"), F.lit(1.0)).alias("recall"))
