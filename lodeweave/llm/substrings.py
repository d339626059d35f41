"""Removal of long repeated word sequences, with a log-structured index of fingerprints.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged; a window is `window` consecutive words of one text.
Of the short word sequences inside a window, the one with the smallest hash is its
anchor. Equal windows have equal anchors, so only windows whose anchor occurs again can
repeat. The index keeps the anchors' hashes and counts in immutable runs sorted by hash:
a batch's anchors are written as a new run, merge-joined with all runs to find those
that occur more than once, and runs are compacted when there are many. Beside the runs it
keeps every batch's documents and the places of their anchors, so that a new batch is
verified against all earlier ones, whose documents may lose words by it too. A whole
table goes through the index in a few batches, with the result of one.

What shares an anchor is then verified: neighbouring windows with the same anchor make a
stretch, whose words are hashed as a whole; equal stretches repeat entirely, and where
stretches with one anchor differ, one of each kind is compared window by window. All
counting is summed up before it is shuffled and joined back so that hot hashes can be
split; no group is gathered anywhere.

Defined results: a null or empty text, or one with fewer words than a window, has nothing
removed; a null doc_id is kept; repeated rows are repeats of one another; an empty table
gives an empty result; other columns are left behind.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.llm import text
from lodeweave.llm.shared import discard, tidy, unused, written

WINDOW = 35
ANCHOR_WORDS = 8
#: Runs that the index holds before they are merged into one.
MAX_RUNS = 4
#: Batches in which a whole table goes through the index.
BATCHES = 2
_BLOCK = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)
#: A stretch is (first window * STRETCH + number of windows); it has at most WINDOW windows.
STRETCH = 64


class FingerprintIndex:
    """Counts of anchor hashes in sorted immutable runs (tables of hash and n in the shared folder), and what verification needs.

    `docs` has the batches (doc_id, th, text), `known` their summaries, and `covered` the repeated stretches (doc_id, th, f)
    that each batch brought to light in itself and in those before it. `keys` are those of its hashes: the first one's make anchors,
    the second one's make windows and stretches, so different words would have to be equal under two independent keys to be taken for repeats.
    """

    def __init__(self, runs: list[DataFrame] | None = None, keys: tuple[int, int] | None = None):
        self.runs = list(runs or [])
        self.keys = keys or (text.new_key(), text.new_key())
        self.docs: list[DataFrame] = []
        self.known: list[DataFrame] = []
        self.covered: list[DataFrame] = []

    def save(self, folder: str) -> None:
        """Write down what the index is made of, in a folder that all can read: its tables stay where they are, and batches that were never written are.

        The list of tables comes last, as a new version; `open` takes the largest finished one.
        """
        spark = self.runs[0].sparkSession
        self.docs = [df if _is_written(df) else written(df, "batch") for df in self.docs]
        listed = [(kind, k, _folder_of(df), df.schema.json()) for kind in ("runs", "docs", "known", "covered") for k, df in enumerate(getattr(self, kind))]
        listed += [("keys", k, str(key), "") for k, key in enumerate(self.keys)]
        found = _saved(spark, folder)
        spark.createDataFrame(listed, "kind string, place int, path string, schema string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/index={found[-1] + 1 if found else 0}")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        """The index as it was saved last; its keys go on, so that new hashes meet the old ones."""
        found = _saved(spark, folder)
        if not found:
            raise ValueError(f"no index in {folder}")
        index, rows = cls(), sorted(spark.read.parquet(f"{folder}/index={found[-1]}").collect(), key=lambda r: (r.kind, r.place))
        index.keys = tuple(int(r.path) for r in rows if r.kind == "keys")
        for kind in ("runs", "docs", "known", "covered"):
            setattr(index, kind, [spark.read.schema(T.StructType.fromJson(json.loads(r.schema))).parquet(r.path) for r in rows if r.kind == kind])
        return index

    def add(self, hashes: DataFrame) -> DataFrame:
        """Write the hashes (column a) of a batch as a new run, which is returned, and compact if there are too many."""
        counted = hashes.groupBy(F.col("a").alias("hash")).agg(F.count("*").alias("n"))
        run = written(counted.sortWithinPartitions("hash"), "run")
        self.runs.append(run)
        if len(self.runs) > MAX_RUNS:
            self.compact()
        return run

    def counts(self) -> DataFrame:
        if len(self.runs) == 1:
            return self.runs[0]
        every = self.runs[0]
        for run in self.runs[1:]:
            every = every.unionByName(run)
        return every.groupBy("hash").agg(F.sum("n").alias("n"))

    def compact(self) -> None:
        self.runs = [written(self.counts().sortWithinPartitions("hash"), "run")]

    def repeated(self, rows: DataFrame) -> DataFrame:
        """The rows of a batch whose hash (column a) occurs more than once in all that was added."""
        # Written, so that the join deals rows anew and a hot hash can be split.
        often = written(self.counts().where("n > 1").select("hash"), "often")
        return rows.join(often, F.col("a") == F.col("hash")).drop("hash")


def _folder_of(df: DataFrame) -> str:
    """Where a table that `written` made lies."""
    return df._jdf.queryExecution().analyzed().collectLeaves().head().relation().location().rootPaths().head().toString()


def _is_written(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().analyzed()
    return plan.getClass().getSimpleName() == "LogicalRelation"


def _saved(spark: SparkSession, folder: str) -> list[int]:
    """The versions of a saved index that were written to their end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = [s.getPath() for s in system.listStatus(path)]
    return sorted(int(p.getName()[6:]) for p in names if p.getName().startswith("index=") and system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def stretches(words: np.ndarray, rows: np.ndarray, window: int = WINDOW, short: int = ANCHOR_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts whose word hashes are words[rows[i]:rows[i + 1]]: anchor hashes, first windows, numbers of windows, and the texts' offsets among them."""
    grams = text.sequences(words, short)
    width = window - short + 1
    n = len(words) - window + 1
    nothing = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, np.uint64), nothing, nothing, np.zeros(len(rows), np.int64)
    place = np.zeros(n, np.int64)
    for lo in range(0, n, _BLOCK):
        part = grams[lo : min(len(grams), lo + _BLOCK + width - 1)]
        low = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        reach = 1
        while reach * 2 <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < width:
            low = np.minimum(low[: len(part) - width + 1], low[width - reach :])
        low = low[: min(_BLOCK, n - lo)]
        place[lo : lo + len(low)] = (low & _PLACE).astype(np.int64) + lo
    row = np.searchsorted(rows, np.arange(n), "right") - 1
    valid = np.flatnonzero(np.arange(n) + window <= rows[row + 1])
    if not len(valid):
        return np.zeros(0, np.uint64), nothing, nothing, np.zeros(len(rows), np.int64)
    at = place[valid]
    fresh = np.concatenate([[True], (at[1:] != at[:-1]) | (row[valid[1:]] != row[valid[:-1]])])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(valid)))
    start = valid[first]
    return grams[at[first]], start - rows[row[start]], count, np.searchsorted(row[start], np.arange(len(rows)))


def _word_hashes(column: pa.Array, key: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for lo, _, buf, offs in text.groups(column):
        starts, ends, rows = text.words(buf, offs)
        yield lo, buf, starts, ends, text.hashes(buf, starts, ends, key=key), rows


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): rows with equal ids and texts have equal results, so both together name a document."""
    body = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("text"))


def summary(docs: DataFrame, window: int = WINDOW, key: int = 0) -> DataFrame:
    """Per document: number of words, digest of all words joined by one space, and its stretches (a, f) by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sizes, marks, places = [], [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for _, buf, starts, ends, words, rows in _word_hashes(batch.column("text"), key):
                a, first, count, of = stretches(words, rows, window)
                marks.append(a)
                places.append(first * STRETCH + count)
                sizes += np.diff(of).tolist()
                n += np.diff(rows).tolist()
                digest += [hashlib.sha256(text.joined(buf, starts[i:j], ends[i:j])).digest() for i, j in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.int64))) for x in (marks, places)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), *lists], ["doc_id", "th", "n_words", "digest", "a", "f"])

    return docs.mapInArrow(tidy(run), "doc_id long, th long, n_words long, digest binary, a array<long>, f array<long>")


def _same_document(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """A join on doc_id (null meets null) and th that keeps the left side's columns of these names."""
    right = right.withColumnsRenamed({"doc_id": "_doc", "th": "_th"})
    out = left.join(right, left.doc_id.eqNullSafe(F.col("_doc")) & (left.th == F.col("_th")), how)
    return out if how in ("left_semi", "left_anti") else out.drop("_doc", "_th")


def _hashed_stretches(found: DataFrame, window: int, key: int) -> DataFrame:
    """(doc_id, th, text, runs) with each stretch's anchor, place and the hash of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("f", pa.int64()), ("sig", pa.int64())]))
        for batch in batches:
            asked, out = batch.column("runs").to_pylist(), []
            for lo, _, _, _, words, rows in _word_hashes(batch.column("text"), key):
                every = text.sequences(words, window)
                for i in range(len(rows) - 1):
                    runs = sorted({(r["f"], r["a"]) for r in asked[lo + i]})
                    f = np.array([f for f, _ in runs], np.int64)
                    first, n = rows[i] + f // STRETCH, f % STRETCH
                    # The first and the last window hold all words of a stretch, which has at most `window` windows.
                    sig = text.mix(text.mix(every[first] + n.astype(np.uint64)) ^ every[first + n - 1])
                    out.append([{"a": a, "f": p, "sig": s} for (p, a), s in zip(runs, sig.astype(np.int64).tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "th", "text")), pa.array(out, kind)], ["doc_id", "th", "text", "runs"])

    return found.mapInArrow(tidy(run), "doc_id long, th long, text string, runs array<struct<a:long,f:long,sig:long>>")


def _windows(found: DataFrame, window: int, key: int) -> DataFrame:
    """(doc_id, th, at, a, h, c) for every window of the asked stretches (a, f, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths, asked = (batch.column(c).to_pylist() for c in ("doc_id", "th", "asked"))
            for lo, _, _, _, words, rows in _word_hashes(batch.column("text"), key):
                every = text.sequences(words, window)
                cols: list[list] = [[], [], [], [], [], []]
                for i in range(len(rows) - 1):
                    for r in asked[lo + i]:
                        first, n = r["f"] // STRETCH, r["f"] % STRETCH
                        for col, values in zip(cols, ([ids[lo + i]] * n, [ths[lo + i]] * n, range(first, first + n), [r["a"]] * n, every[rows[i] + first : rows[i] + first + n].astype(np.int64).tolist(), [r["c"]] * n), strict=True):
                            col.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "th", "at", "a", "h", "c"])

    return found.mapInArrow(tidy(run), "doc_id long, th long, at long, a long, h long, c long")


def _cut(found: DataFrame, window: int) -> DataFrame:
    """(doc_id, th, n_removed, kept) without the words that the windows in `runs` cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, removed, kept = batch.column("runs").to_pylist(), [], []
            for lo, buf, starts, ends, _, rows in _word_hashes(batch.column("text")):
                for i in range(len(rows) - 1):
                    size = rows[i + 1] - rows[i]
                    edge = np.zeros(size + 1, np.int64)
                    f = np.array(asked[lo + i], np.int64)
                    np.add.at(edge, f // STRETCH, 1)
                    np.add.at(edge, f // STRETCH + f % STRETCH + window - 1, -1)
                    left = rows[i] + np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    removed.append(int(size - len(left)))
                    kept.append(text.joined(buf, starts[left], ends[left]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "th", "n_removed", "kept"])

    return found.mapInArrow(tidy(run), "doc_id long, th long, n_removed long, kept string")


def _all(tables: list[DataFrame]) -> DataFrame:
    every = tables[0]
    for table in tables[1:]:
        every = every.unionByName(table)
    return every


def take_in(docs: DataFrame, index: FingerprintIndex, window: int = WINDOW) -> None:
    """Add a batch (doc_id, th, text) to the index and verify it against itself and all that the index has seen."""
    index.docs.append(docs)
    index.known.append(written(summary(docs, window, index.keys[0]), "stretches"))
    places = lambda known: known.select("doc_id", "th", F.explode(F.arrays_zip("a", "f")).alias("r")).select("doc_id", "th", "r.a", "r.f")
    run = index.add(places(index.known[-1]))
    if len(index.docs) == 1:
        found = index.repeated(places(index.known[0]))
    else:  # earlier stretches count again where the batch has their anchor; all others are settled
        often = written(index.counts().where("n > 1").select("hash").join(run.select("hash"), "hash", "left_semi"), "often")
        found = places(_all(index.known)).join(often, F.col("a") == F.col("hash")).drop("hash")
    asked = found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "f")).alias("runs"))
    held = written(_hashed_stretches(_same_document(_all(index.docs), asked), window, index.keys[1]), "held")

    runs = held.select("doc_id", "th", F.explode("runs").alias("r")).select("doc_id", "th", "r.a", "r.f", "r.sig", F.xxhash64("doc_id", "th", "r.f").alias("own"))
    kinds = written(runs.groupBy("a", "sig").agg(F.count("*").alias("c"), F.min("own").alias("chosen")), "kinds")
    # Where stretches with one anchor differ and one of them is alone, its windows may still repeat in the others.
    open_ = kinds.groupBy(F.col("a").alias("_a")).agg(F.count("*").alias("k"), F.min("c").alias("least")).where("k > 1 AND least = 1").select("_a")
    kinds = kinds.join(open_, F.col("a") == F.col("_a"), "left").select(F.col("a").alias("_a"), F.col("sig").alias("_sig"), "c", "chosen", F.col("_a").isNotNull().alias("open"))
    judged = runs.join(kinds, (F.col("a") == F.col("_a")) & (F.col("sig") == F.col("_sig")))
    judged = judged.select("doc_id", "th", "a", "f", "c", (F.col("open") & (F.col("own") == F.col("chosen"))).alias("asked")).where("c > 1 OR asked")
    judged = written(judged, "judged")

    asked = judged.where("asked").groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "f", "c")).alias("asked"))
    windows = written(_windows(_same_document(held.select("doc_id", "th", "text"), asked), window, index.keys[1]), "windows")
    again = windows.groupBy(F.col("a").alias("_a"), F.col("h").alias("_h")).agg(F.sum("c").alias("n")).where("n > 1").select("_a", "_h")
    single = windows.where("c = 1").join(again, (F.col("a") == F.col("_a")) & (F.col("h") == F.col("_h")), "left_semi")
    covered = judged.where("c > 1").select("doc_id", "th", "f").unionByName(single.select("doc_id", "th", (F.col("at") * STRETCH + 1).alias("f")))
    index.covered.append(written(covered, "covered"))
    discard(held, kinds, judged, windows)


def repeats(docs: DataFrame, window: int = WINDOW, index: FingerprintIndex | None = None, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """A summary (doc_id, th, n_words, digest) of every row, and (doc_id, th, n_removed, kept) once for each document that loses words.

    The rows go through `index` in batches. Where it holds earlier ones, the second table has their documents as well,
    with all that they have lost so far.
    """
    docs, index = identified(docs), index or FingerprintIndex()
    before = len(index.docs)
    for k in range(batches):
        take_in(docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(batches)) == k) if batches > 1 else docs, index, window)
    covered = _all(index.covered).groupBy("doc_id", "th").agg(F.collect_set("f").alias("runs"))
    seen = index.docs[:before] + [docs]
    cut = _cut(_same_document(_all(seen), covered), window).dropDuplicates(["doc_id", "th"])
    return _all(index.known[before:]).select("doc_id", "th", "n_words", "digest"), cut


def digests(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    known, cut = repeats(docs, window, batches=batches)
    out = _same_document(known, cut, "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce(F.sha2("kept", 256), F.lower(F.hex("digest"))).alias("kept_sha256"))


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with repeated sequences cut out of text; a text that loses nothing stays as it is, another has one space between words."""
    doc, mark, kept = (unused(docs, name) for name in ("_doc", "_th", "_kept"))
    _, cut = repeats(docs, window)
    cut = cut.select(F.col("doc_id").alias(doc), F.col("th").alias(mark), F.col("kept").alias(kept))
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    out = docs.join(cut, docs["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (th == F.col(mark)), "left")
    return out.withColumn("text", F.coalesce(kept, "text")).select(*docs.columns)
