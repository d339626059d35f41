"""Session helpers of this subpackage: tables, the shared folder, the label split."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give the system back what Arrow and the C library keep of freed memory, where they can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives memory back at its end: workers live on, and share an executor's memory with the next stage's."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


def widened(schema: T.StructType, ddl: str) -> T.StructType:
    """A copy of `schema` with the fields of `ddl` behind its own."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` is called so (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or where that is unset and everything runs on this machine, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodeweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """`df` as a table in the shared folder: it survives lost executors and cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    # Let Spark drop the shuffle files of earlier steps, which nothing refers to any more.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` made and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of a filter of wanted hashes at most (16 MB); beyond that it lets more through, but never less.
FILTER_BITS = 1 << 27


def only_wanted(rows: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """The rows whose hash (column `name`, a long) is perhaps among those of `wanted`, so that a join shuffles fewer.

    The filter is a bitmap of 16 bits for each wanted row and FILTER_BITS at most; built by SQL aggregates, it alone reaches the driver.
    """
    bits = 1 << 16
    n = wanted.count()
    while bits < min(16 * n, FILTER_BITS):
        bits *= 2
    at = F.pmod(F.xxhash64(F.lit(3), F.col(name)), F.lit(bits)) + 1
    parts = wanted.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in parts:
        part = np.frombuffer(bytes(r.bits), np.uint8)
        lo = (r.bucket - 1) * len(part)
        bitmap[lo : lo + len(part)] = part[: max(0, len(bitmap) - lo)]
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def perhaps(place: pa.Array) -> pa.Array:
        p = place.to_numpy(zero_copy_only=False)
        return pa.array((sent.value[p >> 3] >> (p & 7)) & 1 == 1)

    return rows.where(perhaps(at - 1))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4: such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


#: Characters of the texts that a sample of one label value has at most.
SAMPLE_CHARS = 8_000_000


def learnable(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of the labelled documents among `docs` that may be learned from: none held out, without null ids or labels.

    A repeated id counts once, with its larger label.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    return known.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, chars: int = SAMPLE_CHARS) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of at most `most` rows and about `chars` characters of each label value, and how many learnable rows each value has.

    The rows with the smallest hash of the id are taken, so the sample is the same on every run. Of documents with
    equal ids the smallest text is taken.
    """
    known = written(learnable(docs, labels, label), "learnable")
    total = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(7))
    parts = [known.where(F.col("y") == v).orderBy(order, "doc_id").limit(most) for v in (0, 1)]
    # Bounded by 2 * most rows of two numbers, so it may be sent to every executor.
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    body = F.coalesce("text", F.lit(""))
    rows = written(docs.select("doc_id", body.alias("text")).join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")), "sample")
    lengths = rows.select("y", "doc_id", F.length("text").alias("n")).orderBy("y", order, "doc_id").collect()
    keep, used = [], {}
    for r in lengths:
        if used.setdefault(r.y, 0) + r.n <= chars:  # a text that doesn't fit any more is left out, not cut
            used[r.y] += r.n
            keep.append(r.doc_id)
    if len(keep) < len(lengths):
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in keep], "doc_id long")), "doc_id", "left_semi")
    return rows, total
