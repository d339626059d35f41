"""Near-duplicate detection over batches, with what earlier batches kept in an index on disk.

For every document that was kept the index has its exact hash, the shingles of its beginning, and
postings: the first of its shingles in an order that the first batch draws, as many as two alike sets can't both miss. Postings
are laid out by hash, so a batch's own are dealt to them and the index isn't shuffled; texts that
were accepted before are neither read nor shingled again. Batches beside the base are folded into
it when there are many.

A batch is first compared with the index; what is left is walked as `dedupe.greedy` does, and what
that keeps is added. So batches in rising order of id have the result of one walk over all of them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import text as T
from lodeweave.operators import dedupe
from lodeweave.session import discard, finished_versions, written
from lodeweave.sources.buckets import read_bucketed, write_bucketed

BUCKETS, BATCHES = 16, 8
DOCS, POSTINGS = "id long, h string, cut_bare boolean, b int, t array<bigint>", "g bigint, id long, b int"


class NearIndex:
    """An index below a folder; parts v0, v1, ... are batches or what batches were folded into, from `first` on."""

    def __init__(self, spark: SparkSession, path: str, threshold: float = dedupe.THRESHOLD, k: int = dedupe.SHINGLE_WORDS, kept_chars: int = dedupe.KEPT_CHARS, buckets: int = BUCKETS, batches: int = BATCHES):
        self.spark, self.path, self.threshold, self.k, self.kept_chars, self.buckets, self.batches = spark, path.rstrip("/"), threshold, k, kept_chars, buckets, batches

    def parts(self) -> list[str]:
        """The folders that hold: the last one that others were folded into, and what came after it. A part counts once its documents, which come last, are written."""
        done = finished_versions(self.spark, self.path, "v", "docs")
        folded = [k for k in finished_versions(self.spark, self.path, "folded=") if k in done]
        return [f"{self.path}/v{k}" for k in done if not folded or k >= folded[-1]]

    def _number(self) -> int:
        done = finished_versions(self.spark, self.path, "v", "docs")
        return done[-1] + 1 if done else 0

    def docs(self) -> DataFrame:
        parts = self.parts()
        return self.spark.read.schema(DOCS).parquet(*[f"{p}/docs" for p in parts]) if parts else self.spark.createDataFrame([], DOCS)

    def _save(self, docs: DataFrame, postings: DataFrame) -> int:
        """A new part."""
        number = self._number()
        write_bucketed(postings, f"{self.path}/v{number}/postings", "g", self.buckets)
        docs.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/v{number}/docs")
        return number

    def _level(self, sets: DataFrame) -> np.ndarray:
        """The order of shingles that all postings have: drawn from the first batch; parts without one have them by number."""
        if not finished_versions(self.spark, self.path, "order="):
            if self.parts():
                return np.zeros(dedupe.SLOTS, np.uint8)
            dedupe.order_of(sets).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/order=0")
        return dedupe.levels(self.spark.read.schema("slot int, level int").parquet(f"{self.path}/order=0"))

    def _candidates(self, asked: DataFrame) -> DataFrame:
        """(i, j) of documents' prefixes (id, size, g) and indexed ones that share a shingle of both and may be near by sizes and places."""
        rows = written(asked.select(F.col("id").alias("i"), F.col("size").alias("a"), F.posexplode("g").alias("p", "g")), "asked")
        close = (F.col("b") >= self.threshold * F.col("a") - 1e-9) & (F.col("a") >= self.threshold * F.col("b") - 1e-9)
        found = [rows.join(read_bucketed(self.spark, f"{p}/postings", POSTINGS, "g", self.buckets).withColumnRenamed("id", "j"), "g").where(close).select("i", "j", "a", "b", "p") for p in self.parts()]
        met = reduce(DataFrame.unionByName, found).groupBy("i", "j").agg(F.count("*").alias("n"), F.max("p").alias("p"), F.first("a").alias("a"), F.first("b").alias("b"))
        most = F.col("n") + F.col("a") - F.col("p") - 1
        return met.where(most * (1 + self.threshold) >= self.threshold * (F.col("a") + F.col("b")) - 1e-6).select("i", "j")

    def add(self, docs: DataFrame) -> DataFrame:
        """(id, is_unique, duplicate_of, reason, jaccard) of a batch (id, content) whose ids are larger than all before; the unique ones are added."""
        batch = docs.select("id", F.coalesce("content", F.lit("")).alias("content"))
        cut = F.left("content", F.lit(self.kept_chars))
        bare = lambda c: T.word_count(F.lower(c)) < self.k
        rows = written(batch.select("id", T.dedupe_hash(F.col("content")).alias("h"), bare(F.col("content")).alias("bare"), bare(cut).alias("cut_bare")), "batch")
        sets = dedupe.shingled(batch, self.threshold, self.k, self.kept_chars)
        level = self._level(sets)
        made = written(dedupe.prefixes(sets, level, self.threshold), "prefixes")
        if self.parts():
            known = self.docs().select("id", "h", "cut_bare", "b", "t")
            copies = rows.select("id", "h").join(known.groupBy("h").agg(F.min("id").alias("j")), "h").select("h", "j", F.lit("exact_duplicate").alias("reason"), F.lit(None).cast("double").alias("jaccard")).distinct()
            heads = rows.groupBy("h").agg(F.min_by(F.struct("id", "bare"), "id").alias("r")).select("h", "r.*").join(copies.select("h"), "h", "left_anti")
            heads = written(heads, "heads")
            pairs = self._candidates(made.where("whole").join(heads.select("id"), "id", "left_semi"))
            near = dedupe.verified(pairs, sets, self.threshold, known.select("id", "t")).join(heads.select(F.col("id").alias("i"), "h"), "i")
            near = near.groupBy("h").agg(F.min("j").alias("j"), F.min_by("jaccard", "j").alias("jaccard"))
            empty = known.where("cut_bare").agg(F.min("id").alias("j")).where("j IS NOT NULL")
            alike = heads.where("bare").join(F.broadcast(empty)).select("h", "j", F.lit(1.0).alias("jaccard"))  # one row
            gone = near.unionByName(alike).select("h", "j", F.lit("near_duplicate").alias("reason"), "jaccard").unionByName(copies)
            gone = written(gone, "gone")
            decided = rows.select("id", "h").join(gone, "h").select("id", F.lit(False).alias("is_unique"), F.col("j").alias("duplicate_of"), "reason", "jaccard")
            left = rows.join(gone, "h", "left_anti").select("id")
            judged = dedupe.greedy(batch, self.threshold, self.k, self.kept_chars, level=level, among=left).unionByName(decided)
        else:
            judged = dedupe.greedy(batch, self.threshold, self.k, self.kept_chars, level=level)
        judged = written(judged, "judged")
        fresh = written(judged.where("is_unique").select("id"), "fresh")
        held = dedupe.only(sets, fresh).select("id", F.coalesce("t", "s").alias("t"))
        self._save(
            rows.join(fresh, "id", "left_semi").select("id", "h", "cut_bare").join(held.withColumn("b", F.size("t")), "id").select("id", "h", "cut_bare", "b", "t"),
            made.where("cut").join(fresh, "id", "left_semi").select(F.explode("g").alias("g"), "id", F.col("size").alias("b")),
        )
        discard(made)
        if len(self.parts()) > self.batches:
            self.compact()
        return judged

    def compact(self) -> None:
        """Fold all parts into one; the old ones stay for those who read them, and `vacuum` removes them."""
        postings = reduce(DataFrame.unionByName, [read_bucketed(self.spark, f"{p}/postings", POSTINGS, "g", self.buckets) for p in self.parts()])
        number = self._number()
        # The mark counts only together with the part, which comes last.
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/folded={number}")
        self._save(self.docs(), postings)

    def vacuum(self) -> None:
        """Remove the parts that were folded into others."""
        from lodeweave.session import remove

        kept = set(self.parts())
        for k in finished_versions(self.spark, self.path, "v", "docs"):
            if f"{self.path}/v{k}" not in kept:
                remove(self.spark, f"{self.path}/v{k}")
