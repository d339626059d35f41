"""The URL cache as a table that is laid out by url.

The base is bucketed by url; puts are small tables beside it, bucketed alike, and are folded into a
new base when there are many. A look-up joins urls with the base where it lies: urls are dealt to
its buckets, and the cache isn't shuffled. Nothing that is read is overwritten, and a put that was
interrupted isn't there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators import cache as C
from lodeweave.sources.buckets import Versions, read_bucketed, write_bucketed

BUCKETS, PUTS = 16, 8
ROW = "url string, content_hash string, last_scraped timestamp, success boolean, status_code int, category string, metadata string"


class CacheTable:
    """A cache below a folder. Of a url's rows the one with the largest `order` holds, of equal ones the one that was put last.

    `buckets` must be the same for all who open it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = ROW, order: str = "last_scraped", buckets: int = BUCKETS, puts: int = PUTS):
        self.spark, self.schema, self.order, self.buckets, self.puts = spark, schema, order, buckets, puts
        self.versions = Versions(spark, path)
        self.names = [f.split()[0] for f in schema.split(", ")]

    def _read(self, path: str) -> DataFrame:
        return read_bucketed(self.spark, path, self.schema, "url", self.buckets)

    def put(self, rows: DataFrame) -> None:
        """Insert or replace rows with a url."""
        new = C.latest(rows.where("url IS NOT NULL").select(*self.names), [self.order])
        to = self.versions.next_base() if self.versions.base() is None else self.versions.next_addition()
        write_bucketed(new, to, "url", self.buckets)
        if len(self.versions.additions()) >= self.puts:
            self.compact()

    def _puts(self) -> DataFrame | None:
        """The last row of each url among what was put beside the base."""
        parts = [self._read(p).withColumn("_k", F.lit(k)) for k, p in enumerate(self.versions.additions())]
        return C.latest(reduce(DataFrame.unionByName, parts), [self.order, "_k"]).drop("_k") if parts else None

    def _base(self) -> DataFrame:
        base = self.versions.base()
        return self.spark.createDataFrame([], self.schema) if base is None else self._read(f"{self.versions.path}/v{base}")

    def current(self) -> DataFrame:
        """One row for each url. Only what was put beside the base is shuffled, if anything."""
        base, puts = self._base(), self._puts()
        if puts is None:
            return base
        mine, theirs = base.select("url", F.struct(*self.names).alias("_b")), puts.select("url", F.struct(*self.names).alias("_p"))
        later = F.col("_b").isNull() | (F.col("_p").isNotNull() & F.coalesce(F.col(f"_p.{self.order}") >= F.col(f"_b.{self.order}"), F.col(f"_b.{self.order}").isNull()))
        return mine.join(theirs, "url", "full").select(F.when(later, F.col("_p")).otherwise(F.col("_b")).alias("_r")).select("_r.*")

    def joined(self, urls: DataFrame) -> DataFrame:
        """`urls` with `cached` and the cache's columns in a struct `row`."""
        known = self.current().select(F.col("url").alias("_url"), F.struct(*self.names).alias("row"))
        return urls.join(known, urls.url == F.col("_url"), "left").withColumn("cached", F.col("_url").isNotNull()).drop("_url")

    def remove(self, keep: DataFrame) -> None:
        """A new base of the rows that are left after an invalidation, such as `cache.without_category(table.current(), ...)`."""
        write_bucketed(keep.select(*self.names), self.versions.next_base(), "url", self.buckets)

    def compact(self) -> None:
        self.remove(self.current())
