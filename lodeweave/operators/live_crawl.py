"""A crawl that fetches, with its frontier in a folder, so that it goes on where it was stopped.

Round k has a frontier (the urls found at depth k), the pages fetched of it, and the links found
on these; round k + 1 is what no earlier frontier has. Each is a table that is written whole or
counts as not written, so a driver that dies loses the step it was at and nothing else. What was
seen is put into one table every few rounds, so a round doesn't read as many folders as there were rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import html as H
from lodeweave.functions import urls as U
from lodeweave.session import finished_versions

#: Rounds after which what was seen is written as one table.
COMPACT = 8
FRONTIER = "url string, depth int, kind string"


class LiveCrawl:
    """A crawl below a folder, from seeds, within domains.

    fetch takes (url, position) and returns rows of `fetching.FETCHED`; allowed may take (url) rows and leave some out, as robots rules do.
    PDFs are found and not followed. max_pages bounds the pages that were fetched well, nearest first, ties by url.
    """

    def __init__(self, spark: SparkSession, path: str, seeds: list[str], domains: list[str], fetch: Callable[[DataFrame], DataFrame], max_pages: int = 6000, allowed: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.seeds, self.domains, self.fetch, self.max_pages, self.allowed = spark, path.rstrip("/"), seeds, domains, fetch, max_pages, allowed

    def _at(self, k: int, name: str) -> str:
        return f"{self.path}/round={k}/{name}"

    def _done(self, name: str) -> list[int]:
        return finished_versions(self.spark, self.path, "round=", name)

    def seen(self) -> DataFrame:
        """The frontiers of all rounds: the last table that puts them together, and those after it."""
        whole = finished_versions(self.spark, self.path, "seen=")
        later = [k for k in self._done("frontier") if not whole or k > whole[-1]]
        paths = [*([f"{self.path}/seen={whole[-1]}"] if whole else []), *(self._at(k, "frontier") for k in later)]
        return self.spark.read.schema(FRONTIER).parquet(*paths) if paths else self.spark.createDataFrame([], FRONTIER)

    def pages(self) -> DataFrame:
        """All fetched pages, with depth; failed ones as rows of their own."""
        done = self._done("pages")
        if not done:
            return self.fetch(self.spark.createDataFrame([], "url string, position long")).withColumn("depth", F.lit(0)).limit(0)
        return self.spark.read.parquet(*[self._at(k, "pages") for k in done])

    def step(self) -> bool:
        """The next step that isn't done: a frontier, its pages, or its links. False if the crawl is over."""
        rounds = self._done("frontier")
        if not rounds:
            rows = [(u, 0, "page") for u in dict.fromkeys(self.seeds)]
            self.spark.createDataFrame(rows, FRONTIER).write.mode("overwrite").parquet(self._at(0, "frontier"))
            return True
        k = rounds[-1]
        if k not in self._done("pages"):
            front = self.spark.read.schema(FRONTIER).parquet(self._at(k, "frontier")).where("kind = 'page'").select("url", F.monotonically_increasing_id().alias("position"))
            self.fetch(front).withColumn("depth", F.lit(k)).write.mode("overwrite").parquet(self._at(k, "pages"))
            return True
        if k not in self._done("links"):
            pages = self.spark.read.parquet(self._at(k, "pages")).where("success")
            links = pages.select("url", F.explode(H.crawl_links_udf("url", "html")).alias("link")).withColumn("kind", U.link_kind(F.col("link"), self.domains)).where("kind IS NOT NULL")
            links.write.mode("overwrite").parquet(self._at(k, "links"))
            return True
        left = self.max_pages - self.pages().where("success").count()
        if left <= 0:
            return False
        if k and k % COMPACT == 0 and k not in finished_versions(self.spark, self.path, "seen="):
            self.seen().write.mode("overwrite").parquet(f"{self.path}/seen={k}")
        found = self.spark.read.parquet(self._at(k, "links")).select(F.col("link").alias("url"), F.lit(k + 1).alias("depth"), "kind").distinct()
        fresh = found.join(self.seen().select("url"), "url", "left_anti")
        if self.allowed is not None:
            fresh = fresh.join(self.allowed(fresh.select("url")).select("url").distinct(), "url", "left_semi")
        nearest = fresh.where("kind = 'page'").orderBy("url").limit(left).unionByName(fresh.where("kind = 'pdf'"))
        nearest.write.mode("overwrite").parquet(self._at(k + 1, "frontier"))
        return not self.spark.read.schema(FRONTIER).parquet(self._at(k + 1, "frontier")).isEmpty()

    def run(self, max_steps: int | None = None) -> DataFrame:
        """Go on until nothing is left, or for so many steps; returns what was found so far (url, depth, kind)."""
        steps = 0
        while max_steps is None or steps < max_steps:
            if not self.step():
                break
            steps += 1
        return self.seen()
