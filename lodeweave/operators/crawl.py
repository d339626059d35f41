"""Crawling a link graph breadth first, by anti-joins of frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import urls as U
from lodeweave.session import written


def crawl(edges: DataFrame, seed: str, domains: list[str], max_pages: int = 6000, max_rounds: int = 1000) -> DataFrame:
    """(url, depth, kind) of pages and PDFs reachable over links (src, dst) from the seed; at most max_pages pages, nearest first, ties by url.

    PDFs are found but not followed.
    """
    spark = edges.sparkSession
    links = written(edges.select("src", U.normalised(F.col("dst")).alias("dst")).withColumn("kind", U.link_kind(F.col("dst"), domains)).where("kind IS NOT NULL").distinct(), "links")
    seen = written(spark.createDataFrame([(seed, 0, "page")], "url string, depth int, kind string"), "seen")
    frontier, pages = seen, 1
    for depth in range(1, max_rounds):
        if pages >= max_pages:
            break
        out = frontier.where("kind = 'page'").select(F.col("url").alias("src")).join(links, "src").select(F.col("dst").alias("url"), F.lit(depth).alias("depth"), "kind").distinct()
        fresh = out.join(seen.select("url"), "url", "left_anti")
        new_pages = fresh.where("kind = 'page'").orderBy("url").limit(max_pages - pages)
        frontier = written(new_pages.unionByName(fresh.where("kind = 'pdf'")), "frontier")
        if frontier.isEmpty():
            break
        pages += frontier.where("kind = 'page'").count()
        seen = seen.unionByName(frontier)
    return seen
