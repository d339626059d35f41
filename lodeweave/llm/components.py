"""Connected components of links between numbered nodes, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.shared import written


def _with_least(pairs: DataFrame, name: str) -> DataFrame:
    """(u, v) pairs plus the least v of each u; summed up before the shuffle, joined back so that hot nodes can be split."""
    least = pairs.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias(name))
    return pairs.join(least, F.col("u") == F.col("_u")).drop("_u")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of `links` (a, b longs): the least node that can be reached.

    Large stars and small stars in turn: every node's larger, then smaller neighbours are tied to its least
    one, until nothing changes. Links of a node to itself and null ends take no part.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, "m").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        tied = _with_least(large, "m")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
