"""Tables laid out for their key: rows in buckets by its hash, sorted inside, so that joins and groupings by the key need no shuffle of them.

The layout is in the files' names; a session gets to know a table by its path, for as long as it takes to plan it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodeweave.session import finished_versions, remove


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write a new table, a file for each bucket; a folder that an unfinished run left is written anew."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    remove(spark, path)
    try:
        df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay


def read_bucketed(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    name = f"bucketed_{uuid.uuid4().hex}"
    try:
        spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
        rows = spark.table(name)
        rows.schema  # noqa: B018  (resolves the table while it is known)
        return rows
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


class Versions:
    """Folders <path>/v0, v1, ... of which the largest finished one holds: the base, and beside it additions <path>/v0.1, v0.2, ..., each whole or not there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def base(self) -> int | None:
        done = finished_versions(self.spark, self.path, "v")
        return done[-1] if done else None

    def additions(self) -> list[str]:
        base = self.base()
        return [] if base is None else [f"{self.path}/v{base}.{k}" for k in finished_versions(self.spark, self.path, f"v{base}.")]

    def next_base(self) -> str:
        base = self.base()
        return f"{self.path}/v{0 if base is None else base + 1}"

    def next_addition(self) -> str:
        base = self.base()
        done = finished_versions(self.spark, self.path, f"v{base}.")
        return f"{self.path}/v{base}.{done[-1] + 1 if done else 1}"
