import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def same_rows(df, con, sql):
    """Rows of a DataFrame and of its SQL twin, as comparable sorted lists."""

    def clean(v):
        if isinstance(v, float):
            return round(v, 6)
        return v if v is None or isinstance(v, (bool, int, str)) else str(v)

    rel = con.sql(sql)
    place = [rel.columns.index(c) for c in df.columns]
    assert sorted(rel.columns) == sorted(df.columns)
    mine = sorted(([clean(v) for v in r] for r in df.collect()), key=repr)
    theirs = sorted(([clean(r[i]) for i in place] for r in rel.fetchall()), key=repr)
    return mine, theirs
