import pytest
from conftest import SF, same_rows

from lodeweave.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    mine, theirs = same_rows(catalogue.QUERIES[name](spark, SF), duck, catalogue.ORACLE_SQL[name])
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_runs(spark, name):
    catalogue.QUERIES[name](spark, SF).collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
