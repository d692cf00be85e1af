import pytest
from conftest import SF, same_rows

from siftlog.plans import file_queries
from siftlog.plans.queries import QUERIES, SQL, entry

assert file_queries.QUERIES is QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 10


def test_driver_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
