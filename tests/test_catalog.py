import pytest
from helpers import duckdb_rows, spark_rows

from tallyline.plans import queries

@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    assert spark_rows(queries.QUERIES[name](spark, sf)) == duckdb_rows(sf, queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_has_rows(spark, sf, name):
    """Their values are held by the tests of their operators; the yearly folds need a thousand rows, which the smallest tables lack."""
    assert queries.QUERIES[name](spark, sf.replace("sf0.001", "sf0.01") if name == "b04_walk_forward" else sf).count() > 0
