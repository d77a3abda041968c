"""Every query of the library proper against its SQL, or its schema alone where SQL cannot express it."""

import pytest
from compare import duck_rows, spark_rows

from corpusmill.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, name):
    assert spark_rows(QUERIES[name](spark, sf)) == duck_rows(SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
