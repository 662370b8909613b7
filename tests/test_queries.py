"""Every registered query runs; those with SQL give the same rows in DuckDB."""

import pytest
from compare import connect, same_rows
from lodestore.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_match_sql(name, spark, small, con):
    same_rows(QUERIES[name](spark, small), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(name, spark, small):
    df = QUERIES[name](spark, small)
    assert df.columns
    df.count()
