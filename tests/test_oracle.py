"""Every core query with SQL gives the same rows in both engines."""

import pytest
from oracle import connect, rows_of, rows_of_sql

from litmill.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, duck, name):
    columns, got = rows_of(registry.queries()[name](spark, sf))
    assert got == rows_of_sql(duck, SQL[name], columns)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL) - {"bridges"}))
def test_runs(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    assert df.columns and df.count() >= 0
