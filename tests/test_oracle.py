"""Every registered query of the matrix engine against its SQL in DuckDB; the others run and keep their columns."""

import pytest

from matriq import plans
from tests.compare import rows

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_and_repeats(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    assert got.count() > 0
    assert len(set(got.columns)) == len(got.columns)
