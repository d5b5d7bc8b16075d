"""All core queries: against their SQL where there is one, else that they give rows of a stable schema."""

import pytest

from strandloom.plans import catalog, core_problems


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.SQL and n not in core_problems.QUERIES])
def test_same_as_sql(spark, small, same_as_sql, name):
    same_as_sql(spark, small, catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.SQL])
def test_runs(spark, small, name):
    df = catalog.QUERIES[name](spark, small)
    assert df.columns and df.count() > 0


def test_entry(spark, small):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
