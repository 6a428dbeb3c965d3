"""Every named query runs; those with SQL give exactly its rows."""

import pytest

import __spark_entry__ as entry_points
from tests.compare import difference
from tillcast.catalog import CHECKS, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, small, con):
    df = QUERIES[name](spark, small)
    if name in CHECKS:
        assert difference(df, con, CHECKS[name]) is None
    else:
        rows = df.collect()
        assert rows and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    rows = {r["model"]: r for r in entry_points.entry(spark).collect()}
    assert set(rows) == {"gbt", "seasonal_naive"}
    assert rows["gbt"]["n"] == rows["seasonal_naive"]["n"] == 300


def test_every_check_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
