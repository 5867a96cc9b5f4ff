"""Every query with SQL beside it gives the same rows in both engines."""

import pytest

from rasterloom.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
CORE = sorted(SQL)


@pytest.mark.parametrize("key", CORE)
def test_same_rows(spark, duck, key):
    a = QUERIES[key](spark, SF).toPandas()
    b = duck.sql(SQL[key]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert len(a)
    rows = lambda d: sorted(map(repr, d[cols].astype(object).values.tolist()))
    assert rows(a) == rows(b)


def test_registry():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 170


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["x", "y", "r", "g", "b", "a"]
    assert set(e.oracle_sql()) <= set(e.queries())
