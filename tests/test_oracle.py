"""Every registered query against the same question asked in SQL, whole tables."""

import pytest
from compare import compare, connect

from __spark_entry__ import entry
from modsieve.plans import catalog

QUERIES, SQL = catalog.load()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, small, name):
    assert compare(spark, con, small, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 200 and "action" in df.columns
