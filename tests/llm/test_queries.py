"""Registered queries against their SQL, on whole tables."""

import pytest
from compare import compare, connect

from __spark_entry__ import oracle_sql, queries
from modsieve.llm.queries import QUERIES, SQL


def test_registered():
    assert set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql())
    assert sum(name.startswith("op") for name in QUERIES) == 13 and "pipeline" in QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, small, name):
    assert compare(spark, connect(small), small, queries()[name], SQL[name]) is None
