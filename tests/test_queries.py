"""Every query beside its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tessera.registry import QUERIES, SQL  # noqa: E402


@pytest.fixture(scope="module")
def tables(sf):
    return oracle.connection(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, tables, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        assert oracle.compare(df, tables.sql(SQL[name])) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
