"""Every registered query of the engine against DuckDB, and the entry point."""

import pytest

import __spark_entry__
from quarry.plans import catalog

from .oracle import assert_same, duck


catalog.queries()


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, sf, name):
    assert_same(catalog.QUERIES[name](spark, sf), catalog.SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["n", "missed", "accuracy"] and df.count() == 1


def test_sql_has_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_duck_reads_tables(sf):
    assert duck("SELECT count(*) FROM region", sf)[1] == [(5,)]
