"""Every registered analytics query against DuckDB, on the smallest tables."""

import oracle
import pytest
from tidewatch import catalog


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, sf, con, name):
    assert oracle.differences(catalog.QUERIES[name](spark, sf), con, catalog.ORACLE_SQL[name]) == ""


def test_queries_without_sql_have_rows(spark, sf):
    for name in catalog.QUERIES.keys() - catalog.ORACLE_SQL.keys():
        assert catalog.QUERIES[name](spark, sf).count() > 0, name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert catalog.QUERIES.keys() <= entry.queries().keys()
