"""The registered queries that SQL can express against DuckDB."""

import oracle
import pytest

queries = pytest.importorskip("tidewatch.llm.queries")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    assert oracle.differences(queries.QUERIES[name](spark, sf), oracle.connect(sf), queries.ORACLE_SQL[name]) == ""
