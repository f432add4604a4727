import pytest

from kindred.llm import queries

from ..oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    assert_same(spark, connect(sf), queries.QUERIES[name], queries.ORACLE_SQL[name], sf)
