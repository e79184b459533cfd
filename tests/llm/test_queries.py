import pytest

from ratelake.llm import queries

from ..sql_check import same


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    got, want = same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])
    assert got == want
