import pytest

from tessella.llm import queries

from ..oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, connect(SF), SF, queries.QUERIES[name], queries.ORACLES[name])


