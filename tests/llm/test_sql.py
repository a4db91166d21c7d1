import pytest

from sparvane.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, agree, name):
    agree(queries.QUERIES[name](spark, DATA), queries.SQL[name])
