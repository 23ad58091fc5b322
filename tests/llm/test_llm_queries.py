import pytest

from lodevec.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_query_equals_its_sql_twin(name, same):
    same(llm.QUERIES[name], llm.SQL[name])


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - set(llm.SQL)))
def test_query_without_a_twin_runs(name, spark, sf):
    assert llm.QUERIES[name](spark, sf).count() >= 0
