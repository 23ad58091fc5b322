import pytest

from lodevec import queries as core


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_its_sql_twin(name, same):
    same(core.QUERIES[name], core.SQL[name])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_query_without_a_twin_runs(name, spark, sf):
    assert core.QUERIES[name](spark, sf).count() >= 0


def test_core_stands_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['lodevec.llm'] = None; import __spark_entry__ as e; assert e.queries().keys() >= {'p4_found'}; assert not any(k.startswith('p1_') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["qid", "rank", "id", "dist"]
