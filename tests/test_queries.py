import pytest

from quillspark.plans import queries as q


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n in q.ORACLES])
def test_query_matches_its_sql(name, compare):
    compare(q.QUERIES[name], q.ORACLES[name])


def test_entry_imports_without_the_training_data_operators(spark):
    import __spark_entry__ as e

    assert set(q.QUERIES) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
