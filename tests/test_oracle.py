import pytest
from oracle import compare

from quillspark import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, sf_dir, name):
    compare(QUERIES[name](spark, sf_dir), SQL[name], sf_dir)


#: Approximate results: their recall has a query with SQL of its own.
WITHOUT_SQL = {"vector_index_topk"}


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) | WITHOUT_SQL


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
