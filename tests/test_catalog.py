import pytest

from passagemesh.plans import catalog
from tests.oracle import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf, name):
    cols, rows = spark_rows(catalog.QUERIES[name](spark, sf))
    assert rows == duck_rows(catalog.SQL[name], sf, cols)


def test_entry(spark):
    import __spark_entry__ as e

    assert {"i2_query_traversal", "e3_intra_document"} <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
