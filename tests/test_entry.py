"""The driver contract."""

import __spark_entry__ as entry


def test_names_and_flagship(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50
    assert entry.entry(spark).count() == 500
