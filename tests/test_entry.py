import __spark_entry__ as entry


def test_queries_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "expand_orders_depth3" in entry.queries()
