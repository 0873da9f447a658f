import __spark_entry__ as e


def test_every_check_query_belongs_to_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 150


def test_flagship(spark):
    df = e.entry(spark)
    assert df.columns[0] == "n_queries" and df.first().n_queries > 0
