import __spark_entry__ as E


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 85


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"date", "topic", "value"}
    assert df.count() > 0
