import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q)
    assert len(q) >= 40
