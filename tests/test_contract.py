"""The driver contract: entry(), queries(), oracle_sql()."""

import __spark_entry__ as E


def test_entry_returns_ten_check_report(spark):
    df = E.entry(spark)
    assert df.columns == ["check_id", "check_name", "weight", "score", "violations", "severity", "passed"]
    rows = df.collect()
    assert len(rows) == 10
    assert abs(sum(r["weight"] for r in rows) - 1.0) < 1e-9


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 150


def test_query_names_are_unique_and_callable():
    for name, fn in E.queries().items():
        assert callable(fn), name
