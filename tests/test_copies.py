"""Unique rules, null foreign keys and shuffles over repeated rows, maps and signed zeros."""

import math
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.operators import constraints as C
from weft.operators import copies as CP
from weft.operators import dirty as D
from weft.plans.spec import Rule


@settings(max_examples=8, deadline=None)
@given(rows=st.lists(st.tuples(st.sampled_from([None, 1, 2, 3]), st.sampled_from([None, "a", "b"]), st.sampled_from([None, 0.5, 1.5])), max_size=25))
def test_marks_against_a_sort(spark, rows):
    df = spark.createDataFrame(rows, "k long, s string, x double")
    got = Counter(map(tuple, C.mark_repeats(df, ["k"], df.columns, "again").collect()))
    want, seen = Counter(), set()
    for k, s, x in sorted(rows, key=lambda r: [(v is not None, v) for v in r]):  # nulls first
        want[k, s, x, k is not None and k in seen] += 1
        seen.add(k)
    assert got == want


def test_copies_beyond_a_run(spark, monkeypatch):
    monkeypatch.setattr(CP, "RUN", 7)
    df = spark.range(50).select(F.lit(1).alias("k"), F.when(F.col("id") < 3, 5).otherwise(9).alias("v"))
    got = Counter(map(tuple, C.mark_repeats(df, ["k"], df.columns, "again").collect()))
    assert got == Counter({(1, 5, False): 1, (1, 5, True): 2, (1, 9, True): 47})
    assert sorted(r["v"] for r in C.enforce(df, [Rule("u", "unique", ("k",), "reject")]).collect()) == [5]


def test_maps_signed_zeros_and_microseconds(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, map('a', 1), -0.0D, timestamp'2024-01-01 00:00:00.000001'), (1, map('a', 1), 0.0D, timestamp'2024-01-01 00:00:00.000001'),
        (2, map('b', 2), -0.0D, timestamp'2024-01-01 00:00:00.000001'), (2, map('b', 2), -0.0D, timestamp'2024-01-01 00:00:00.000002'), (3, null, null, null) AS t(k, m, x, ts)""")
    rows = C.mark_repeats(df, ["k"], df.columns, "again").collect()
    assert Counter(r["k"] for r in rows if r["again"]) == {1: 1, 2: 1} and len(rows) == 5
    assert Counter((r["k"], math.copysign(1, r["x"])) for r in rows if r["x"] is not None) == {(1, -1.0): 1, (1, 1.0): 1, (2, -1.0): 2}
    assert [r["ts"].microsecond for r in rows if r["k"] == 2 and not r["again"]] == [1]
    assert len(D.shuffle_rows(df, 3).collect()) == 5


def test_float_keys(spark):
    df = spark.createDataFrame([(math.nan, 1), (math.nan, 2), (0.0, 1), (-0.0, 2), (None, 1), (None, 1)], "k double, v int")
    assert sorted((str(abs(r["k"])), r["v"]) for r in C.rule_unique(df, ["k"]).collect()) == [("0.0", 2), ("nan", 2)]


def test_null_foreign_keys_are_spread_and_hold(spark):
    child = spark.range(0, 400, 1, 8).select("id", F.when(F.col("id") % 4 == 0, F.col("id") % 40).alias("f"))
    parent = spark.createDataFrame([(k,) for k in range(0, 40, 8)] + [(None,)], "p long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        marked, [(_, name)] = C.with_violations(child, [Rule("r", "referential", ("f",), "flag", ref_table="p", ref_column="p")], {"p": parent})
        plan = marked._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(f" in plan and "_spread" in plan.split("hashpartitioning(f")[1].split(")")[0]
        got = {r["id"]: r[name] for r in marked.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert marked.columns == ["id", "f", name]
    assert got == {i: i % 4 == 0 and i % 40 % 8 != 0 for i in range(400)}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k long, s string")
    assert C.mark_repeats(df, ["k"], df.columns, "again").collect() == []
    assert D.shuffle_rows(df, 1).collect() == [] and D.shuffle_rows(df, 1, position="at").columns == ["k", "s", "at"]
    only = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    assert sorted(map(str, C.rule_unique(only, ["k"]).collect())) == ["Row(k=1)"]
