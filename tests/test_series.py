"""Blocked recurrence against the plain loop, also where one series spans many partitions."""

import datetime as dt

import numpy as np
import pytest

from weft.operators import series as SR

SCHEMA = "id long, g string, t timestamp, e double"


def rows(n, groups):
    r = np.random.default_rng(4)
    at = dt.datetime(2024, 1, 1)
    return [(i, groups[i % len(groups)], at + dt.timedelta(seconds=int(r.integers(0, 10 ** 6))), float(r.standard_normal())) for i in range(n)]


@pytest.mark.parametrize("groups", [["a"], ["a", "b", None], ["a"] * 9 + ["b"], [f"g{k}" for k in range(70)]])
def test_equals_the_plain_recurrence(spark, groups):
    data = rows(400, groups)
    out = SR.linear_recurrence(spark.createDataFrame(data, SCHEMA).repartition(5), 0.9, "e", ["t", "id"], ["g"])
    got = {r.id: r.x for r in out.collect()}
    before, want = {}, {}
    for i, g, _, e in sorted(data, key=lambda r: (r[2], r[0])):
        before[g] = want[i] = 0.9 * before[g] + e if g in before else e
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-12


def test_series_has_its_variance_and_correlation(spark):
    df = spark.range(20000).selectExpr("id", "timestamp_seconds(id) as t", "if(id % 100 = 7, null, cast(id % 1000 as double)) as v")
    x = np.array([r.x for r in SR.ar1_series(df, 0.8, "t", ["id"], 3).orderBy("t").collect()])
    assert abs(x.std() - 1) < 0.1 and abs(np.corrcoef(x[1:], x[:-1])[0, 1] - 0.8) < 0.03
    out = SR.autoregress(df, 0.8, "t", ["id"], 3, ["v"]).orderBy("t").collect()
    v = np.array([np.nan if r.v is None else r.v for r in out])
    assert [r.id for r in out if r.v is None] == list(range(7, 20000, 100))
    assert sorted(v[~np.isnan(v)]) == sorted(float(i % 1000) for i in range(20000) if i % 100 != 7)
    w = v[~np.isnan(v)]
    assert abs(np.corrcoef(w[1:], w[:-1])[0, 1] - 0.8) < 0.06


def test_nulls_empty_tables_and_refusals(spark):
    df = spark.createDataFrame([(1, "a", None, 1.0), (2, "a", dt.datetime(2024, 1, 1), None)], SCHEMA)
    got = {r.id: r.x for r in SR.ar1_series(df, 0.5, "t", ["id"], 1, ["g"]).collect()}
    assert got[1] is None and got[2] is not None
    assert SR.ar1_series(df.limit(0), 0.5, "t", ["id"], 1).collect() == []
    with pytest.raises(ValueError):
        SR.ar1_series(df, 1.0, "t", ["id"], 1)
    with pytest.raises(ValueError):
        SR.linear_recurrence(df, 0.5, "e", ["t", "id"], out="e")
