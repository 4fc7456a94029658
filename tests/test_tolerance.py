"""Near duplicates by tolerance against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import tolerance as TL


def brute(rows, tol):
    """rows of (block, value): sorted list of (block, low, high, n) of single-linkage groups."""
    out = {}
    for b, v in rows:
        odd = v is None or math.isnan(v) or math.isinf(v)
        out.setdefault((b, str(v) if odd else None), []).append(0.0 if odd else v)
    groups = []
    for (b, odd), vs in out.items():
        vs.sort()
        run = [vs[0]]
        for v in vs[1:]:
            if v - run[-1] > tol:
                groups.append((b, odd, run))
                run = []
            run.append(v)
        groups.append((b, odd, run))
    return sorted(((b, None, None, len(r)) if odd else (b, r[0], r[-1], len(r)) for b, odd, r in groups), key=repr)


@pytest.mark.parametrize("tol,scale,run", [(0.01, 2, 4), (0.5, 30, 2), (1e-7, 1e-5, 1024), (3.0, 500, 3)])
def test_groups_equal_brute_force(spark, monkeypatch, tol, scale, run):
    monkeypatch.setattr(TL, "RUN", run)  # short runs, so that chains cross several levels
    r = np.random.default_rng(int(1 / tol) % 97)
    vals = [float(v) for v in np.round(r.normal(0, scale, 700), 9)] + [tol * i for i in range(-40, 41)] + [100 * scale + 0.3 * tol * i for i in range(200)]
    rows = [(None if r.random() < 0.2 else int(r.integers(0, 3)), v) for v in vals] + [(1, -0.0), (1, 0.0)]
    rows += [(b, v) for b in (None, 1) for v in (None, float("nan"), float("inf"), float("inf"), -float("inf"))]
    df = spark.createDataFrame(rows, "b int, v double").repartition(5)
    got = sorted((tuple(x) for x in TL.tolerance_groups(df, "v", tol, ["b"]).collect()), key=repr)
    assert [(a, lo, hi, n) for a, lo, hi, n in got] == brute(rows, tol)
    assert TL.dedupe_tolerance(df, "v", tol, ["b"]).count() == len(got)


def test_rounding_would_part_them_and_whole_rows_stay(spark):
    df = spark.createDataFrame([(3, "b", 0.051), (1, "a", 0.049), (2, "a", 9.0), (4, None, None), (5, None, None)], "id int, name string, `a.v` double").withColumnRenamed("a.v", "v")
    got = sorted(tuple(r) for r in TL.dedupe_tolerance(df, "v", 0.002, [], ["id"], "n").collect())
    assert got == [(1, "a", 0.049, 2), (2, "a", 9.0, 1), (4, None, None, 2)]
    assert TL.dedupe_tolerance(df.limit(0), "v", 0.1).collect() == []


def test_dates_integers_and_refused_values(spark):
    df = spark.sql("SELECT explode(array(date'2024-01-01', date'2024-01-03', date'2024-01-06')) AS d")
    assert [r.n_rows for r in TL.tolerance_groups(df, "d", 2).orderBy("low").collect()] == [2, 1]
    n = spark.range(10_000).select((F.col("id") + F.when(F.col("id") >= 6000, 5).otherwise(0)).alias("k"))
    assert [(r.low, r.n_rows) for r in TL.tolerance_groups(n, "k", 1).orderBy("low").collect()] == [(0.0, 6000), (6005.0, 4000)]
    with pytest.raises(ValueError):
        TL.tolerance_groups(n, "k", 0)
    with pytest.raises(Exception, match="too large"):
        TL.tolerance_groups(spark.createDataFrame([(1e30,)], "v double"), "v", 0.1).collect()
