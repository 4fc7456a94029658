"""Fitted distributions: planted families are found, EM equals numpy's, twins keep the distributions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import fitting as FT
from weft.operators import report as RP

N = 12_000


@pytest.fixture(scope="module")
def planted(spark):
    r = np.random.default_rng(5)
    cols = {
        "normal": r.normal(50, 7, N), "lognormal": r.lognormal(3, 0.6, N), "exponential": r.exponential(20, N), "uniform": r.uniform(-5, 9, N),
        "gamma": r.gamma(2.7, 3.0, N), "poisson": r.poisson(6.5, N).astype(float), "mixture": np.where(r.random(N) < 0.3, r.normal(-10, 1, N), r.normal(8, 2, N)),
        "empirical": r.choice([0.0, 0.25, 0.5, 4.0], N, p=[0.5, 0.2, 0.2, 0.1])}
    rows = [[i] + [float(v[i]) for v in cols.values()] for i in range(N)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols)).repartition(4), cols


@pytest.fixture(scope="module")
def fits(planted):
    return FT.fit_columns(planted[0], list(planted[1]))


def test_planted_families_are_found(planted, fits):
    cols = planted[1]
    assert {c: f.family for c, f in fits.items()} == {c: c for c in cols}
    assert fits["normal"].params == pytest.approx((50, 7), rel=0.02) and fits["gamma"].params == pytest.approx((2.7, 3.0), rel=0.05)
    assert fits["poisson"].params == pytest.approx((6.5,), rel=0.02) and fits["lognormal"].params == pytest.approx((3, 0.6), rel=0.02)
    w, m, s = zip(*sorted(fits["mixture"].params, key=lambda p: p[1]))
    assert (w[0], m[0], s[0], m[1], s[1]) == pytest.approx((0.3, -10, 1, 8, 2), rel=0.05)
    assert len(fits["mixture"].params) == 2


def test_the_twin_keeps_every_distribution(planted, fits):
    df, cols = planted
    twin = FT.fitted_twin(df, 2 * N, 7, ["id"], fits).persist()
    assert twin.columns == df.columns and twin.select("id").distinct().count() == 2 * N
    ks = {c: RP.ks_statistic(df, twin, c).first()[-1] for c in cols}
    assert max(ks.values()) < 0.03, ks
    twin.unpersist()


def test_likelihoods_and_log_factorial_against_plain_sums(spark):
    x = [1.0, 2.0, 2.0, 5.0, 9.0, 14.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = FT.likelihoods(FT.summaries(df, ["x"])[1]["x"])
    m, s = np.mean(x), np.std(x)
    assert got["normal"][1] == pytest.approx(sum(-0.5 * math.log(2 * math.pi * s * s) - (v - m) ** 2 / (2 * s * s) for v in x))
    lm, ls = np.mean(np.log(x)), np.std(np.log(x))
    assert got["lognormal"][1] == pytest.approx(sum(-math.log(v) - 0.5 * math.log(2 * math.pi * ls * ls) - (math.log(v) - lm) ** 2 / (2 * ls * ls) for v in x))
    assert got["poisson"][1] == pytest.approx(sum(v * math.log(m) - m - math.lgamma(v + 1) for v in x))
    k, t = got["gamma"][0]
    at = lambda k, t: sum((k - 1) * math.log(v) - v / t - k * math.log(t) - math.lgamma(k) for v in x)
    assert got["gamma"][1] == pytest.approx(at(k, t)) and at(k, t) >= max(at(k * 1.01, t), at(k * 0.99, t), at(k, t * 1.01))
    assert got["exponential"][1] == pytest.approx(-6 * (math.log(m) + 1)) and got["uniform"][1] == pytest.approx(-6 * math.log(14))
    big = spark.range(0, 300, 7).select(F.col("id").cast("double").alias("x"), FT.log_factorial(F.col("id").cast("double")).alias("f")).collect()
    assert all(r.f == pytest.approx(math.lgamma(r.x + 1), rel=1e-11, abs=1e-11) for r in big)


def test_em_equals_numpy(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 1, 300), r.normal(6, 0.5, 200), r.normal(11, 2, 100)])
    start = [(1 / 3, 0.0, 2.0), (1 / 3, 5.0, 2.0), (1 / 3, 10.0, 2.0)]
    (got, ll, rounds), = FT.mixtures(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double"), {"a": ("x", start)}, max_rounds=15, tolerance=0).values()
    w, m, s = (np.array(v) for v in zip(*start))
    for _ in range(rounds):
        d = w * np.exp(-((x[:, None] - m) ** 2) / (2 * s * s)) / (s * math.sqrt(2 * math.pi))
        want, have = (w, m, s), np.log(d.sum(1)).sum()
        g = d / d.sum(1, keepdims=True)
        w, m = g.mean(0), (g * x[:, None]).sum(0) / g.sum(0)
        s = np.sqrt((g * (x[:, None] - m) ** 2).sum(0) / g.sum(0))
    assert rounds == 15 and ll == pytest.approx(have) and np.allclose(np.array(got).T, want)


def test_distribution_functions(planted):
    _, cols = planted
    for c, p in (("gamma", (2.7, 3.0)), ("poisson", (6.5,)), ("normal", (50, 7)), ("exponential", (20,)), ("uniform", (-5, 9)), ("lognormal", (3, 0.6))):
        at = np.quantile(cols[c], [0.05, 0.3, 0.5, 0.9, 0.999])
        at = np.floor(at) if c == "poisson" else at
        assert np.allclose(FT.distribution(c, p, at), [(cols[c] <= v).mean() for v in at], atol=0.015), c
    assert np.allclose(FT._gamma_p(6000.0, np.array([5900.0, 6000.0, 6200.0])), FT._gamma_p(4999.9999, np.array([4900.0, 5000.0, 5200.0])), atol=0.03)
    assert FT._gamma_p(0.5, np.array([0.0, 1e9]))[[0, 1]].tolist() == [0.0, 1.0]


def test_nulls_constants_whole_numbers_and_empty_tables(spark):
    rows = [(i, None, 4.0, None if i % 4 == 0 else i % 50 + 1, float("nan") if i % 2 else float("inf"), f"k{i % 3}") for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, none double, one double, w int, odd double, kind string")
    fits = FT.fit_columns(df, ["none", "one", "w", "odd"])
    assert [f.family for f in fits.values()] == ["empty", "constant", "uniform", "empty"]
    assert fits["w"].null_share == 0.25 and fits["w"].params == (0.5 + fits["w"].low - 1, fits["w"].high + 0.5)
    twin = FT.fitted_twin(df, 4000, 3, ["id"], fits)
    a = twin.agg(F.count("none"), F.min("one"), F.max("one"), F.min("w"), F.max("w"), F.count("w"), F.count_distinct("kind"), F.count_distinct("w")).first()
    assert a[:5] == (0, 4.0, 4.0, fits["w"].low, fits["w"].high) and abs(a[5] - 3000) < 150 and a[6:] == (3, df.select("w").distinct().count() - 1)
    assert FT.fitted_twin(df.limit(0), 10, 3, ["id"]).collect() == [] and FT.fit_columns(df.select("kind")) == {}
    assert [r.family for r in FT.fit_table(fits, spark).collect()] == ["empty", "constant", "uniform", "empty"]
