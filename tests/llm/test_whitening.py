import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import feast
from weft.llm import whitening as W
from weft.llm.queries import QUERIES

SF_SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=32, scale=64, offset=1_000_000):
    """{vec_id: [deviation, whitened...]}, explained, with numpy's own eigensolver."""
    ok = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = [[math.floor(scale * float(np.float32(c))) + offset for c in v] for _, v in ok]
    n, s = len(x), [sum(c) for c in zip(*x)]
    y = np.array([[(n * a - b) / n for a, b in zip(r, s)] for r in x])
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(k, int((e > 1e-10 * e.sum()).sum()))
    dev = [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    return [(i, d, w) for (i, _), d, w in zip(ok, dev, y @ q[:, :k] / np.sqrt(e[:k]))], e[:k] / e.sum(), n


def check(df, rows, k=32):
    want, share, n = brute(rows, k)
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, []).append(r)
    assert sorted(got, key=repr) == sorted({i for i, _, _ in want}, key=repr)
    once = {i: (d, w) for i, d, w in want}
    comp = {i: sorted(rs, key=lambda r: r.component)[:: len(rs) // len(share)] for i, rs in got.items()}
    assert all([r.component for r in rs] == list(range(1, len(share) + 1)) for rs in comp.values())
    flat = [r for rs in comp.values() for r in rs]
    assert {r.n for r in flat} == {n}
    assert max(r.identity_error for r in flat) <= 1e-9
    mine = np.array([[r.whitened for r in comp[i]] for i in comp])
    theirs = np.array([once[i][1] for i in comp])
    sign = np.sign((mine * theirs).sum(axis=0))
    assert np.abs(mine - sign * theirs).max() < 1e-7
    for i, rs in comp.items():
        assert {int(r.deviation) for r in rs} == {once[i][0]}
        assert np.allclose([r.explained for r in rs], share, rtol=1e-6)


def test_query_equals_brute_force(spark):
    rows = duckdb.sql(f"select vec_id, embedding from read_parquet('{SF_SMALL}/embeddings.parquet')").fetchall()
    df = QUERIES["op13_whitening"](spark, SF_SMALL)
    assert dict(df.dtypes)["deviation"] == "bigint"
    check(df, rows)


def test_messy_rows(spark):
    r = np.random.default_rng(3)
    rows = [(k, r.standard_normal(6).tolist(), 1) for k in range(40)]
    rows += [(100, None, 1), (101, [], 1), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (103, [float("nan")] * 6, None), (104, [float("inf")] * 6, 1),
             (None, r.standard_normal(6).tolist(), None), (5, rows[5][1], 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    check(W.whitened(df), [x[:2] for x in rows])
    check(W.whitened(df, components=3), [x[:2] for x in rows], 3)
    names = ["id", "v", "n", "component", "whitened", "deviation", "dim", "at", "g"]
    check(W.whitened(df.select("*", *[F.lit("x").alias(c) for c in names])), [x[:2] for x in rows])
    ragged = df.unionByName(spark.createDataFrame([(900 + k, [1.0 * k, 2.0], 1) for k in range(5)], SCHEMA))
    check(W.whitened(ragged), [x[:2] for x in rows])


def test_low_ranks_and_empty_tables(spark):
    assert W.whitened(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, None, 1)], SCHEMA)
    assert W.whitened(one).collect() == []
    line = [(k, [float(k), 2.0 * k, 0.0], 1) for k in range(9)]
    check(W.whitened(spark.createDataFrame(line, SCHEMA)), [x[:2] for x in line])
    with pytest.raises(Exception, match="62 bits"):
        W.whitened(spark.createDataFrame([(1, [1e30, 0.0], 1)], SCHEMA)).collect()


@pytest.mark.parametrize("high", [1 << 10, 1 << 40])
def test_deviations_are_exact(high):
    r = np.random.default_rng(8)
    x = r.integers(-high, high, (50, 7))
    sums = [int(v) + 3 for v in x.sum(axis=0)]
    for n in (50, 10 ** 11):
        want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
        assert W.deviations(x, n, sums) == want


def spectra():
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((40, 40)))[0]
    return {"geometric": 2.0 ** -np.arange(40), "steep": 10.0 ** -np.arange(40.0), "equal": np.ones(40), "two values": np.r_[np.ones(25), np.full(15, .5)],
            "close": 1 + 1e-9 * np.arange(40)[::-1], "spike": np.r_[1e6, np.ones(39)], "low rank": np.r_[np.arange(9, 0, -1.0), np.zeros(31)], "none": np.zeros(40)}, q


@pytest.mark.parametrize("name", spectra()[0])
def test_leading_pairs_of_known_spectra(name):
    e, q = spectra()
    want, v = e[name], (q * e[name]) @ q.T
    got, u = feast.leading_pairs((v + v.T) / 2, 12)
    n = len(got)
    assert n == min(12, int((want > 1e-11 * want.sum()).sum())) or name == "steep" and n >= 10
    assert np.allclose(got, want[:n], atol=1e-12 * max(want.sum(), 1)) and np.allclose(u.T @ u, np.eye(n), atol=1e-10)
    assert np.abs(v @ u - u * got).max(initial=0) <= 1e-11 * max(want.sum(), 1)


def test_inertia_counts():
    r = np.random.default_rng(6)
    for _ in range(100):
        d = int(r.integers(1, 30))
        a = r.standard_normal((d, d))
        a = a + a.T if r.random() < .7 else np.round(a + a.T)
        assert feast.negatives(a) == int((np.linalg.eigvalsh(a) < 0).sum())
