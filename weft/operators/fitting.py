"""Choosing a distribution for every numeric column, and a twin table drawn from the choices.

One aggregate over the table gives counts, extremes, moments, log-moments and quantiles of all columns;
every family's maximum likelihood follows from those alone. The family with the least BIC is kept if its
distribution function passes close to the quantiles; otherwise normal mixtures of two components, then of
more, are fitted by EM (one aggregate a round for all such columns together), and last the quantiles themselves are the model.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import rand as R
from weft.operators import scale as SC

POINTS = 399  # quantiles kept of a column; they bound the distance of an empirical draw
ACCURACY = 4_000  # of the quantile sketch: rank error 1 / ACCURACY
MAX_DISTANCE = 0.03
NOISE = 1.63  # over the root of n: what a sample of the right family exceeds one time in a hundred
LN_2PI = math.log(2 * math.pi)
#: fewest parameters first, so that equal scores take the plainer family
FAMILIES = ("poisson", "exponential", "uniform", "normal", "lognormal", "gamma")


@dataclass(frozen=True)
class Fit:
    """A column's model. ``params`` by family: normal (mean, std), lognormal (mean and std of the logarithm), exponential (scale,),
    uniform (low, high), gamma (shape, scale), poisson (mean,), mixture ((weight, mean, std), ..), empirical (quantiles)."""

    family: str
    params: tuple
    distance: float
    bic: float
    n: int
    null_share: float
    low: float
    high: float
    whole: bool
    scores: dict = field(default_factory=dict)


def _values(df: DataFrame, c: str) -> Column:
    """The column as a double; NaN and infinite values count as missing."""
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def log_factorial(x: Column) -> Column:
    """ln(x!) for x >= 0 by Stirling's series, shifted by 8 (error below 1e-11)."""
    z = x + F.lit(8.0)
    low = x + F.lit(1.0)
    for k in range(2, 8):
        low = low * (x + F.lit(float(k)))
    return (z - F.lit(0.5)) * F.log(z) - z + F.lit(0.5 * LN_2PI) + F.lit(1 / 12) / z - F.lit(1 / 360) / F.pow(z, F.lit(3.0)) + F.lit(1 / 1260) / F.pow(z, F.lit(5.0)) - F.lit(1 / 1680) / F.pow(z, F.lit(7.0)) - F.log(low)


def summaries(df: DataFrame, cols: list[str], points: int = POINTS) -> tuple[int, dict[str, dict]]:
    """(rows, per column: n, mean, var, low, high, log-moments, whole, quantiles) from one map-side combined aggregate."""
    probs = [(i + 0.5) / points for i in range(points)]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        x = _values(df, c)
        lx = F.when(x > 0, F.log(x))
        parts = {"n": F.count(x), "mean": F.avg(x), "var": F.var_pop(x), "low": F.min(x), "high": F.max(x), "lmean": F.avg(lx), "lvar": F.var_pop(lx), "odd": F.count_if(x != F.floor(x)),
                 "lfact": F.avg(F.when(x >= 0, log_factorial(x))), "q": F.percentile_approx(x, probs, ACCURACY)}
        aggs += [v.alias(f"{k}{i}") for k, v in parts.items()]
    row = df.agg(*aggs).first()
    names = ("n", "mean", "var", "low", "high", "lmean", "lvar", "odd", "lfact", "q")
    return row["rows"], {c: {k: row[f"{k}{i}"] for k in names} for i, c in enumerate(cols)}


def _digamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    return out + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def gamma_shape(gap: float) -> float:
    """The shape k with ln k - digamma(k) = gap (> 0), by bisection on the logarithm of k: the left side falls in k."""
    lo, hi = 1e-6, 1e12
    for _ in range(200):
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if math.log(mid) - _digamma(mid) > gap else (lo, mid)
    return math.sqrt(lo * hi)


def likelihoods(s: dict) -> dict[str, tuple[tuple, float]]:
    """{family: (parameters, log-likelihood)} of every family that a column's summary allows.

    Whole-number columns are read as rounded draws, so densities stand for cells of width 1 and compare with Poisson's
    probabilities. A constant column has no density.
    """
    n, mean, var, low, high = s["n"], s["mean"], s["var"], s["low"], s["high"]
    if not n or low == high:
        return {}
    whole, std = s["odd"] == 0, math.sqrt(var)
    span = high - low + (1 if whole else 0)
    out = {"uniform": ((low - 0.5, high + 0.5) if whole else (low, high), -n * math.log(span)),
           "normal": ((mean, std), -n / 2 * (LN_2PI + math.log(var) + 1))}
    if low >= 0:
        out["exponential"] = ((mean,), -n * (math.log(mean) + 1))
        if whole and mean <= 10_000_000:
            out["poisson"] = ((mean,), n * (mean * math.log(mean) - mean - s["lfact"]))
    if low > 0 and s["lvar"] > 0:
        out["lognormal"] = ((s["lmean"], math.sqrt(s["lvar"])), -n / 2 * (LN_2PI + math.log(s["lvar"]) + 1) - n * s["lmean"])
        gap = math.log(mean) - s["lmean"]
        if gap > 1e-12:
            k = gamma_shape(gap)
            out["gamma"] = ((k, mean / k), n * ((k - 1) * s["lmean"] - k - k * math.log(mean / k) - math.lgamma(k)))
    return out


def _gamma_p(k: float, x: np.ndarray) -> np.ndarray:
    """The gamma distribution function: its series of positive terms, or the cube-root normal form for shapes where that is long."""
    x = np.maximum(np.asarray(x, dtype=float), 0)
    if k > 5_000:
        return _phi(((x / k) ** (1 / 3) - (1 - 1 / (9 * k))) * 3 * math.sqrt(k))
    far = x > k + 40 * math.sqrt(k) + 40
    y = np.where(far | (x == 0), 1.0, x)
    term, total, i = np.ones_like(y), np.ones_like(y), 0
    while i < 100_000 and (term > 1e-15 * total).any():
        i += 1
        term = term * y / (k + i)
        total = total + term
    p = np.exp(k * np.log(y) - y - math.lgamma(k + 1) + np.log(total))
    return np.where(x == 0, 0.0, np.where(far, 1.0, np.minimum(p, 1.0)))


def _phi(z) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in np.ravel(z)])


def distribution(family: str, p: tuple, x: np.ndarray) -> np.ndarray:
    """The family's distribution function at ``x``."""
    x = np.asarray(x, dtype=float)
    if family == "uniform":
        return np.clip((x - p[0]) / (p[1] - p[0]), 0, 1)
    if family == "normal":
        return _phi((x - p[0]) / p[1])
    if family == "lognormal":
        return np.where(x > 0, _phi((np.log(np.maximum(x, 1e-300)) - p[0]) / p[1]), 0.0)
    if family == "exponential":
        return 1 - np.exp(-np.maximum(x, 0) / p[0])
    if family == "gamma":
        return _gamma_p(p[0], x / p[1])
    if family == "poisson":
        return np.array([0.0 if v < 0 else float(1 - _gamma_p(math.floor(v) + 1, np.array([p[0]]))[0]) for v in x])
    return sum(w * _phi((x - m) / s) for w, m, s in p)


def distance(family: str, p: tuple, quantiles, whole: bool) -> float:
    """Largest distance of the model from the quantiles, in probability. A drawn whole number covers the cell around it."""
    q, ranks = np.array(quantiles), (np.arange(len(quantiles)) + 0.5) / len(quantiles)
    if family == "poisson":
        below, upto = distribution(family, p, q - 1), distribution(family, p, q)
    else:
        below, upto = (distribution(family, p, q - 0.5), distribution(family, p, q + 0.5)) if whole else 2 * (distribution(family, p, q),)
    return float(np.maximum(np.maximum(ranks - upto, below - ranks), 0).max())


def mixtures(df: DataFrame, starts: dict, max_rounds: int = 60, tolerance: float = 1e-6) -> dict:
    """Normal mixtures by EM. ``starts`` {name: (column, [(weight, mean, std), ..])} -> {name: (components, log-likelihood, rounds)}.

    A round is one aggregate over all columns and all mixtures that still move (weights, means and spreads about the round's own
    means). A mixture stops when the mean log-likelihood rises by less than ``tolerance``, or after ``max_rounds``.
    Standard deviations stay above a thousandth of the widest one, so that no component closes in on a single value.
    """
    now = {k: (c, [tuple(map(float, x)) for x in comps]) for k, (c, comps) in starts.items()}
    done, last = {}, {k: -math.inf for k in starts}
    least = {k: max(s for _, _, s in comps) / 1000 for k, (_, comps) in now.items()}
    rounds = 0
    while now:
        rounds += 1
        sel, aggs, at = [], [], {}
        for i, (k, (c, comps)) in enumerate(now.items()):
            x = _values(df, c)
            logs = [F.lit(math.log(w) - math.log(s) - LN_2PI / 2) - F.pow((x - F.lit(m)) / F.lit(s), F.lit(2.0)) / 2 for w, m, s in comps]
            sel += [x.alias(f"x{i}"), F.array(*logs).alias(f"l{i}")]
        work = df.select(*sel)
        tops = []
        for i, (k, (c, comps)) in enumerate(now.items()):
            total = None
            for j in range(len(comps)):
                e = F.exp(F.col(f"l{i}")[j] - F.col(f"t{i}"))
                total = e if total is None else total + e
            tops.append((f"t{i}", F.array_max(f"l{i}"), f"d{i}", total))
        work = work.withColumns({t: top for t, top, _, _ in tops}).withColumns({d: total for _, _, d, total in tops})
        for i, (k, (c, comps)) in enumerate(now.items()):
            aggs += [F.sum(F.col(f"t{i}") + F.log(f"d{i}")).alias(f"ll{i}"), F.count(f"x{i}").alias(f"n{i}")]
            for j, (_, m, _) in enumerate(comps):
                r, off = F.exp(F.col(f"l{i}")[j] - F.col(f"t{i}")) / F.col(f"d{i}"), F.col(f"x{i}") - F.lit(m)
                aggs += [F.sum(r).alias(f"r{i}_{j}"), F.sum(r * off).alias(f"s{i}_{j}"), F.sum(r * off * off).alias(f"v{i}_{j}")]
            at[k] = i
        row = work.agg(*aggs).first()
        for k in list(now):
            c, comps = now[k]
            i, n = at[k], row[f"n{at[k]}"]
            if not n:
                done[k] = (tuple(comps), -math.inf, rounds)
                del now[k]
                continue
            ll, new = row[f"ll{i}"], []
            for j, (w, m, s) in enumerate(comps):
                r = row[f"r{i}_{j}"]
                if r < 1e-9 * n:  # an empty component stays where it is, with next to no weight
                    new.append((1e-9, m, s))
                    continue
                step = row[f"s{i}_{j}"] / r
                new.append((r / n, m + step, max(math.sqrt(max(row[f"v{i}_{j}"] / r - step * step, 0.0)), least[k])))
            total = sum(w for w, _, _ in new)
            if (ll - last[k]) / n < tolerance or rounds >= max_rounds:
                done[k] = (tuple(comps), ll, rounds)
                del now[k]
            else:
                now[k], last[k] = (c, [(w / total, m, s) for w, m, s in new]), ll
    return done


def few_values(quantiles) -> bool:
    """Most neighbouring quantiles are equal: the column has atoms, which no mixture of densities describes."""
    return 2 * sum(a == b for a, b in zip(quantiles, quantiles[1:])) > len(quantiles)


def _starts(quantiles, var: float, k: int) -> list[tuple[float, float, float]]:
    """``k`` equal components, each on its share of the quantiles."""
    runs = np.array_split(np.array(quantiles), k)
    wide = math.sqrt(var)
    return [(1 / k, float(r.mean()), float(max(r.std(), wide / 50))) for r in runs]


def fit_columns(df: DataFrame, cols: list[str] | None = None, families: tuple = FAMILIES, max_components: int = 3, max_distance: float = MAX_DISTANCE) -> dict[str, Fit]:
    """{column: Fit} for numeric columns (default: all).

    Nulls, NaN and infinite values are left out and counted in ``null_share``; a column without values is ``empty``, one with
    a single value ``constant``. The table is read once where families fit, and once a round of EM for the others.
    """
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if not cols:
        return {}
    rows, found = summaries(df, cols)
    out, open_ = {}, {}
    for c, s in found.items():
        base = dict(n=s["n"], null_share=1 - s["n"] / rows if rows else 0.0, low=s["low"], high=s["high"], whole=s["odd"] == 0)
        if not s["n"] or s["low"] == s["high"]:
            out[c] = Fit("constant" if s["n"] else "empty", (s["low"],) if s["n"] else (), 0.0, 0.0, **base)
            continue
        score = {f: (len(p) * math.log(s["n"]) - 2 * ll, p) for f, (p, ll) in likelihoods(s).items() if f in families}
        ranked = sorted(score, key=lambda f: (score[f][0], FAMILIES.index(f)))
        bics = {f: score[f][0] for f in ranked}
        if ranked:
            far = distance(ranked[0], score[ranked[0]][1], s["q"], base["whole"])
            if far <= max(max_distance, NOISE / math.sqrt(base["n"])):
                out[c] = Fit(ranked[0], score[ranked[0]][1], far, score[ranked[0]][0], scores=bics, **base)
                continue
        open_[c] = (base, bics)
    for k in range(2, max_components + 1):  # one component more for the columns that are still too far off
        starts = {c: (c, _starts(found[c]["q"], found[c]["var"], k)) for c in open_ if c not in out and not few_values(found[c]["q"])}
        for c, (comps, ll, _) in mixtures(df, starts).items():
            base, bics = open_[c]
            bics[f"mixture{k}"] = bic = (3 * k - 1) * math.log(base["n"]) - 2 * ll
            far = distance("mixture", comps, found[c]["q"], base["whole"])
            if far <= max(max_distance, NOISE / math.sqrt(base["n"])):
                out[c] = Fit("mixture", comps, far, bic, scores=bics, **base)
    for c, (base, bics) in open_.items():
        if c not in out:
            out[c] = Fit("empirical", tuple(found[c]["q"]), 1 / len(found[c]["q"]), math.nan, scores=bics, **base)
    return {c: out[c] for c in cols}


def draw(fit: Fit, seed, tag: str, keys: list, dtype: T.DataType) -> Column:
    """A keyed draw from a fitted model within the observed extremes, rounded for whole numbers, null with the observed share."""
    p, x = fit.params, None
    if fit.family == "empty":
        return F.lit(None).cast(dtype)
    if fit.family == "constant":
        x = F.lit(float(p[0]))
    elif fit.family == "uniform":
        x = R.uniform(seed, tag, keys, *p)
    elif fit.family == "mixture":
        u, z = R.uniform01(seed, f"{tag}#part", keys), R.std_normal(seed, tag, keys)
        which = R.index_by_cdf(u, R.cumulative([w for w, _, _ in p]))
        for j, (_, m, s) in enumerate(p):
            y = F.lit(m) + F.lit(s) * z
            x = y if x is None else F.when(which == j, y).otherwise(x)
    elif fit.family == "empirical":
        q, n = F.array(*[F.lit(float(v)) for v in p]), len(p)
        at = R.uniform01(seed, tag, keys) * F.lit(float(n)) - F.lit(0.5)
        lo = F.greatest(F.floor(at), F.lit(0)).cast("int")
        hi = F.least(lo + F.lit(1), F.lit(n - 1))
        a, b = F.element_at(q, lo + 1), F.element_at(q, hi + 1)
        share = F.least(F.greatest(at - lo, F.lit(0.0)), F.lit(1.0))
        # a column with few values keeps to them; one with many is filled in between
        x = F.when(share < F.lit(0.5), a).otherwise(b) if few_values(p) else a + (b - a) * share
    else:
        x = getattr(R, fit.family)(seed, tag, keys, *p)
    if fit.family != "constant":
        x = F.round(x) if fit.whole else x
        x = F.least(F.greatest(x.cast("double"), F.lit(float(fit.low))), F.lit(float(fit.high)))
    if fit.null_share > 0:
        x = F.when(R.uniform01(seed, f"{tag}#null", keys) >= F.lit(fit.null_share), x)
    return x.cast(dtype)


def fit_table(fits: dict[str, Fit], spark) -> DataFrame:
    """The choices as rows: column_name, family, n, null_share, distance, bic, params."""
    rows = [(c, f.family, f.n, f.null_share, f.distance, f.bic, [float(v) for x in f.params for v in (x if isinstance(x, tuple) else (x,))]) for c, f in fits.items()]
    return spark.createDataFrame(rows, "column_name string, family string, n long, null_share double, distance double, bic double, params array<double>")


def fitted_twin(df: DataFrame, target: int, seed: int, key_cols: list[str], fits: dict[str, Fit] | None = None, **options) -> DataFrame:
    """A table of ``target`` rows with the seed table's schema whose numeric columns follow their fitted models.

    Keys are new, category columns keep their frequencies, dates are uniform over the observed span and other columns are
    resampled (as ``scale`` does). Columns are drawn independently; see ``scale_copula`` for correlations. An empty seed table gives
    an empty twin. Key columns hold no nulls.
    """
    kinds = SC.column_kinds(df, None, key_cols)
    numeric = [c for c, k in kinds.items() if k == "numerical" and isinstance(df.schema[c].dataType, T.NumericType)]
    fits = {**fit_columns(df, [c for c in numeric if c not in (fits or {})], **options), **(fits or {})}
    rest = [c for c in df.columns if c not in numeric or c in key_cols]
    m = SC.fit(df, {c: kinds[c] for c in rest})
    n = int(m["_n"])
    if n == 0:
        return df
    keys = [F.col("_row")]
    sel = {c: draw(fits[c], seed, f"fit:{c}", keys, df.schema[c].dataType) for c in numeric}
    for c in rest:
        t = df.schema[c].dataType
        if kinds[c] == "id":
            sel[c] = R.uuid_like(F.concat_ws(":", F.lit(str(seed)), F.lit(c), F.col("_row").cast("string"))) if isinstance(t, T.StringType) else (F.col("_row") + F.lit(1)).cast(t)
        elif kinds[c] == "datetime":
            sel[c] = SC.datetime_column(c, m, 1.0, seed, keys, t)
    out = df.sparkSession.range(target).withColumnRenamed("id", "_row").select("_row", *[v.alias(c) for c, v in sel.items()])
    for c in rest:
        if kinds[c] == "categorical":
            out = SC.categorical_draws(out, "_row", df, c, seed)
    other = [c for c in rest if kinds[c] == "text"]
    if other:
        out = SC.bootstrap(out, "_row", df, other, key_cols, seed, n)
    return out.select(*df.columns)
