"""Keyed, partition-independent randomness and inverse-CDF samplers as Column expressions.

Every random draw is a pure function of (seed, tag, row key): SHA-256 of the text
``seed:tag:key...``, first 13 hex digits (52 bits) divided by 2^52.  The value is
exact in a double, identical on every executor, after retries and under any
partitioning, and reproducible in other SQL engines.  Nothing here uses
``rand()``, ``uuid()`` or ``monotonically_increasing_id()``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2**52)
EPS_53 = 2.0**-53

KeyLike = "str | Column"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_text(seed, tag: str, keys: Sequence) -> Column:
    parts = [F.lit(f"{seed}:{tag}")] + [_col(k).cast("string") for k in keys]
    return F.concat_ws(":", *parts)


def hex52(text: Column) -> Column:
    """52-bit integer from the first 13 hex digits of SHA-256(text)."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")


def uniform01(seed, tag: str, keys: Sequence) -> Column:
    """U in [0, 1) keyed on (seed, tag, keys)."""
    return hex52(key_text(seed, tag, keys)).cast("double") / F.lit(TWO_52)


def below(seed, tag: str, keys: Sequence, rate: float) -> Column:
    """``uniform01(seed, tag, keys) < rate``, compared as hex digits: nothing is converted to a number."""
    cut = math.ceil(float(rate) * TWO_52)
    if cut >= 1 << 52:
        return F.lit(True)
    return F.substring(F.sha2(key_text(seed, tag, keys), 256), 1, 13) < F.lit(f"{max(cut, 0):013x}")


def seed_of_text(text: Column) -> Column:
    """SHA-256 of the text as an integer, modulo 2^31 (only the last 8 hex digits matter)."""
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), -8, 8), 16, 10).cast("long"), F.lit(2**31))


# ---------------------------------------------------------------- samplers


def uniform(seed, tag, keys, low=0.0, high=1.0) -> Column:
    return F.lit(float(low)) + F.lit(float(high - low)) * uniform01(seed, tag, keys)


def std_normal(seed, tag, keys) -> Column:
    """Box-Muller on two keyed uniforms; u1 shifted by 2^-53 so ln never sees 0."""
    u1 = uniform01(seed, f"{tag}#1", keys) + F.lit(EPS_53)
    u2 = uniform01(seed, f"{tag}#2", keys)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def normal(seed, tag, keys, mean=0.0, std=1.0) -> Column:
    return F.lit(float(mean)) + F.lit(float(std)) * std_normal(seed, tag, keys)


def lognormal(seed, tag, keys, mean=10.5, sigma=0.8) -> Column:
    return F.exp(normal(seed, tag, keys, mean, sigma))


def exponential(seed, tag, keys, scale=1.0) -> Column:
    return F.lit(-float(scale)) * F.log(F.lit(1.0) - uniform01(seed, tag, keys))


def weibull(seed, tag, keys, shape=1.5, scale=1.0) -> Column:
    return F.lit(float(scale)) * F.pow(-F.log(F.lit(1.0) - uniform01(seed, tag, keys)), F.lit(1.0 / shape))


def bernoulli(seed, tag, keys, p=0.5) -> Column:
    return F.when(uniform01(seed, tag, keys) < F.lit(float(p)), F.lit(1.0)).otherwise(F.lit(0.0))


def index_by_cdf(u: Column, cdf: Sequence[float], inclusive: bool = True) -> Column:
    """0-based index of the first cumulative weight strictly above u (count of cdf values <= u;
    with ``inclusive=False`` the count of values < u).

    A balanced tree of ``when`` tests (binary search, depth log2 n): it compiles into the
    whole-stage code, where a ``filter`` lambda over the array would be interpreted per row
    (about 15x slower on a 40-point Poisson CDF).
    """
    cdf = [float(c) for c in cdf]

    def node(lo: int, hi: int) -> Column:  # the answer lies in [lo, hi]; hi = len(cdf) means "none above"
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        left = (u < F.lit(cdf[mid])) if inclusive else (u <= F.lit(cdf[mid]))
        return F.when(left, node(lo, mid)).otherwise(node(mid + 1, hi))

    return node(0, len(cdf))


def cumulative(weights: Sequence[float]) -> list[float]:
    tot = float(sum(weights))
    out, acc = [], 0.0
    for w in weights[:-1]:
        acc += float(w) / tot
        out.append(acc)
    return out


def categorical(seed, tag, keys, values: Sequence, weights: Sequence[float] | None = None) -> Column:
    weights = list(weights) if weights is not None else [1.0] * len(values)
    idx = index_by_cdf(uniform01(seed, tag, keys), cumulative(weights))
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx + 1)


TREE_POINTS = 256  # cut points that still compile well as a tree of tests


def poisson_cdf(mu: float) -> tuple[int, list[float]]:
    """(first k, CDF at first k, first k + 1, ...) of Poisson(mu): all k whose term is above 1e-18.

    Terms are taken in log space from the mode outward, so no mu underflows; what is left out is
    far below the 2^-52 step of the uniform draws.
    """
    if not 0 < mu <= 1e7:
        raise ValueError("Poisson needs 0 < mu <= 10,000,000")
    mode = int(mu)
    top = math.exp(mode * math.log(mu) - mu - math.lgamma(mode + 1))
    down, k, p = [], mode, top
    while k > 0 and p > 1e-18:
        p *= k / mu
        k -= 1
        down.append(p)
    up, j, p = [], mode, top
    while p > 1e-18 or j < mu:
        j += 1
        p *= mu / j
        up.append(p)
    terms = [*reversed(down), top, *up]
    total = math.fsum(terms)
    out, acc = [], 0.0
    for t in terms[:-1]:
        acc += t / total
        out.append(min(acc, 1.0))
    return k, out


def _index_by_search(u: Column, cdf: Sequence[float]) -> Column:
    """As ``index_by_cdf`` for long tables: a binary search of log2 n steps over one array literal."""
    table = F.lit([float(c) for c in cdf])
    steps = F.lit([1 << b for b in reversed(range(len(cdf).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= F.lit(len(cdf))) & (F.get(table, at + step - 1) <= u), at + step).otherwise(at))


def poisson(seed, tag, keys, mu=10.0) -> Column:
    """Poisson(mu) as a double: exact inverse CDF for every mu (the two lookups give the same index)."""
    first, cdf = poisson_cdf(mu)
    u = uniform01(seed, tag, keys)
    index = index_by_cdf(u, cdf) if len(cdf) <= TREE_POINTS else _index_by_search(u, cdf)
    return (index + F.lit(first)).cast("double")


def _gamma_ge1(seed, tag, keys, shape: float, n_candidates: int = 12) -> Column:
    """Marsaglia-Tsang for shape >= 1 with a fixed set of keyed candidates; first accepted wins."""
    d = shape - 1.0 / 3.0
    c = 1.0 / math.sqrt(9.0 * d)
    cands = []
    for i in range(n_candidates):
        z = std_normal(seed, f"{tag}#z{i}", keys)
        u = uniform01(seed, f"{tag}#u{i}", keys) + F.lit(EPS_53)
        v = F.pow(F.lit(1.0) + F.lit(c) * z, F.lit(3.0))
        ok = (v > 0) & (F.log(u) < F.lit(0.5) * z * z + F.lit(d) - F.lit(d) * v + F.lit(d) * F.log(v))
        cands.append((ok, F.lit(d) * v))
    out = F.lit(d)
    for ok, val in reversed(cands):
        out = F.when(ok, val).otherwise(out)
    return out


def gamma(seed, tag, keys, shape=2.0, scale=1.0) -> Column:
    shape = float(shape)
    if shape == int(shape) and shape <= 8:
        # sum of exponentials: exact and cheap for small integer shapes
        acc = None
        for i in range(int(shape)):
            term = -F.log(F.lit(1.0) - uniform01(seed, f"{tag}#e{i}", keys))
            acc = term if acc is None else acc + term
        return F.lit(float(scale)) * acc
    if shape >= 1.0:
        return F.lit(float(scale)) * _gamma_ge1(seed, tag, keys, shape)
    boost = _gamma_ge1(seed, tag, keys, shape + 1.0)
    u = uniform01(seed, f"{tag}#boost", keys) + F.lit(EPS_53)
    return F.lit(float(scale)) * boost * F.pow(u, F.lit(1.0 / shape))


def beta(seed, tag, keys, a=2.0, b=5.0) -> Column:
    x = gamma(seed, f"{tag}#x", keys, a, 1.0)
    y = gamma(seed, f"{tag}#y", keys, b, 1.0)
    return x / (x + y)


# ------------------------------------------------ normal CDF and its inverse


def phi(x: Column) -> Column:
    """Standard normal CDF via the Abramowitz-Stegun 7.1.26 erf approximation (|err| < 1.5e-7)."""
    # fixed values: Abramowitz & Stegun 7.1.26 coefficients
    p, a1, a2, a3, a4, a5 = 0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429
    z = F.abs(x) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * z)
    poly = t * (F.lit(a1) + t * (F.lit(a2) + t * (F.lit(a3) + t * (F.lit(a4) + t * F.lit(a5)))))
    erf = F.lit(1.0) - poly * F.exp(-z * z)
    return F.lit(0.5) * (F.lit(1.0) + F.signum(x) * erf)


# fixed values: Acklam's rational approximation of the inverse normal CDF
_ACK_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_ACK_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
_ACK_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_ACK_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]
_ACK_LOW = 0.02425


def _horner(x: Column, coefs: Sequence[float]) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def phi_inv(p: Column) -> Column:
    q_lo = F.sqrt(F.lit(-2.0) * F.log(p))
    lo = _horner(q_lo, _ACK_C) / (_horner(q_lo, _ACK_D) * q_lo + F.lit(1.0))
    q = p - F.lit(0.5)
    r = q * q
    mid = _horner(r, _ACK_A) * q / (_horner(r, _ACK_B) * r + F.lit(1.0))
    q_hi = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    hi = -_horner(q_hi, _ACK_C) / (_horner(q_hi, _ACK_D) * q_hi + F.lit(1.0))
    return F.when(p < F.lit(_ACK_LOW), lo).when(p > F.lit(1.0 - _ACK_LOW), hi).otherwise(mid)


def truncnorm(seed, tag, keys, mean=40.0, std=15.0, low=0.0, high=120.0) -> Column:
    a = (low - mean) / std
    b = (high - mean) / std
    pa = F.lit(_phi_py(a))
    pb = F.lit(_phi_py(b))
    p = pa + (pb - pa) * (uniform01(seed, tag, keys) + F.lit(EPS_53))
    x = F.lit(float(mean)) + F.lit(float(std)) * phi_inv(p)
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def _phi_py(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


def clip(x: Column, low=None, high=None) -> Column:
    """Clip keeping nulls null (least/greatest alone would skip a null input)."""
    y = x
    if low is not None:
        y = F.greatest(y, F.lit(float(low)))
    if high is not None:
        y = F.least(y, F.lit(float(high)))
    return F.when(x.isNull(), F.lit(None)).otherwise(y)


def uuid_like(text: Column) -> Column:
    """Deterministic uuid-shaped text (8-4-4-4-12 hex) from SHA-256 of the text."""
    h = F.sha2(text, 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))
