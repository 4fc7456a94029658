"""Operator 13: embedding whitening by FEAST contour integration.

Vectors become integers, whose sums are exact. Three passes gather bounded partials (one vector or one
dimension x dimension matrix a task, summed entry by entry): counts and sums, the centred covariance,
and, once ``weft.llm.feast`` has solved the small eigenproblem, the covariance of the whitened vectors.
A last pass projects every row. The driver holds matrices of dimension x dimension, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.feast import leading_pairs

ROWS = 2048  # vectors held as matrices at a time
LIMB = 20  # bits of a factor in exact products


@dataclass
class Whitening:
    """Fitted components: n vectors, exact sums of the scaled integers (less the offset), unit vectors in columns."""

    n: int
    offset: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def usable(column: pa.ListArray, dim: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (positions, matrix)} of the vectors without nulls and non-finite entries, of ``dim`` entries if given."""
    start = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.slice(start[0], start[-1] - start[0]).to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become nan
    start = start - start[0]
    bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
    size = np.diff(start)
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (size > 0) & (bad[start[1:]] == bad[start[:-1]])
    out = {}
    for length in np.unique(size[ok]).tolist() if dim is None else [dim]:
        at = np.flatnonzero(ok & (size == length))
        if len(at):
            out[length] = at, flat[start[at][:, None] + np.arange(length)]
    return out


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * c) as 64-bit integers; a value that leaves 62 bits is an error."""
    x = np.floor(scale * vectors)
    if x.size and np.abs(x).max() >= 2.0 ** 62:
        raise ArithmeticError(f"an embedding entry times {scale} leaves the range of 62 bits")
    return x.astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _limbs(values: list[int]) -> np.ndarray:
    """Non-negative integers as columns of LIMB bits, lowest first."""
    width = max((v.bit_length() for v in values), default=1)
    return np.array([[v >> (LIMB * j) & ((1 << LIMB) - 1) for j in range(width // LIMB + 1)] for v in values], np.int64)


def counted(vectors: DataFrame, scale: int) -> tuple[int, int, list[int]]:
    """(dimension, n, sums per dimension) of the usable vectors; of several lengths the most frequent, then the largest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in _slices(batches):
            for dim, (_, vs) in usable(b.column("v")).items():
                x = scaled(vs, scale)
                own = held.setdefault(dim, [0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)])
                own[0] += len(x)
                own[1] += (x >> 32).sum(axis=0)
                own[2] += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"dim": pa.array(list(held), pa.int32()), "n": pa.array([h[0] for h in held.values()], pa.int64()),
                                          "hi": pa.array([h[1] for h in held.values()], pa.list_(pa.int64())),
                                          "lo": pa.array([h[2] for h in held.values()], pa.list_(pa.int64()))})

    parts = vectors.mapInArrow(run, "dim int, n long, hi array<long>, lo array<long>")
    each = parts.select("dim", "n", F.posexplode(F.arrays_zip("hi", "lo")).alias("at", "z"))
    total = each.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum(F.col("z.hi").cast("decimal(38,0)")).alias("hi"), F.sum(F.col("z.lo").cast("decimal(38,0)")).alias("lo"))
    best = total.where("at = 0").orderBy(F.desc("n"), F.desc("dim")).first()
    if best is None:
        return 0, 0, []
    rows = total.where(F.col("dim") == best.dim).orderBy("at").collect()
    return best.dim, best.n, [(int(r.hi) << 32) + int(r.lo) for r in rows]


def _centred(x: np.ndarray, whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    """x - S/n, where S/n = whole + part: the integer difference is exact, only the fraction rounds."""
    return (x - whole).astype(np.float64) - part


def _gram(vectors: DataFrame, dim: int, size: int, rows_of) -> np.ndarray:
    """Sum over the usable vectors of the outer products of ``rows_of(vectors)`` (size entries each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((size, size))
        for b in _slices(batches):
            for _, vs in usable(b.column("v"), dim).values():
                y = rows_of(vs)
                gram += y.T @ y
        yield pa.RecordBatch.from_pydict({"g": pa.array([gram.ravel()], pa.list_(pa.float64()))})

    sums = vectors.mapInArrow(run, "g array<double>").select(F.posexplode("g").alias("at", "g")).groupBy("at").agg(F.sum("g").alias("g")).collect()
    out = np.zeros(size * size)
    for r in sums:
        out[r["at"]] = r["g"]
    return out.reshape(size, size)


def fit(embeddings: DataFrame, vec: str, components: int, scale: int, offset: int) -> Whitening | None:
    """Components of all usable vectors; None if there are none."""
    vectors = embeddings.select(F.col(f"`{vec}`").alias("v"))
    dim, n, sums = counted(vectors, scale)
    if not n:
        return None
    whole, part = np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums])
    cov = _gram(vectors, dim, dim, lambda vs: _centred(scaled(vs, scale), whole, part)) / n
    cov = (cov + cov.T) / 2
    values, unit = leading_pairs(cov, components)
    k = len(values)
    error = 0.0
    if k:
        turn = unit / np.sqrt(values)
        white = _gram(vectors, dim, k, lambda vs: _centred(scaled(vs, scale), whole, part) @ turn) / n  # their mean is zero
        error = float(np.abs(white - np.eye(k)).max())
    return Whitening(n, offset, sums, values, unit, float(np.trace(cov)), error)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n*x - S)^2, exact: with S = n*q + r and a = x - q it is n^2 aa - 2n ar + rr."""
    q, r = [s // n for s in sums], [s % n for s in sums]
    a = x - np.array(q, np.int64)
    if np.abs(a).max(initial=0) >= 1 << 27 or len(q) > 1 << 8:  # products could leave 64 bits
        a = a.astype(object)
    aa, ar, rr = (a * a).sum(axis=1), a @ _limbs(r), sum(v * v for v in r)
    return [n * n * int(s) - 2 * n * sum(int(c) << (LIMB * j) for j, c in enumerate(t)) + rr for s, t in zip(aa, ar)]


def whitened(embeddings: DataFrame, id_col: str = "vec_id", vec: str = "embedding", components: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """One row per usable row and component: id, component, n, deviation (decimal), whitened, explained, identity_error.

    Entries c become integers floor(scale * c) + offset. Rows whose vector is null, empty or holds null or
    non-finite entries take no part; of vectors of several lengths those of the most frequent one (then
    the longest) are fitted and the rest takes no part. Equal vectors count as often as they stand,
    repeated or null ids keep their rows, other columns are ignored. Components follow the eigenvalues
    downwards; a covariance of lower rank than ``components`` has fewer (one vector, or equal ones: no
    rows), ties may take any orthonormal vectors, the same for all rows. ``deviation`` beyond 38 digits
    is null. An entry beyond 2^62 once scaled raises ArithmeticError. An empty table gives no rows.
    """
    src = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec}`").alias("v"))
    schema = f"`{id_col}` long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    w = fit(embeddings, vec, components, scale, offset)
    if w is None or not len(w.values):
        return embeddings.sparkSession.createDataFrame([], schema)
    dim, k = w.vectors.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, part = np.array([s // w.n for s in w.sums], np.int64), np.array([s % w.n / w.n for s in w.sums])
        turn = w.vectors / np.sqrt(w.values)
        share = w.values / w.trace
        for b in _slices(batches):
            for at, vs in usable(b.column("v"), dim).values():
                x = scaled(vs, scale)
                dev = [Decimal(d) if d < 10 ** 38 else None for d in deviations(x, w.n, w.sums)]
                each = pa.array(np.repeat(np.arange(len(at)), k))
                yield pa.RecordBatch.from_arrays([
                    b.column("id").take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(at) * k, w.n, np.int64)), pa.array(dev, pa.decimal128(38, 0)).take(each),
                    pa.array((_centred(x, whole, part) @ turn).ravel()), pa.array(np.tile(share, len(at))),
                    pa.array(np.full(len(at) * k, w.identity_error))],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return src.mapInArrow(run, schema)
