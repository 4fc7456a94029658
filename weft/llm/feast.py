"""Leading eigenpairs of a small symmetric matrix by contour integration (FEAST).

The spectrum is cut into intervals by inertia counts. In each interval a quadrature over a circle of
complex shifted solves filters a random block onto the wanted eigenspace, Rayleigh-Ritz extracts the
pairs, and the count of pairs must equal the interval's inertia count, so none can be missed.
"""

from __future__ import annotations

import numpy as np

NODES = 12  # Gauss-Legendre points on the upper half circle
PER_SLICE = 8  # an interval with more eigenvalues is cut while it is wide enough
ROUNDS = 40
RESIDUAL = 1e-13  # of the matrix norm


def negatives(a: np.ndarray) -> int:
    """Number of negative eigenvalues: signs of the pivots of a Bunch-Parlett factorisation (Sylvester)."""
    a = a.copy()
    alpha, count = (1 + np.sqrt(17)) / 8, 0
    while len(a):
        n = len(a)
        d = np.abs(np.diag(a))
        p = int(d.argmax())
        off = np.abs(np.triu(a, 1))
        r, s = np.unravel_index(int(off.argmax()), off.shape)
        if n == 1 or d[p] >= alpha * off[r, s]:
            pivot = [p]
            if a[p, p] == 0:
                return count  # the rest is zero
        else:
            pivot = [int(r), int(s)]
        rest = [k for k in range(n) if k not in pivot]
        e, c = a[np.ix_(pivot, pivot)], a[np.ix_(rest, pivot)]
        count += int(e[0, 0] < 0) if len(pivot) == 1 else (1 if np.linalg.det(e) < 0 else 2 * int(e[0, 0] < 0))
        a = a[np.ix_(rest, rest)] - c @ np.linalg.solve(e, c.T)
    return count


def above(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of ``v`` over ``shift``."""
    return len(v) - negatives(v - shift * np.eye(len(v)))


def slice_pairs(v: np.ndarray, low: float, high: float, want: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` eigenpairs with values in (low, high); raises if the count is not met."""
    d = len(v)
    size = min(d, want + want // 2 + 4)
    norm = max(np.abs(v).sum(axis=1).max(), np.finfo(float).tiny)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, size)))[0]
    x, w = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi * (x + 1) / 2)
    mid, radius = (low + high) / 2, (high - low) / 2
    for _ in range(ROUNDS):
        y = np.zeros((d, size))
        for t, weight in zip(turn, w):
            y += weight / 2 * (radius * t * np.linalg.solve((mid + radius * t) * np.eye(d) - v, q)).real
        q = np.linalg.qr(y)[0]
        e, u = np.linalg.eigh(q.T @ v @ q)  # Rayleigh-Ritz in the filtered block
        q = q @ u
        inside = (e > low) & (e < high)
        if inside.sum() == want and np.linalg.norm(v @ q[:, inside] - q[:, inside] * e[inside], axis=0).max(initial=0) <= RESIDUAL * norm * np.sqrt(d):
            return e[inside], q[:, inside]
    raise ArithmeticError(f"{int(inside.sum())} eigenvalues found in ({low}, {high}), inertia counts {want}")


def clear_cut(v: np.ndarray, near: float, width: float, gap: float) -> float | None:
    """A shift within ``width`` of ``near`` that has no eigenvalue within ``gap``; None if there is none among the tries."""
    for k in range(12):
        cut = near + width * (0.0034 + 0.07 * k * (-1) ** k)
        if above(v, cut - gap) == above(v, cut + gap):
            return cut
    return None


def leading_pairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, columns of unit vectors) of the ``k`` largest eigenvalues, falling; fewer if the rank is less.

    Eigenvalues within rounding of zero (64 units of the trace for each dimension) count as zero. A
    matrix of zeros, or of no rows, gives none.
    """
    d = len(v)
    trace = float(np.trace(v)) if d else 0.0
    if not trace > 0:
        return np.zeros(0), np.zeros((d, 0))
    unit = np.finfo(float).eps * trace * d
    floor = clear_cut(v, 64 * unit, 32 * unit, unit) or 64 * unit
    todo, done, found = [(floor, trace * (1 + 1e-9) + unit, above(v, floor))], [], 0
    while todo and found < k:
        low, high, want = todo.pop()
        steep = high > 16 * low  # values of very different size are filtered apart
        middle = np.sqrt(low * high) if steep else (low + high) / 2
        wide = high - low > 1000 * unit and want > (0 if steep else PER_SLICE)
        cut = clear_cut(v, middle, min(middle - low, high - middle), unit) if wide else None
        if cut is not None:
            upper = want - (above(v, low) - above(v, cut))
            todo += [(low, cut, want - upper), (cut, high, upper)]  # the upper one is taken next
        elif want:
            done.append(slice_pairs(v, low, high, want)[1])
            found += want
    if not found:
        return np.zeros(0), np.zeros((d, 0))
    q = np.linalg.qr(np.hstack(done))[0]
    e, u = np.linalg.eigh(q.T @ v @ q)  # one more Ritz step makes vectors of neighbouring slices orthogonal
    order = np.argsort(-e)[:k]
    return e[order], (q @ u)[:, order]
