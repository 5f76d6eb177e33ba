"""Leading eigenpairs of a symmetric matrix: Householder tridiagonalisation, Sturm-count bisection, inverse
iteration with reorthogonalisation inside clusters."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def tridiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit reflectors: ``matrix = H1 H2 ... T ... H2 H1`` with ``H = I - 2 v v'``,
    where reflector ``k`` acts on the entries from ``k + 1``."""
    a = np.array(matrix, dtype=float)
    n = len(a)
    off, mirrors = np.zeros(max(n - 1, 0)), []
    for k in range(n - 1):
        column = a[k + 1:, k].copy()
        length = np.linalg.norm(column)
        v = column.copy()
        v[0] += length if column[0] >= 0 else -length
        size = np.linalg.norm(v)
        if k == n - 2 or size == 0:  # nothing below the off-diagonal to clear
            off[k] = column[0]
            mirrors.append(np.zeros(n - 1 - k))
            continue
        v /= size
        off[k] = -length if column[0] >= 0 else length
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        mirrors.append(v)
    return np.diag(a).copy(), off, mirrors


def count_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For every value of ``at`` the number of eigenvalues below it: the negative pivots of ``T - at I``."""
    tiny = EPS * (np.abs(diagonal).max() + (np.abs(off).max() if len(off) else 0.0)) + 1e-300
    pivot = diagonal[0] - at
    n = (pivot < 0).astype(int)
    for d, e in zip(diagonal[1:], off):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = d - at - e * e / pivot
        n += pivot < 0
    return n


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` greatest eigenvalues, falling, each bisected down to rounding."""
    n = len(diagonal)
    radius = np.zeros(n)
    radius[:-1] += np.abs(off)
    radius[1:] += np.abs(off)
    margin = EPS * n * (np.abs(diagonal).max() + radius.max()) + 1e-300
    rank = n - 1 - np.arange(k)  # ascending number of each wanted value
    lo = np.full(k, (diagonal - radius).min() - margin)
    hi = np.full(k, (diagonal + radius).max() + margin)
    for _ in range(1100):  # a double has no more halvings than this
        mid = lo + (hi - lo) / 2
        if np.all((mid <= lo) | (mid >= hi) | (hi - lo <= 2 * EPS * np.maximum(np.abs(lo), np.abs(hi)))):
            break
        above = count_below(diagonal, off, mid) <= rank
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return lo + (hi - lo) / 2


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """``(T - shift I) x = right`` by elimination with row exchanges; a zero pivot becomes ``tiny``."""
    n = len(diagonal)
    x = right.copy()
    d, up, up2 = diagonal - shift, np.append(off, 0.0), np.zeros(n)
    for i in range(n - 1):
        low, d_next, up_next = off[i], d[i + 1], up[i + 1]
        if abs(d[i]) >= abs(low):
            pivot = d[i] if abs(d[i]) > tiny else tiny
            f = low / pivot
            d[i], d[i + 1] = pivot, d_next - f * up[i]
            x[i + 1] -= f * x[i]
        else:
            f = d[i] / low
            d[i], up[i], up2[i], d[i + 1], up[i + 1] = low, d_next, up_next, up[i] - f * d_next, -f * up_next
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
    if abs(d[-1]) <= tiny:
        d[-1] = tiny
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            x[i] -= up[i] * x[i + 1]
        if i + 2 < n:
            x[i] -= up2[i] * x[i + 2]
        x[i] /= d[i]
    return x


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(values, vectors)``: the ``min(k, n)`` greatest eigenvalues, falling, and their unit eigenvectors as columns."""
    diagonal, off, mirrors = tridiagonalise(matrix)
    n = len(diagonal)
    values = leading_values(diagonal, off, min(k, n))
    norm = max(np.abs(diagonal).max(), np.abs(off).max() if n > 1 else 0.0) or 1.0
    tiny, rng = EPS * norm, np.random.default_rng(1)
    vectors, cluster, shift = np.zeros((n, len(values))), 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            cluster = j  # the gap keeps later vectors orthogonal to the earlier ones by itself
        shift = min(value, shift - 10 * tiny)  # equal values get distinct shifts
        x = rng.standard_normal(n)
        for _ in range(5):
            for _ in range(2):
                before = vectors[:, cluster:j]
                x -= before @ (before.T @ x)
            x /= np.linalg.norm(x)
            x = _solve(diagonal, off, shift, x, tiny)
            x /= np.abs(x).max()
        for _ in range(2):
            before = vectors[:, cluster:j]
            x -= before @ (before.T @ x)
            x /= np.linalg.norm(x)
        vectors[:, j] = x
    for at in range(len(mirrors) - 1, -1, -1):
        v = mirrors[at]
        vectors[at + 1:] -= 2 * np.outer(v, v @ vectors[at + 1:])
    return values, vectors / np.linalg.norm(vectors, axis=0)
