"""Leading eigenvectors of a symmetric matrix: Householder, Sturm counts, inverse iteration.

The matrix is as wide as the vectors of a table, whatever their number, so this is work for the driver.
"""

from __future__ import annotations

import numpy as np

#: Eigenvalues closer than this part of the norm are one cluster, whose vectors are kept at right angles.
CLUSTER = 1e-3
TURNS = 5


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and reflectors of Q'AQ: Q is the product of I - 2vv' for the rows v in turn."""
    a = np.array(matrix, float)
    n = len(a)
    mirrors = np.zeros((max(n - 2, 0), n))
    for k in range(n - 2):
        column = a[k + 1 :, k]
        v = column / (np.abs(column).max() or 1.0)
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v /= size
        mirrors[k, k + 1 :] = v
        part = a[k + 1 :, k + 1 :]
        p = part @ v
        w = p - (v @ p) * v
        part -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ column)
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def counts_below(diagonal: np.ndarray, beside: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix are below each x."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    squares = np.r_[0.0, beside**2]
    least = np.maximum(tiny, np.finfo(float).eps * np.sqrt(squares))
    q = np.ones_like(x)
    below = np.zeros(len(x), np.int64)
    for d, s, small in zip(diagonal, squares, least):
        q = d - x - s / q
        q = np.where(np.abs(q) < small, -small, q)
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, beside: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection down to neighbouring doubles."""
    n = len(diagonal)
    off = np.abs(np.r_[0.0, beside]) + np.abs(np.r_[beside, 0.0])
    low, high = np.full(k, (diagonal - off).min()), np.full(k, (diagonal + off).max())
    span = np.abs(np.r_[low, high]).max() * 4 * np.finfo(float).eps + np.finfo(float).tiny
    low, high = low - span, high + span
    wanted = n - 1 - np.arange(k)  # so many eigenvalues lie below the one looked for
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        above = counts_below(diagonal, beside, middle) <= wanted
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def solved(diagonal: np.ndarray, beside: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """(T - shift) x = right by elimination with row exchanges; a pivot of zero becomes tiny."""
    n = len(diagonal)
    small = np.finfo(float).eps * max(np.abs(diagonal).max(), np.abs(beside).max(initial=0.0), np.finfo(float).tiny)
    d, up, x = (diagonal - shift).tolist(), [*beside.tolist(), 0.0], right.tolist()
    low, far = beside.tolist(), [0.0] * n
    for i in range(n - 1):
        if abs(d[i]) >= abs(low[i]):
            factor = low[i] / (d[i] if abs(d[i]) > small else small)
            d[i + 1] -= factor * up[i]
            x[i + 1] -= factor * x[i]
        else:
            factor = d[i] / low[i]
            d[i], d[i + 1], up[i], far[i] = low[i], up[i] - factor * d[i + 1], d[i + 1], up[i + 1]
            up[i + 1] = -factor * far[i]
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
    for i in range(n - 1, -1, -1):
        rest = x[i] - (up[i] * x[i + 1] if i + 1 < n else 0.0) - (far[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = rest / (d[i] if abs(d[i]) > small else np.copysign(small, d[i]))
    return np.array(x)


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as rows; the largest entry of each is positive."""
    n = len(matrix)
    k = min(k, n)
    scale = float(np.abs(matrix).max()) if n else 0.0
    if scale == 0:
        return np.zeros(k), np.eye(k, n)
    diagonal, beside, mirrors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, beside, k)
    norm = np.abs(values).max() + np.abs(beside).max(initial=0.0)
    random = np.random.default_rng(1)
    vectors = np.zeros((k, n))
    cluster = 0  # first of the eigenvalues that are close to the one at hand
    shift = np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            cluster = j
        # Equal eigenvalues get shifts that differ a little, so that their systems do.
        shift = min(value, shift - 4 * np.finfo(float).eps * norm) if j > cluster else value
        x = random.standard_normal(n)
        for _ in range(TURNS):
            x = solved(diagonal, beside, shift, x / np.linalg.norm(x))
            x /= np.abs(x).max()
            for _ in range(2):
                x -= vectors[cluster:j].T @ (vectors[cluster:j] @ x)
        vectors[j] = x / np.linalg.norm(x)
    for v in mirrors[::-1]:
        vectors -= 2 * np.outer(vectors @ v, v)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    most = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], axis=1)
    return values * scale, vectors * np.where(most < 0, -1.0, 1.0)
