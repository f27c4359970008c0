"""Leading eigenvalues and eigenvectors of a symmetric matrix of the size of one vector: Householder
tridiagonalisation, bisection on Sturm counts, inverse iteration. Runs in the driver; the matrix does not grow with the
rows it was made from."""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
#: Eigenvalues nearer than this, relative to the norm, are made orthogonal to each other.
CLUSTER = 1e-3


def tridiagonal(matrix):
    """Diagonal, off-diagonal and the orthogonal matrix ``q`` with matrix = q T q'."""
    a, n = matrix.copy(), len(matrix)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.sqrt(v @ v)
        if length == 0:
            continue
        end = -np.copysign(length, v[0])
        v[0] -= end
        v /= np.sqrt(v @ v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2 * (p - (p @ v) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = end
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def below(diagonal, off, shifts):
    """Sturm counts: how many eigenvalues are less than each of ``shifts``."""
    squares = off * off
    least = np.finfo(float).tiny * max(1.0, float(squares.max(initial=0)))
    count, pivot = np.zeros(len(shifts), int), np.full(len(shifts), np.inf)
    for i, d in enumerate(diagonal):
        pivot = d - shifts - (squares[i - 1] / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot < 0
    return count


def largest_values(diagonal, off, k: int):
    """The ``k`` largest eigenvalues, falling, bisected until no number lies between the ends."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    slack = EPS * n * max(np.abs(diagonal).max(), reach.max(), np.finfo(float).tiny) * 4
    low = np.full(k, (diagonal - reach).min() - slack)
    high = np.full(k, (diagonal + reach).max() + slack)
    wanted = n - 1 - np.arange(k)
    while True:
        middle = (low + high) / 2
        if not np.any(open_ := (low < middle) & (middle < high)):
            return middle
        over = below(diagonal, off, middle) > wanted
        high = np.where(open_ & over, middle, high)
        low = np.where(open_ & ~over, middle, low)


def _factored(diagonal, off, value, least):
    """LU factors, with row exchanges, of the tridiagonal matrix less ``value``."""
    n = len(diagonal)
    main, up, down = (diagonal - value).tolist(), off.tolist(), off.tolist()
    second, swapped = [0.0] * n, [False] * n
    for i in range(n - 1):
        if abs(main[i]) >= abs(down[i]):
            if abs(main[i]) < least:
                main[i] = least
            down[i] /= main[i]
            main[i + 1] -= down[i] * up[i]
        else:
            ratio, swapped[i] = main[i] / down[i], True
            main[i], down[i] = down[i], ratio
            up[i], main[i + 1] = main[i + 1], up[i] - ratio * main[i + 1]
            if i < n - 2:
                second[i], up[i + 1] = up[i + 1], -ratio * up[i + 1]
    if abs(main[-1]) < least:
        main[-1] = least
    return main, up, second, down, swapped


def _solved(factors, right):
    main, up, second, down, swapped = factors
    x, n = right.tolist(), len(main)
    for i in range(n - 1):
        if swapped[i]:
            x[i], x[i + 1] = x[i + 1], x[i] - down[i] * x[i + 1]
        else:
            x[i + 1] -= down[i] * x[i]
    for i in range(n - 1, -1, -1):
        total = x[i]
        if i + 1 < n:
            total -= up[i] * x[i + 1]
        if i + 2 < n:
            total -= second[i] * x[i + 2]
        x[i] = total / main[i]
    return np.array(x)


def vectors_of(diagonal, off, values):
    """Unit eigenvectors, as columns, of falling ``values``, by inverse iteration; those of a cluster are made orthogonal
    again in every step."""
    n = len(diagonal)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0), np.finfo(float).tiny)
    starts = np.random.default_rng(12).standard_normal((len(values), n))
    out = np.zeros((n, len(values)))
    first, used = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        # equal eigenvalues: a little apart, so that each step has its own factors
        used = min(value, used - 10 * EPS * norm) if j > first else value
        factors, v = _factored(diagonal, off, used, EPS * norm), starts[j]
        for _ in range(5):
            v = _solved(factors, v / np.abs(v).max())
            for _ in range(2 * (j > first)):
                v = v - out[:, first:j] @ (out[:, first:j].T @ v)
            v = v / np.sqrt(v @ v)
        out[:, j] = v
    return out


def leading(matrix, k: int):
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors as columns; each vector's largest entry is positive."""
    scale = float(np.abs(matrix).max(initial=0))
    if scale == 0:
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    diagonal, off, q = tridiagonal(matrix / scale)
    values = largest_values(diagonal, off, k)
    vectors = q @ vectors_of(diagonal, off, values)
    at = np.abs(vectors).argmax(axis=0)
    return values * scale, vectors * np.sign(vectors[at, np.arange(k)])
