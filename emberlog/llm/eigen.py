"""Eigenvalues and eigenvectors of a symmetric matrix: Householder tridiagonal form, then divide and conquer by rank-one updates."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with a = q t q', by reflections that clear one column after another."""
    a, n = np.array(a, np.float64), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        size = np.abs(x[1:]).max(initial=0.0)
        if size == 0.0:
            continue
        v = x / max(size, abs(x[0]))
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        v /= np.sqrt(v @ v)
        part = a[k + 1 :, k:]
        part -= 2.0 * np.outer(v, v @ part)
        part = a[k:, k + 1 :]
        part -= 2.0 * np.outer(part @ v, v)
        q[:, k + 1 :] -= 2.0 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), (np.diag(a, -1) + np.diag(a, 1)) / 2, q


def _roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum z_j^2 / (d_j - x), one right of each d_j (d rises, z has no zero): the roots, and d_j - root_i to full relative accuracy.

    Each root is an offset from its nearer pole; halving runs until the offset's neighbours in floating point are left.
    """
    k, zz = len(d), z * z
    right = np.append(d[1:], d[-1] + rho * zz.sum())
    gap = right - d
    middle = d + gap / 2
    at_middle = 1.0 + rho * (zz[:, None] / (d[:, None] - middle)).sum(0)
    near_left = at_middle >= 0.0
    near_left[-1] = True  # there is no pole to the right of the last root
    origin = np.where(near_left, d, right)
    low = np.where(near_left, 0.0, -gap / 2)
    high = np.where(near_left, np.where(np.arange(k) == k - 1, gap * (1 + 4 * EPS), gap / 2), 0.0)
    apart = d[:, None] - origin
    for _ in range(1100):
        t = (low + high) / 2
        if np.all((t == low) | (t == high)):
            break
        with np.errstate(divide="ignore", over="ignore"):
            f = 1.0 + rho * (zz[:, None] / (apart - t)).sum(0)
        low, high = np.where(f < 0.0, t, low), np.where(f < 0.0, high, t)
    t = np.where(near_left, high, low)  # the end that is not the pole itself
    return origin + t, apart - t


def _update(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of diag(d) + rho z z', rho > 0. Small z and equal d are set aside first."""
    n = len(d)
    order = np.argsort(d, kind="stable")
    d, z = d[order].copy(), z[order].copy()
    q = np.eye(n)[:, order]
    tol = 8 * EPS * max(np.abs(d).max(), rho * (z @ z))
    last = -1
    for i in range(n):
        if rho * abs(z[i]) * np.sqrt(z @ z) <= tol:
            z[i] = 0.0
            continue
        if last >= 0:
            r = np.hypot(z[last], z[i])
            c, s = z[i] / r, z[last] / r
            if abs((d[i] - d[last]) * c * s) <= tol:  # turning the two makes one of them part of neither
                z[last], z[i] = 0.0, r
                d[last], d[i] = d[last] * c * c + d[i] * s * s, d[last] * s * s + d[i] * c * c
                q[:, [last, i]] = np.column_stack([c * q[:, last] - s * q[:, i], s * q[:, last] + c * q[:, i]])
        last = i
    left = np.flatnonzero(z)
    values, vectors = d.copy(), q.copy()
    if len(left):
        left = left[np.argsort(d[left], kind="stable")]
        dl, zl = d[left], z[left]
        root, apart = _roots(dl, zl, rho)
        # the z whose update has exactly these roots: its eigenvectors are orthogonal to working precision
        between = dl[None, :] - dl[:, None]  # [j, i]: d_i - d_j
        np.fill_diagonal(between, 1.0)
        exact = np.sqrt(np.abs(np.prod(-apart / between, axis=1))) * np.sign(zl)
        u = exact[:, None] / apart
        u /= np.sqrt((u * u).sum(0))
        values[left], vectors[:, left] = root, q[:, left] @ u
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def _divide(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(d)
    if n == 1:
        return d.copy(), np.ones((1, 1))
    m = n // 2
    rho, sign = abs(e[m - 1]), -1.0 if e[m - 1] < 0 else 1.0
    upper, lower = d[:m].copy(), d[m:].copy()
    upper[-1] -= rho
    lower[0] -= rho
    (w1, q1), (w2, q2) = _divide(upper, e[: m - 1]), _divide(lower, e[m:])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    w = np.concatenate([w1, w2])
    if rho == 0.0:
        order = np.argsort(w, kind="stable")
        return w[order], q[:, order]
    values, vectors = _update(w, np.concatenate([q1[-1], sign * q2[0]]), rho)
    return values, q @ vectors


def eigh(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors, as columns, of a symmetric matrix."""
    size = np.abs(a).max(initial=0.0)
    if not len(a) or size == 0.0:
        return np.zeros(len(a)), np.eye(len(a))
    d, e, q = tridiagonal(a / size)
    w, z = _divide(d, e)
    return w[::-1] * size, (q @ z)[:, ::-1]
