"""Linear hinge-loss models by dual coordinate descent, and the byte n-gram features that classifiers here share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Byte pairs have a feature each; byte triples share this many by hash.
PAIRS, TRIPLES = 1 << 16, 1 << 17
FEATURES = PAIRS + TRIPLES


def grams(text: bytes) -> np.ndarray:
    """Feature numbers of all byte pairs and byte triples of a text, in order, with repeats."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 2:
        return np.empty(0, np.uint32)
    pairs = b[:-1] << np.uint32(8) | b[1:]
    triples = (pairs[:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761) >> np.uint32(15)
    return np.concatenate([pairs, triples + np.uint32(PAIRS)])


def present(text: bytes, seen: np.ndarray) -> np.ndarray:
    """The distinct features of a text, in order. ``seen`` is a zeroed scratch array of FEATURES flags and is left zeroed."""
    codes = grams(text)
    if len(codes) < 4096:
        return np.unique(codes)
    seen[codes] = 1
    out = np.flatnonzero(seen).astype(np.uint32)
    seen[out] = 0
    return out


def hinge_fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, cost: np.ndarray, epochs: int = 20, seed: int = 1) -> tuple[np.ndarray, float]:
    """Minimises |w|^2 / 2 + sum cost_i * max(0, 1 - y_i (w x_i + b)) by dual coordinate descent (one variable a row).

    Rows are (feature numbers, values); y is 1 or -1; the bias is one more feature of value 1.
    """
    w, b, alpha = np.zeros(dims), 0.0, np.zeros(len(rows))
    norm = np.array([v @ v + 1.0 for _, v in rows])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            g = y[i] * (w[at] @ v + b) - 1.0
            a = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if (d := a - alpha[i]) != 0.0:
                w[at] += d * y[i] * v
                b += d * y[i]
                alpha[i] = a
                moved = max(moved, abs(d))
        if moved < 1e-4:
            break
    return w, b


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """The slope and offset that turn margins into probabilities, by Newton's method on the logistic loss with smoothed labels."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum(), (p - t).sum()]) + np.array([1e-3 * a, 0])
        q = p * (1 - p)
        h = np.array([[(q * margin**2).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """The logistic function."""
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def windows(text: bytes, sizes: tuple[int, ...], seed: int) -> Iterator[bytes]:
    """One part of the text of each size, anywhere in it: what a shorter document would look like."""
    draw = np.random.default_rng(seed)
    for n in sizes:
        if len(text) > n:
            at = int(draw.integers(len(text) - n))
            yield text[at : at + n]
