"""Small models over sparse rows, trained on a bounded sample in one task and scored in all."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse rows: values val at columns idx, row r from ptr[r] to ptr[r + 1]."""

    def __init__(self, idx, val, counts):
        self.idx, self.val = np.asarray(idx, np.int32), np.asarray(val, np.float32)
        self.counts = np.asarray(counts, np.int64)
        self.ptr = np.concatenate(([0], np.cumsum(self.counts)))
        self.row = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.idx], len(self.counts))

    def back(self, g: np.ndarray, dim: int) -> np.ndarray:
        return np.bincount(self.idx, self.val * g[self.row], dim)

    def take(self, rows: np.ndarray) -> Rows:
        n = self.counts[rows]
        pos = np.repeat(self.ptr[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(rows) else np.zeros(0, np.int64)
        return Rows(self.idx[pos], self.val[pos], n)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def seg_sum(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; a run of none sums to 0. x may have columns."""
    total = np.concatenate((np.zeros((1, *x.shape[1:]), np.float64), np.cumsum(x, axis=0, dtype=np.float64)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, name: str, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        t = self.t
        m = self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * g
        v = self.v[name] = 0.999 * self.v.get(name, 0) + 0.001 * g * g
        return w - self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)


def fit_logistic(x: Rows, y: np.ndarray, dim: int, l2: float = 1e-4, rate: float = 0.1, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and intercept; with one class only, the intercept alone."""
    w, n = np.zeros(dim), max(1, len(y))
    p = (y.sum() + 0.5) / (len(y) + 1)
    b = float(np.log(p / (1 - p)))
    if not 0 < y.sum() < len(y):
        return w, b
    adam = Adam(rate)
    for adam.t in range(1, steps + 1):
        g = (sigmoid(x.dot(w) + b) - y) / n
        w = adam.step("w", w, x.back(g, dim) + l2 * w)
        b = float(adam.step("b", np.array(b), g.sum()))
    return w, b


def fit_platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, c of sigmoid(a z + c), by Newton steps on the smoothed targets of Platt's method; a > 0."""
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 1.0, 0.0
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + c)
        r, q = p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * z * z).sum() + 1e-6, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-6]])
        d = np.linalg.solve(h, np.array([(r * z).sum(), r.sum()]))
        a, c = a - float(np.clip(d[0], -1, 1)), c - float(np.clip(d[1], -1, 1))
    return max(a, 1e-3), c
