"""Logistic regression on sparse rows with numpy, for samples of bounded size."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Rows:
    """Sparse rows of ones: ``feature[k]`` belongs to ``row[k]``; and a dense part."""

    def __init__(self, row: np.ndarray, feature: np.ndarray, n_rows: int, n_features: int, dense: np.ndarray):
        self.row, self.feature, self.n, self.d, self.dense = row, feature, n_rows, n_features, dense

    def times(self, w: np.ndarray) -> np.ndarray:
        sparse = np.bincount(self.row, w[self.feature], minlength=self.n)
        return sparse + self.dense @ w[self.d :]

    def back(self, g: np.ndarray) -> np.ndarray:
        sparse = np.bincount(self.feature, g[self.row], minlength=self.d)
        return np.concatenate([sparse, self.dense.T @ g])

    def only(self, keep: np.ndarray) -> "Rows":
        number = (np.cumsum(keep) - 1).astype(self.row.dtype)
        own = keep[self.row]
        return Rows(number[self.row[own]], self.feature[own], int(keep.sum()), self.d, self.dense[keep])


def descend(gradient, w: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam with a falling rate."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(x: Rows, y: np.ndarray, l2: float, steps: int = 300, rate: float = 0.05) -> np.ndarray:
    """Weights of the sparse features, then of the dense ones, the last of which is the constant."""
    penalty = np.full(x.d + x.dense.shape[1], l2 / max(1, x.n))
    penalty[-1] = 0
    return descend(lambda w: x.back(sigmoid(x.times(w)) - y) / max(1, x.n) + penalty * w, np.zeros(len(penalty)), steps, rate)
