"""Logistic regression on small samples of sparse rows."""

from __future__ import annotations

import numpy as np


def fit(
    rows: list[np.ndarray], labels: np.ndarray, dims: int, epochs: int = 12, rate: float = 0.2, l2: float = 1e-5
) -> np.ndarray:
    """Weights of ``dims`` indicator features and, last, the intercept (AdaGrad, fixed order).

    Each row lists the features it has. Without rows all weights are zero.
    """
    w, g = np.zeros(dims + 1), np.full(dims + 1, 1e-8)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at = np.append(rows[i], dims)
            miss = 1 / (1 + np.exp(-np.clip(w[at].sum(), -30, 30))) - labels[i]
            step = miss + l2 * w[at]
            g[at] += step * step
            w[at] -= rate * step / np.sqrt(g[at])
    return w


def logit(p: float) -> float:
    return float(np.log(p / (1 - p)))
