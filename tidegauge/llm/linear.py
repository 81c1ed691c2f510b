"""Logistic regression on a bounded sample that is held in memory."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.asarray(x, float) / 2))


def logistic(
    x: np.ndarray, y: np.ndarray, l2: float = 1e-3, start: np.ndarray | None = None, steps: int = 150
) -> np.ndarray:
    """Weights with the intercept last, by Nesterov's accelerated gradient from ``start``.

    With one class only, all weights are zero and the intercept is the smoothed log-odds.
    """
    n, d = x.shape
    w = np.zeros(d + 1) if start is None else start.copy()
    if n == 0 or y.min() == y.max():
        w[:] = 0
        w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)) if n else 0.0
        return w
    y = y.astype(x.dtype)
    probe = (np.ones(d) / np.sqrt(d)).astype(x.dtype)
    for _ in range(8):
        probe = x.T @ (x @ probe)
        size = np.linalg.norm(probe)
        if size == 0:
            break
        probe /= size
    step = 1.0 / (0.25 * (1.2 * size + n) / n + l2)
    ahead, momentum = w.copy(), 1.0
    for _ in range(steps):
        error = (sigmoid(margin(x, ahead)) - y).astype(x.dtype)
        slope = np.r_[x.T @ error / n + l2 * ahead[:-1], error.mean()]
        new = ahead - step * slope
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / after * (new - w)
        w, momentum = new, after
    return w


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(x.dtype) + w[-1]
