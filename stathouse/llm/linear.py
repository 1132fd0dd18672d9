"""A small regularized logistic regression for models that are fitted on bounded samples on the driver."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150, penalty: float = 1e-4, rate: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x outputs) and biases for targets y in [0, 1] (rows x outputs), by accelerated gradient descent."""
    weight = (weight / weight.sum()).astype(np.float32)
    y = y.astype(np.float32)
    top = float(np.einsum("r,rf,rf->f", weight, x, x).max() * min(x.shape[1], 64) + 1)
    rate = rate or 4.0 / top
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    w1, b1 = w.copy(), b.copy()
    for t in range(steps):
        m = np.float32(t / (t + 3))
        wy, by = w + m * (w - w1), b + m * (b - b1)
        error = (1 / (1 + np.exp(-np.clip(x @ wy + by, -30, 30))) - y) * weight[:, None]
        w1, b1 = w, b
        w, b = wy - rate * (x.T @ error + penalty * wy), by - rate * error.sum(axis=0)
    return w, b
