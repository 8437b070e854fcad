"""Logistic regression on a few dense features, by Newton steps."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Intercept and weights. Features are scaled for the penalty and back."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], penalty * len(x))
    ridge[0] = 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        slope = z.T @ (y - p) - ridge * w
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[1:] / scale
    return np.concatenate([[w[0] - weights @ mean], weights])
