"""A logistic model of a bounded sample, fitted on the driver."""

from __future__ import annotations

import numpy as np


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[float, np.ndarray]:
    """Bias and weights by Newton steps, the weights of standardised columns pulled to zero; a column without spread has weight 0."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    scale = np.where(spread > 1e-9, spread, np.inf)
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    pull = np.r_[1e-6, np.full(x.shape[1], ridge)]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] - (w[1:] * mean / scale).sum()), w[1:] / scale
