"""Gradient-boosted trees for a few classes, on binned features, in arrays."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Softmax boosting: each round adds one tree of fixed depth per class."""

    def __init__(self, classes: int, rounds: int = 40, depth: int = 4, bins: int = 32, rate: float = 0.25, damping: float = 1.0, least: float = 2.0) -> None:
        self.classes, self.rounds, self.depth, self.bins, self.rate, self.damping, self.least = classes, rounds, depth, bins, rate, damping, least

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """``x``: rows of features; ``y``: class numbers."""
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])).astype(np.float32) for c in x.T]
        b, (n, width) = self._binned(x), x.shape
        flat = b + np.arange(width) * self.bins
        prior = np.bincount(y, minlength=self.classes) + 1.0
        self.base = np.log(prior / prior.sum())
        score = np.tile(self.base, (n, 1))
        inner, leaves = (1 << self.depth) - 1, 1 << self.depth
        self.feature = np.zeros((self.rounds, self.classes, inner), np.int16)
        self.cut = np.full((self.rounds, self.classes, inner), np.inf, np.float32)
        self.value = np.zeros((self.rounds, self.classes, leaves), np.float32)
        for r in range(self.rounds):
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for c in range(self.classes):
                grad, hess = p[:, c] - (y == c), p[:, c] * (1 - p[:, c]) + 1e-9
                node = np.zeros(n, np.int64)
                for level in range(self.depth):
                    wide, first = 1 << level, (1 << level) - 1
                    at = (flat + node[:, None] * (width * self.bins)).ravel()
                    shape = (wide, width, self.bins)
                    g = np.bincount(at, np.repeat(grad, width), wide * width * self.bins).reshape(shape).cumsum(axis=2)
                    h = np.bincount(at, np.repeat(hess, width), wide * width * self.bins).reshape(shape).cumsum(axis=2)
                    gain = self._worth(g, h) + self._worth(g[..., -1:] - g, h[..., -1:] - h) - self._worth(g[..., -1:], h[..., -1:])
                    gain[(h < self.least) | (h[..., -1:] - h < self.least)] = 0
                    for k in range(wide):
                        f, t = divmod(int(gain[k].argmax()), self.bins)
                        if gain[k, f, t] > 1e-6 and t < len(self.edges[f]):
                            self.feature[r, c, first + k], self.cut[r, c, first + k] = f, self.edges[f][t]
                    node = 2 * node + (x[np.arange(n), self.feature[r, c, first + node]] > self.cut[r, c, first + node])
                g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
                self.value[r, c] = -self.rate * g / (h + self.damping)
                score[:, c] += self.value[r, c, node]
        return self

    def _worth(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return g * g / (h + self.damping)

    def log_proba(self, x: np.ndarray) -> np.ndarray:
        """Log probability of each class for each row."""
        n = len(x)
        score = np.tile(self.base, (n, 1))
        rows = np.ascontiguousarray(x, np.float32).ravel()
        start = np.arange(n) * x.shape[1]
        for r in range(self.rounds):
            for c in range(self.classes):
                feature, cut, node = self.feature[r, c].astype(np.int64), self.cut[r, c], np.zeros(n, np.int64)
                for _ in range(self.depth):
                    node = 2 * node + 1 + (rows[start + feature[node]] > cut[node])
                score[:, c] += self.value[r, c][node - (1 << self.depth) + 1]
        score -= score.max(axis=1, keepdims=True)
        return score - np.log(np.exp(score).sum(axis=1, keepdims=True))
