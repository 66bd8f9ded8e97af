"""Gradient-boosted trees of depth three for yes/no labels, small enough to be sent with tasks."""

from __future__ import annotations

import numpy as np

DEPTH = 3


class Boost:
    """Logistic loss; splits are searched over quantile bins; leaves are shrunk Newton steps."""

    def __init__(self, trees: int = 40, rate: float = 0.25, bins: int = 24, ridge: float = 1.0):
        self.trees, self.rate, self.bins, self.ridge = trees, rate, bins, ridge
        self.made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boost:
        n, width = x.shape
        weight = np.ones(n) if weight is None else weight * (n / weight.sum() if n else 1)
        share = min(max(float((y * weight).mean()) if n else 0.0, 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        if n == 0 or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
        score = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = (y - p) * weight, p * (1 - p) * weight
            feature, cut = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, np.inf)
            node = np.zeros(n, int)
            for level in range(DEPTH):
                first, many = 2**level - 1, 2**level
                best = np.full(many, 1e-6)
                at = node - first
                for f in range(width):
                    size = len(cuts[f]) + 1
                    if size == 1:
                        continue
                    index = at * size + binned[:, f]
                    gs = np.bincount(index, g, many * size).reshape(many, size).cumsum(1)
                    hs = np.bincount(index, h, many * size).reshape(many, size).cumsum(1)
                    gain = gs**2 / (hs + self.ridge) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + self.ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.ridge)
                    k = gain[:, :-1].argmax(1)
                    top = gain[np.arange(many), k]
                    for m in np.flatnonzero(top > best):
                        best[m], feature[first + m], cut[first + m] = top[m], f, cuts[f][k[m]]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
            leaf = node - (2**DEPTH - 1)
            step = self.rate * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + self.ridge)
            self.made.append((feature, cut, step))
            score += step[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of yes for each row."""
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, step in self.made:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            score += step[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-score))

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Limits of the probability of yes for rows whose features are only known to lie between `low` and `high`."""
        least, most = np.full(len(low), self.base), np.full(len(low), self.base)
        inner = 2**DEPTH - 1
        for feature, cut, step in self.made:
            reach = np.zeros((len(low), 2 * inner + 1), bool)
            reach[:, 0] = True
            for node in range(inner):
                reach[:, 2 * node + 1] = reach[:, node] & (low[:, feature[node]] <= cut[node])
                reach[:, 2 * node + 2] = reach[:, node] & (high[:, feature[node]] > cut[node])
            leaf = reach[:, inner:]
            least += np.where(leaf, step, np.inf).min(1)
            most += np.where(leaf, step, -np.inf).max(1)
        return 1 / (1 + np.exp(-least)), 1 / (1 + np.exp(-most))
