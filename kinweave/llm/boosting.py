"""Gradient-boosted regression trees for a binary label, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic loss, Newton leaves, splits at quantiles. Small by design: it is trained on the driver and sent to tasks."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 24, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2
        self.made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p) + 1e-9
            feature, cut, leaf = np.zeros(1 << self.depth, int), np.full(1 << self.depth, np.inf), np.zeros(1 << self.depth)
            node = np.ones(len(y), int)
            for level in range(self.depth):
                for k in range(1 << level, 2 << level):
                    rows = np.flatnonzero(node == k)
                    if len(rows) < 20:
                        continue
                    best = (1e-6, 0, np.inf)
                    total_g, total_h = g[rows].sum(), h[rows].sum()
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        left_g = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
                        left_h = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
                        gain = left_g**2 / (left_h + self.l2) + (total_g - left_g) ** 2 / (total_h - left_h + self.l2) - total_g**2 / (total_h + self.l2)
                        i = int(gain.argmax())
                        if gain[i] > best[0]:
                            best = (gain[i], j, c[i])
                    feature[k], cut[k] = best[1:]
                node = node * 2 + (x[np.arange(len(y)), feature[node]] >= cut[node])
            node -= 1 << self.depth
            leaf = self.rate * np.bincount(node, g, len(leaf)) / (np.bincount(node, h, len(leaf)) + self.l2)
            self.made.append((feature, cut, leaf))
            score += leaf[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.made:
            node = np.ones(len(x), int)
            for _ in range(self.depth):
                node = node * 2 + (x[rows, feature[node]] >= cut[node])
            score += leaf[node - (1 << self.depth)]
        return 1 / (1 + np.exp(-score))
