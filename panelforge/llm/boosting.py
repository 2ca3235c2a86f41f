"""Gradient-boosted trees for binary labels on a small bounded matrix."""

from __future__ import annotations

import numpy as np

from .calibrate import sigmoid


class BoostedTrees:
    """Complete binary trees of fixed depth over quantile-binned features,
    fitted to the logistic loss by Newton steps."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        qs = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, f], qs)) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)])
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        z = np.full(len(y), self.base)
        inner = (1 << self.depth) - 1
        for _ in range(self.rounds):
            p = sigmoid(z)
            grad, hess = y - p, p * (1 - p)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first = (1 << level) - 1
                for k in range(first, first + (1 << level)):
                    rows = np.flatnonzero(node == k)
                    best = 1e-6
                    g, h = grad[rows], hess[rows]
                    whole = g.sum() ** 2 / (h.sum() + self.ridge)
                    for f, cuts in enumerate(self.cuts):
                        if len(cuts) == 0 or len(rows) < 2:
                            continue
                        b = binned[rows, f]
                        gl = np.cumsum(np.bincount(b, weights=g, minlength=len(cuts) + 1))[:-1]
                        hl = np.cumsum(np.bincount(b, weights=h, minlength=len(cuts) + 1))[:-1]
                        gain = (gl ** 2 / (hl + self.ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + self.ridge) - whole)
                        at = int(gain.argmax())
                        if gain[at] > best:
                            best, feature[k], cut[k] = gain[at], f, cuts[at]
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            leaf = node - inner
            g = np.bincount(leaf, weights=grad, minlength=inner + 1)
            h = np.bincount(leaf, weights=hess, minlength=inner + 1)
            value = self.rate * g / (h + self.ridge)
            self.trees.append((feature, cut, value))
            z += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            z += value[node - len(feature)]
        return sigmoid(z)
