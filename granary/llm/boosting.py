"""Gradient-boosted trees for a yes-or-no target, on small numeric tables."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Log-loss boosting of depth-limited trees over quantile bins. Trees are full: a node's children are 2i + 1 and 2i + 2."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, smooth: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.smooth = trees, depth, rate, bins, smooth

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], 1)
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score, self.model = np.full(len(y), self.start), []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            feature, cut, value, at = self._tree(binned, y - p, p * (1 - p))
            score += value[at]
            self.model.append((feature, np.array([self.edges[f][c] if f >= 0 and c < len(self.edges[f]) else np.inf for f, c in zip(feature, cut, strict=True)]), value))
        return self

    def _tree(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        inner, total, lam = 2**self.depth - 1, 2 ** (self.depth + 1) - 1, self.smooth
        feature, cut, value, at = np.full(inner, -1), np.zeros(inner, int), np.zeros(total), np.zeros(len(g), int)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = (1e-6, -1, 0)
            if len(rows) > 20:
                gs, hs = g[rows], h[rows]
                whole = gs.sum() ** 2 / (hs.sum() + lam)
                for f in range(binned.shape[1]):
                    n = len(self.edges[f]) + 1
                    gl, hl = (np.cumsum(np.bincount(binned[rows, f], w, n))[:-1] for w in (gs, hs))
                    if not len(gl):
                        continue
                    gain = gl**2 / (hl + lam) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + lam) - whole
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (gain[i], f, i)
            feature[node], cut[node] = best[1], best[2]
            right = binned[rows, best[1]] > best[2] if best[1] >= 0 else np.zeros(len(rows), bool)
            at[rows] = 2 * node + 1 + right
        for leaf in range(inner, total):
            rows = at == leaf
            value[leaf] = self.rate * g[rows].sum() / (h[rows].sum() + lam)
        return feature, cut, value, at

    def probability(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, value in self.model:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[at]
                at = 2 * at + 1 + ((f >= 0) & (x[rows, f] > threshold[at]))
            score += value[at]
        return 1 / (1 + np.exp(-score))
