"""Gradient-boosted regression trees over binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Squared-loss boosting of trees of fixed depth. Fitting is deterministic."""

    rounds: int = 160
    depth: int = 3
    rate: float = 0.1
    bins: int = 32
    least: float = 8.0
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.empty((0, len(self.edges)), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        """Fit rows of finite features to targets; constant targets or few rows give a constant."""
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self._bin(x)
        n, width = binned.shape
        self.base = float(np.average(y, weights=weight))
        rest = y - self.base
        offsets = np.arange(width) * self.bins
        for _ in range(self.rounds):
            node = np.zeros(n, np.int64)
            feature, edge = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, self.bins, np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                local = node - first
                slot = ((local * width)[:, None] * self.bins + offsets + binned).ravel()
                size = count * width * self.bins
                shape = (count, width, self.bins)
                w = np.bincount(slot, np.repeat(weight, width), size).reshape(shape).cumsum(2)
                g = np.bincount(slot, np.repeat(weight * rest, width), size).reshape(shape).cumsum(2)
                whole_w, whole_g = w[:, :, -1:], g[:, :, -1:]
                right_w, right_g = whole_w - w, whole_g - g
                gain = np.where((w >= self.least) & (right_w >= self.least), g**2 / np.maximum(w, 1e-9) + right_g**2 / np.maximum(right_w, 1e-9) - whole_g**2 / np.maximum(whole_w, 1e-9), -np.inf)
                best = gain.reshape(count, -1).argmax(1)
                splits = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
                feature[first : first + count] = np.where(splits, best // self.bins, 0)
                edge[first : first + count] = np.where(splits, best % self.bins, self.bins)
                node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > edge[node])
            leaf = node - (2**self.depth - 1)
            total = np.bincount(leaf, weight * rest, 2**self.depth)
            value = self.rate * total / (np.bincount(leaf, weight, 2**self.depth) + 1.0)
            self.trees.append((feature, edge, value))
            rest = rest - value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The fitted value of each row."""
        binned = self._bin(x)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, edge, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[rows, feature[node]] > edge[node])
            out += value[node - (2**self.depth - 1)]
        return out
