"""Gradient-boosted trees for a few classes, in NumPy: histograms, logistic loss."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """One margin per class; trees are complete, so that a row's leaf is found level by level."""

    def __init__(self, classes: int, rounds: int = 30, depth: int = 4, rate: float = 0.3, least: int = 8):
        self.classes, self.rounds, self.depth, self.rate, self.least = classes, rounds, depth, rate, least
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1).astype(np.int64)
        margin = np.zeros((len(x), self.classes))
        for _ in range(self.rounds):
            p = np.exp(margin - margin.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            round_ = []
            for c in range(self.classes):
                g, h = (y == c) - p[:, c], np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)
                tree, leaf = self._tree(binned, edges, g, h)
                margin[:, c] += tree[2][leaf]
                round_.append(tree)
            self.trees.append(round_)
        return self

    def _tree(self, binned, edges, g, h):
        n, width = binned.shape
        feature, cut = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, np.inf)
        node = np.zeros(n, np.int64)
        offsets = np.arange(width) * BINS
        for level in range(self.depth):
            base, nodes = (1 << level) - 1, 1 << level
            key = ((node - base)[:, None] * width * BINS + offsets + binned).ravel()
            size = nodes * width * BINS
            sums = [np.bincount(key, np.repeat(v, width), size).reshape(nodes, width, BINS).cumsum(2) for v in (g, h, np.ones(n))]
            (gl, hl, nl), (gt, ht, nt) = sums, [s[:, :1, -1:] for s in sums]
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(nl < self.least) | (nt - nl < self.least)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for k in range(nodes):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[base + k], cut[base + k] = j, edges[j][b]
            split = np.array([np.searchsorted(edges[feature[base + k]], cut[base + k]) if np.isfinite(cut[base + k]) else BINS for k in range(nodes)])
            here = node - base
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > split[here])
        leaf = node - ((1 << self.depth) - 1)
        value = self.rate * np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + 1)
        return (feature, cut.astype(np.float32), value), leaf

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.classes))
        rows = np.arange(len(x))
        for round_ in self.trees:
            for c, (feature, cut, value) in enumerate(round_):
                node = np.zeros(len(x), np.int64)
                for _ in range(self.depth):
                    node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
                out[:, c] += value[node - len(feature)]
        return out
