"""Gradient-boosted trees on a small dense table, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Binary classification with second-order boosting over histograms of at most `bins` quantile bins.

    A tree is stored as a full binary tree of `depth` levels: feature and threshold of each inner node, value of
    each leaf. `fit` is deterministic.
    """

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, least: float = 3.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = (y.sum() + 1) / (len(y) + 20)
        self.base = float(np.log(p / (1 - p)))
        grid = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        grid = [np.unique(np.concatenate([g, [c.min()]])) if len(c) else g for g, c in zip(grid, x.T, strict=True)]
        coded = np.stack([np.searchsorted(g, c) for g, c in zip(grid, x.T, strict=True)], 1) if len(y) else np.zeros((0, x.shape[1]), int)
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            self.trees.append(tree := self.grow(coded, grid, p - y, p * (1 - p)))
            f += self.rate * self.leaf(tree, x)
        return self

    def grow(self, coded: np.ndarray, grid: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = (1 << self.depth) - 1
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(g), np.int64)
        for k in range(inner):
            here = np.flatnonzero(node == k)
            best, cut = 1e-6, None
            total_g, total_h = g[here].sum(), h[here].sum()
            for j, edges in enumerate(grid):
                if not len(edges) or not len(here):
                    continue
                left_g = np.cumsum(np.bincount(coded[here, j], g[here], len(edges) + 1))[:-1]
                left_h = np.cumsum(np.bincount(coded[here, j], h[here], len(edges) + 1))[:-1]
                gain = left_g**2 / (left_h + self.ridge) + (total_g - left_g) ** 2 / (total_h - left_h + self.ridge) - total_g**2 / (total_h + self.ridge)
                gain[(left_h < self.least / 10) | (total_h - left_h < self.least / 10)] = 0
                if gain[b := int(gain.argmax())] > best:
                    best, cut = gain[b], (j, b)
            right = np.zeros(len(here), bool)
            if cut:
                feature[k], threshold[k] = cut[0], grid[cut[0]][cut[1]]
                right = coded[here, cut[0]] > cut[1]
            node[here] = 2 * k + 1 + right
        value = -np.bincount(node - inner, g, inner + 1) / (np.bincount(node - inner, h, inner + 1) + self.ridge)
        return feature, threshold, value

    def leaf(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, threshold, value = tree
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        return value[node - len(feature)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((self.leaf(t, x) for t in self.trees), np.zeros(len(x)))


class Isotonic:
    """Least-squares rising fit of labels on raw scores (pool adjacent violators), linear between the blocks' means.

    A block's mean counts half a label of each kind besides its own, so it is never 0 or 1. Without rows the
    logistic function of the raw score stands in.
    """

    def __init__(self, raw: np.ndarray, y: np.ndarray):
        blocks: list[list[float]] = []  # rows, labels, sum of raw scores
        levels, at = np.unique(raw, return_inverse=True)
        n = np.bincount(at, minlength=len(levels))
        for r, k, s in zip(levels, n, np.bincount(at, y, len(levels)), strict=True):
            blocks.append([k, s, r * k])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        self.at = np.array([b[2] / b[0] for b in blocks])
        self.mean = np.maximum.accumulate([(b[1] + 0.5) / (b[0] + 1) for b in blocks]) if blocks else np.zeros(0)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.at, self.mean) if len(self.at) else 1 / (1 + np.exp(-raw))
