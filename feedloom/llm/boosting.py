"""Gradient-boosted trees for a binary label, in numpy: histogram splits, logistic loss."""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 24, least: float = 4.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.model: list = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> "Boosted":
        n, d = x.shape
        # between all values where there are few, so that a rare one can be told apart
        values = [np.unique(x[:, j]) for j in range(d)]
        self.edges = [v[1:] if len(v) <= self.bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j, v in enumerate(values)]
        codes = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)
        # rows that fall together count as one of that weight
        codes, place = np.unique(codes.astype(np.int32), axis=0, return_inverse=True)
        place = place.ravel()
        weights = np.ones(n) if weights is None else weights
        share = np.clip((weights * y).sum() / weights.sum(), 1e-3, 1 - 1e-3)
        weight, y = np.bincount(place, weights), np.bincount(place, weights * y)
        n, start = len(codes), np.concatenate([[0], np.cumsum([len(e) + 1 for e in self.edges])])
        flat = codes + start[:-1]
        self.start = float(np.log(share / (1 - share)))
        f = np.full(n, self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = weight * p - y, weight * p * (1 - p)
            tree = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
            at = np.zeros(n, np.int64)
            for node in range(2**self.depth - 1):
                rows = np.flatnonzero(at == node)
                best = (0.0, -1, 0)
                if weight[rows].sum() >= 8:
                    at_once = flat[rows].ravel()
                    all_g, all_h = (np.bincount(at_once, np.repeat(v[rows], d), start[-1]) for v in (g, h))
                    total_g, total_h = g[rows].sum(), h[rows].sum()
                    base = total_g**2 / (total_h + 1)
                    for j in range(d):
                        if not len(self.edges[j]):
                            continue
                        cg, ch = (np.cumsum(v[start[j] : start[j + 1] - 1]) for v in (all_g, all_h))
                        gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - base
                        gain[(ch < 0.05 * self.least) | (total_h - ch < 0.05 * self.least)] = 0
                        top = int(gain.argmax())
                        if gain[top] > best[0] + 1e-9:
                            best = (float(gain[top]), j, top)
                if best[1] >= 0 and best[0] > 1e-3:
                    tree[node] = (best[1], float(self.edges[best[1]][best[2]]), 0.0)
                    right = codes[rows, best[1]] > best[2]
                    at[rows] = 2 * node + 1 + right
            for node in range(len(tree)):
                rows = at == node
                if rows.any() and tree[node][0] < 0:
                    value = float(-self.rate * g[rows].sum() / (h[rows].sum() + 1))
                    tree[node] = (-1, 0.0, value)
                    f[rows] += value
            self.model.append(tree)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        for tree in self.model:
            feature = np.array([t[0] for t in tree])
            cut = np.array([t[1] for t in tree])
            value = np.array([t[2] for t in tree])
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = feature[at]
                inner = j >= 0
                go = x[np.arange(len(x)), np.maximum(j, 0)] >= cut[at]
                at = np.where(inner, 2 * at + 1 + go, at)
            f += value[at]
        return 1 / (1 + np.exp(-f))
