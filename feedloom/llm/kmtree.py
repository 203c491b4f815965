"""Hierarchical k-means tree over unit vectors with best-bin-first traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, computed in double precision and returned as float32."""
    y = x.astype(np.float64)
    return (y / np.sqrt(np.einsum("ij,ij->i", y, y))[:, None]).astype(np.float32)


def spherical_kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Centres (unit rows) and the assignment of ``x``; empty centres are re-seeded from far points."""
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        score = x @ centres.T
        label = score.argmax(1)
        best = score[np.arange(len(x)), label]
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        count = np.bincount(label, minlength=k)
        for j in np.flatnonzero(count == 0):
            far = int(best.argmin())
            sums[j], best[far] = x[far], 1.0
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = sums / np.where(norm == 0, 1, norm)
    return centres, (x @ centres.T).argmax(1)


@dataclass
class Tree:
    """Flattened tree. Node 0 is the root; ``leaf[n]`` is the leaf number of node n or -1."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    @property
    def n_leaves(self) -> int:
        return int(self.leaf.max()) + 1

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, leaf_rows: int, branching: int = 16, seed: int = 7) -> "Tree":
        """Split the sample until a node stands for at most ``leaf_rows`` of the ``rows`` rows.

        A node of which all points are the same cannot be split and stays a leaf whatever its size;
        its rows are cut into blocks later.
        """
        rng = np.random.default_rng(seed)
        scale = rows / max(1, len(sample))
        centres, children, leaf, n_leaves = [np.zeros(sample.shape[1], np.float32)], [[]], [-1], 0
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, idx = todo.pop()
            size = len(idx) * scale
            label = None
            if size > leaf_rows and len(idx) >= 4:
                k = int(np.clip(np.ceil(2 * size / leaf_rows), 2, min(branching, len(idx) // 2)))
                c, label = spherical_kmeans(sample[idx], k, rng)
                if len(np.unique(label)) < 2:
                    label = None
            if label is None:
                leaf[node], n_leaves = n_leaves, n_leaves + 1
                continue
            for j in np.unique(label):
                child = len(centres)
                centres.append(c[j])
                children.append([])
                leaf.append(-1)
                children[node].append(child)
                todo.append((child, idx[label == j]))
        return cls(np.vstack(centres).astype(np.float32), children, np.array(leaf, np.int64))

    def visit(self, queries: np.ndarray, margin: float, most: int = 1 << 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best-bin-first traversal of all queries at once.

        Each query has a priority queue of open nodes, kept as one row of an array; a node's priority is
        its centre's cosine with the query, and never above that of its parent. A query pops its best
        node until the best open priority is more than ``margin`` below that of its first leaf, or
        ``most`` leaves were visited. Returns (query row, leaf, priority), in the order of the visits.
        """
        n = len(queries)
        if self.n_leaves == 1:
            return np.arange(n), np.zeros(n, np.int64), np.ones(n, np.float32)
        score = queries @ self.centres.T
        width = max(len(c) for c in self.children)
        table = np.full((len(self.children), width), -1, np.int64)
        for i, c in enumerate(self.children):
            table[i, : len(c)] = c
        cap = width * 4
        key = np.full((n, cap), -np.inf, np.float32)
        node = np.zeros((n, cap), np.int64)
        key[:, 0] = np.inf
        used = np.ones(n, np.int64)
        first = np.full(n, np.nan, np.float32)
        visits = np.zeros(n, np.int64)
        out_q, out_l, out_p = [], [], []
        live = np.arange(n)
        while len(live):
            slot = key[live].argmax(1)
            top = key[live, slot]
            go = np.isfinite(top) | (top == np.inf)
            go &= ~(top < first[live] - margin) & (visits[live] < most)
            live, slot, top = live[go], slot[go], top[go]
            if not len(live):
                break
            at = node[live, slot]
            key[live, slot] = -np.inf
            is_leaf = self.leaf[at] >= 0
            q = live[is_leaf]
            if len(q):
                out_q.append(q)
                out_l.append(self.leaf[at[is_leaf]])
                out_p.append(top[is_leaf])
                fresh = np.isnan(first[q])
                first[q[fresh]] = top[is_leaf][fresh]
                visits[q] += 1
            q, a, t = live[~is_leaf], at[~is_leaf], top[~is_leaf]
            if len(q):
                kids = table[a]
                pri = np.minimum(score[q[:, None], np.maximum(kids, 0)], t[:, None])
                pri[kids < 0] = -np.inf
                need = int(used[q].max()) + width
                if need > key.shape[1]:
                    grow = need + width * 4 - key.shape[1]
                    key = np.hstack([key, np.full((n, grow), -np.inf, np.float32)])
                    node = np.hstack([node, np.zeros((n, grow), np.int64)])
                cols = used[q][:, None] + np.arange(width)
                key[q[:, None], cols] = pri
                node[q[:, None], cols] = np.maximum(kids, 0)
                used[q] += width
        return np.concatenate(out_q), np.concatenate(out_l), np.concatenate(out_p)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The first leaf each row visits."""
        q, leaf, _ = self.visit(x, margin=0.0, most=1)
        out = np.empty(len(x), np.int64)
        out[q] = leaf
        return out
