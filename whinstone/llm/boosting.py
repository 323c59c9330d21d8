"""Gradient-boosted trees with a logistic loss, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class BoostedTrees:
    """Complete trees of a fixed depth over binned features; splits by second-order gain."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, least: float = 4.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least
        self.start = 0.0
        self.features = np.empty((0, 2**depth - 1), np.int64)
        self.cuts = np.empty((0, 2**depth - 1))
        self.leaves = np.empty((0, 2**depth))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, d = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        width = self.bins + 1
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(p / (1 - p)))
        margin = np.full(n, self.start)
        features, cuts, leaves = [], [], []
        for _ in range(self.trees):
            q = sigmoid(margin)
            g, h = q - y, np.maximum(q * (1 - q), 1e-9)
            node = np.zeros(n, np.int64)
            f_tree, c_tree = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                k = 2**level
                best_gain, best_f, best_b = np.full(k, 1e-6), np.full(k, -1), np.zeros(k, np.int64)
                for j in range(d):
                    if not len(edges[j]):
                        continue
                    key = node * width + binned[:, j]
                    gs = np.bincount(key, weights=g, minlength=k * width).reshape(k, width).cumsum(1)
                    hs = np.bincount(key, weights=h, minlength=k * width).reshape(k, width).cumsum(1)
                    ga, ha = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (ga - gs) ** 2 / (ha - hs + self.ridge) - ga**2 / (ha + self.ridge)
                    gain[(hs < self.least * 0.05) | (ha - hs < self.least * 0.05)] = -1
                    b = gain[:, : len(edges[j])].argmax(1)
                    got = gain[np.arange(k), b]
                    better = got > best_gain
                    best_gain[better], best_f[better], best_b[better] = got[better], j, b[better]
                for i in range(k):
                    if best_f[i] >= 0:
                        f_tree[k - 1 + i], c_tree[k - 1 + i] = best_f[i], edges[best_f[i]][best_b[i]]
                f, c = f_tree[k - 1 + node], c_tree[k - 1 + node]
                node = 2 * node + (x[np.arange(n), f] > c)
            gs, hs = np.bincount(node, weights=g, minlength=2**self.depth), np.bincount(node, weights=h, minlength=2**self.depth)
            leaf = -self.rate * gs / (hs + self.ridge)
            margin += leaf[node]
            features.append(f_tree)
            cuts.append(c_tree)
            leaves.append(leaf)
        self.features, self.cuts, self.leaves = np.array(features), np.array(cuts), np.array(leaves)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for f_tree, c_tree, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, f_tree[at]] > c_tree[at])
            out += leaf[node]
        return out


class Isotonic:
    """Least-squares non-decreasing fit (pool adjacent violators); between its knots values run straight."""

    def __init__(self):
        self.x, self.y = np.array([0.0]), np.array([0.5])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        if not len(x):
            return self
        order = np.argsort(x, kind="stable")
        xs, start = np.unique(x[order], return_index=True)
        w = np.diff(np.append(start, len(x))).astype(float)
        sums = np.add.reduceat(y[order].astype(float), start)
        value, weight, count = [], [], []
        for s, n in zip(sums, w, strict=True):
            value.append(s / n)
            weight.append(n)
            count.append(1)
            while len(value) > 1 and value[-2] >= value[-1]:
                v, n2, c = value.pop(), weight.pop(), count.pop()
                value[-1] = (value[-1] * weight[-1] + v * n2) / (weight[-1] + n2)
                weight[-1] += n2
                count[-1] += c
        ends = np.cumsum(count)
        starts = ends - count
        # each block at its middle
        self.x = np.array([(xs[a] + xs[b - 1]) / 2 for a, b in zip(starts, ends, strict=True)])
        self.y = np.array(value)
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(x, self.x, self.y), 0, 1)
