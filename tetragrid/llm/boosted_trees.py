"""Gradient-boosted trees with monotonic constraints, flattened into node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees as arrays (trees, nodes): a node compares feature with threshold and goes to left or right; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds for each row of x; all rows walk down a tree together."""
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for feature, threshold, left, right, value in zip(self.feature, self.threshold, self.left, self.right, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = np.where(x[row, feature[node]] <= threshold[node], left[node], right[node])
            out += value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least_weight: float = 1.0, ridge: float = 1.0) -> Forest:
    """Boosts the logistic loss; monotone has +1, -1 or 0 for each feature.

    Candidate splits that would break a constraint are passed over, and a
    constrained split bounds the values below it by the middle of its two sides,
    so the sum of all trees is monotonic too.
    """
    rows, features = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(features)]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    width = max(len(c) for c in cuts) + 1
    nodes = 2 ** (depth + 1) - 1
    shape = (trees, nodes)
    forest = Forest(np.zeros(shape, np.int64), np.zeros(shape), np.tile(np.arange(nodes), (trees, 1)), np.tile(np.arange(nodes), (trees, 1)), np.zeros(shape), 0.0, depth)
    rate0 = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    forest.base = float(np.log(rate0 / (1 - rate0)))
    margin = np.full(rows, forest.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        todo = [(0, np.arange(rows), -np.inf, np.inf, 0)]
        while todo:
            node, own, low, high, level = todo.pop()
            g, h = grad[own].sum(), hess[own].sum()
            value = float(np.clip(-g / (h + ridge), low, high))
            split = None if level == depth else _best_split(codes[own], grad[own], hess[own], cuts, width, monotone, ridge, least_weight, low, high)
            if split is None:
                forest.value[t, node] = rate * value
                margin[own] += rate * value
                continue
            f, cut, lo_value, hi_value = split
            forest.feature[t, node], forest.threshold[t, node] = f, cuts[f][cut]
            forest.left[t, node], forest.right[t, node] = 2 * node + 1, 2 * node + 2
            goes = codes[own, f] <= cut
            middle = (lo_value + hi_value) / 2
            below, above = (low, high), (low, high)
            if monotone[f] > 0:
                below, above = (low, middle), (middle, high)
            elif monotone[f] < 0:
                below, above = (middle, high), (low, middle)
            todo += [(2 * node + 1, own[goes], *below, level + 1), (2 * node + 2, own[~goes], *above, level + 1)]
    return forest


def _best_split(codes, grad, hess, cuts, width, monotone, ridge, least_weight, low, high):
    best, found = 1e-9, None
    for f, own_cuts in enumerate(cuts):
        n = len(own_cuts)
        if not n:
            continue
        g = np.bincount(codes[:, f], grad, width)[: n + 1].cumsum()
        h = np.bincount(codes[:, f], hess, width)[: n + 1].cumsum()
        gl, hl, gr, hr = g[:-1], h[:-1], g[-1] - g[:-1], h[-1] - h[:-1]
        vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
        parent = np.clip(-g[-1] / (h[-1] + ridge), low, high)
        loss = lambda g, h, v: g * v + 0.5 * (h + ridge) * v * v
        gain = loss(g[-1], h[-1], parent) - loss(gl, hl, vl) - loss(gr, hr, vr)
        ok = (hl >= least_weight) & (hr >= least_weight) & (monotone[f] * (vr - vl) >= 0)
        gain = np.where(ok, gain, -np.inf)
        at = int(gain.argmax())
        if gain[at] > best:
            best, found = gain[at], (f, at, float(vl[at]), float(vr[at]))
    return found
