"""Gradient-boosted decision stumps pairs for small, bounded training samples, in NumPy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic loss over regression trees of depth two, fitted on quantile bins.

    Deterministic: no sampling, ties fall to the first feature and bin. Meant for a
    sample of at most some ten thousand rows, which fits on the driver.
    """

    def __init__(self, rounds: int = 60, rate: float = 0.25, bins: int = 24, least: int = 8):
        self.rounds, self.rate, self.bins, self.least = rounds, rate, bins, least
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        mean = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        score = np.full(len(x), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
            tree = self._grow(x, grad, hess, np.ones(len(x), bool), edges, 2)
            if tree[0] == "leaf":
                break
            self.trees.append(tree)
            score += self.rate * self._value(tree, x)
        return self

    def _grow(self, x, grad, hess, mask, edges, depth):
        g, h = grad[mask].sum(), hess[mask].sum()
        leaf = ("leaf", float(g / (h + 1)))
        if depth == 0 or mask.sum() < 2 * self.least:
            return leaf
        best, gain = None, 1e-6
        base = g * g / (h + 1)
        for f, cut in enumerate(edges):
            if not len(cut):
                continue
            slot = np.searchsorted(cut, x[mask, f], side="left")
            gs, hs, ns = (np.bincount(slot, w, len(cut) + 1)[:-1].cumsum() for w in (grad[mask], hess[mask], np.ones(len(slot))))
            ok = (ns >= self.least) & (len(slot) - ns >= self.least)
            found = np.where(ok, gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - base, -1)
            k = int(found.argmax())
            if found[k] > gain:
                best, gain = (f, float(cut[k])), float(found[k])
        if best is None:
            return leaf
        low = mask & (x[:, best[0]] <= best[1])
        return ("split", *best, self._grow(x, grad, hess, low, edges, depth - 1), self._grow(x, grad, hess, mask & ~low, edges, depth - 1))

    def _value(self, tree, x):
        if tree[0] == "leaf":
            return np.full(len(x), tree[1])
        _, f, cut, low, high = tree
        return np.where(x[:, f] <= cut, self._value(low, x), self._value(high, x))

    def probability(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float64)
        score = np.full(len(x), self.start)
        for tree in self.trees:
            score += self.rate * self._value(tree, x)
        return 1 / (1 + np.exp(-score))
