"""Gradient-boosted trees for two classes on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    """Complete trees of one depth: at node k of a tree, go to 2k+2 if the feature exceeds the threshold, else to 2k+1."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(x) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - inner]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 2.0) -> Boosted:
    """Second-order boosting of the logistic loss; splits lie between quantiles of each feature. Ties: the lowest feature and cut."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    coded = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    share = float(np.average(y, weights=weight))
    start = float(np.log(share / (1 - share)))
    total, inner = np.full(len(x), start), 2**depth - 1
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = (y - p) * weight, p * (1 - p) * weight
        at = np.zeros(len(x), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best, gains = [None] * width, np.full(width, 1e-9)
            local = at - first
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                size = len(c) + 1
                key = local * size + coded[:, f]
                g = np.bincount(key, grad, width * size).reshape(width, size).cumsum(axis=1)
                h = np.bincount(key, hess, width * size).reshape(width, size).cumsum(axis=1)
                left, lh, all_g, all_h = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = left**2 / (lh + ridge) + (all_g - left) ** 2 / (all_h - lh + ridge) - all_g**2 / (all_h + ridge)
                k = gain.argmax(axis=1)
                for n in np.flatnonzero(gain[np.arange(width), k] > gains + 1e-12):
                    gains[n], best[n] = gain[n, k[n]], (f, c[k[n]])
            for n, found in enumerate(best):
                if found:
                    feature[first + n], threshold[first + n] = found
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
        slot = at - inner
        leaf = rate * np.bincount(slot, grad, inner + 1) / (np.bincount(slot, hess, inner + 1) + ridge)
        total = total + leaf[slot]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Boosted(np.array(features), np.array(thresholds), np.array(leaves), start)
