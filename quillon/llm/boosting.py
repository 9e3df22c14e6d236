"""Gradient-boosted trees for two classes, over binned features."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Complete binary trees; node i has the children 2 i + 1 and 2 i + 2."""

    def __init__(self, depth: int, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, base: float):
        self.depth, self.feature, self.threshold, self.value, self.base = depth, feature, threshold, value, base

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, ridge: float = 1.0, least: int = 5) -> Boosted:
    """Newton boosting of the logistic loss, level by level, on feature quantiles."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(d)], axis=1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best, at = np.full(width, 1e-9), np.zeros((width, 2), np.int64) - 1
            for j in range(d):
                k = len(cuts[j]) + 1
                if k == 1:
                    continue
                cell = (node - first) * k + binned[:, j]
                g, h, c = (np.bincount(cell, w, width * k).reshape(width, k).cumsum(1) for w in (grad, hess, np.ones(n)))
                gl, hl, cl = g[:, :-1], h[:, :-1], c[:, :-1]
                gr, hr, cr = g[:, -1:] - gl, h[:, -1:] - hl, c[:, -1:] - cl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain[(cl < least) | (cr < least)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[np.arange(width), top][better]
                at[better] = np.stack([np.full(width, j), top], 1)[better]
            for i, (j, b) in enumerate(at.tolist()):
                if j >= 0:
                    feature[first + i], threshold[first + i] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - (2**depth - 1)
        value = -rate * np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, hess, 2**depth) + ridge)
        score += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Boosted(depth, np.array(features), np.array(thresholds), np.array(values), base)
