"""Gradient boosted trees for two classes on a bounded sample, and their scores for whole batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Full binary trees: ``feature`` and ``cut`` by tree and inner node (a row goes right above the cut), ``value`` by leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(rows) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - inner]
        return out


def edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cuts between the values of each feature, at most ``bins`` - 1."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="lower"))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 5, rate: float = 0.2, bins: int = 32, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Logistic loss, second-order gains on histograms; a leaf has at least ``least`` of hessian, ties go to the first feature and cut."""
    cuts = edges(x, bins)
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)])  # a row per feature
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    score, inner, m = np.full(len(x), start), 2**depth - 1, x.shape[1]
    features, edges_, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(x), np.int64)
        for level in range(depth):
            first = 2**level - 1
            local = at - first
            nodes = 2**level
            best = np.full(nodes, 1e-9)
            split = np.full(nodes, bins)
            for f in range(m):
                slot = local * bins + binned[f]
                g = np.bincount(slot, grad, nodes * bins).reshape(nodes, bins).cumsum(axis=1)
                h = np.bincount(slot, hess, nodes * bins).reshape(nodes, bins).cumsum(axis=1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
                gain[(h < least) | (all_h - h < least)] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(nodes), top] > best + 1e-12
                best = np.where(better, gain[np.arange(nodes), top], best)
                split = np.where(better, top, split)
                feature[first : first + nodes][better] = f
            for j in range(nodes):
                if split[j] < bins:
                    cut[first + j] = cuts[feature[first + j]][split[j]]
            right = binned[feature[at], np.arange(len(x))] > split[local]
            at = 2 * at + 1 + right
        leaf = at - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        value = rate * g / (h + ridge)
        score += value[leaf]
        features.append(feature)
        edges_.append(cut)
        values.append(value)
    return Trees(np.array(features), np.array(edges_), np.array(values), start)
