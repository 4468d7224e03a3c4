"""Histogram gradient-boosted trees for two classes, as flat arrays.

Trees are complete, so that a document goes down all of them with one array lookup per level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES = 80
DEPTH = 4
BINS = 64
RATE = 0.15
LEAST_HESSIAN = 5.0
PENALTY = 1.0


@dataclass(frozen=True)
class Forest:
    """`feature` and `threshold` have a row per tree and a column per inner node; node n has
    the children 2n + 1 and 2n + 2. `value` has a column per leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of features."""
        total = np.full(len(features), self.base)
        rows = np.arange(len(features))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(features), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (features[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1.0 / (1.0 + np.exp(-total))


def constant(rate: float) -> Forest:
    """A forest without trees that gives the same probability to all."""
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    inner = 2**DEPTH - 1
    empty = np.zeros((0, inner))
    return Forest(float(np.log(rate / (1 - rate))), empty.astype(np.int64), empty, np.zeros((0, inner + 1)))


def _edges(values: np.ndarray) -> np.ndarray:
    """Upper edges of the bins of one feature: its distinct quantiles."""
    edges = np.unique(np.quantile(values, np.linspace(0, 1, BINS + 1)[1:-1]))
    return edges if len(edges) else np.zeros(1)


def fitted(features: np.ndarray, labels: np.ndarray) -> Forest:
    """Trees that lower the logistic loss step by step, each grown level by level."""
    if not len(labels) or labels.min() == labels.max():
        return constant(float(labels.mean()) if len(labels) else 0.5)
    edges = [_edges(column) for column in features.T]
    # Bin b holds the values up to edge b; the last bin what is beyond all edges.
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, features.T)], axis=1)
    start = constant(float(labels.mean()))
    total = np.full(len(labels), start.base)
    inner, n_features = 2**DEPTH - 1, features.shape[1]
    made = []
    for _ in range(TREES):
        chance = 1.0 / (1.0 + np.exp(-total))
        gradient, hessian = chance - labels, chance * (1 - chance)
        feature = np.zeros(inner, dtype=np.int64)
        threshold = np.full(inner, np.inf)
        node = np.zeros(len(labels), dtype=np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            cut = np.full(width, BINS)
            place = (node - first) * BINS
            for j in range(n_features):
                at = place + binned[:, j]
                g = np.bincount(at, gradient, width * BINS).reshape(width, BINS).cumsum(axis=1)
                h = np.bincount(at, hessian, width * BINS).reshape(width, BINS).cumsum(axis=1)
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = (
                    g**2 / (h + PENALTY) + (g_all - g) ** 2 / (h_all - h + PENALTY) - g_all**2 / (h_all + PENALTY)
                )
                gain[(h < LEAST_HESSIAN) | (h_all - h < LEAST_HESSIAN)] = 0
                gain[:, len(edges[j]) :] = 0
                top = gain.argmax(axis=1)
                value = gain[np.arange(width), top]
                better = value > best + 1e-12
                best[better] = value[better]
                feature[first : first + width][better] = j
                cut[better] = top[better]
                threshold[first : first + width][better] = edges[j][top[better]]
            own = node - first
            node = 2 * node + 1 + (binned[np.arange(len(labels)), feature[node]] > cut[own])
        leaf = node - inner
        g = np.bincount(leaf, gradient, inner + 1)
        h = np.bincount(leaf, hessian, inner + 1)
        value = -RATE * g / (h + PENALTY)
        total += value[leaf]
        made.append((feature, threshold, value))
    return Forest(start.base, *(np.stack(part) for part in zip(*made)))
