"""Gradient-boosted binary trees for a logistic loss over binned features, small enough to be trained on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Tree:
    """Nodes by index: feature (-1: leaf), threshold (left if value <= it), children, leaf value."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right, value = np.array(self.left), np.array(self.right), np.array(self.value)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])
        return value[at]

    def paths(self, node: int = 0, so_far: tuple = ()) -> list[tuple[tuple[int, bool, float], ...]]:
        """Conjunctions (feature, above, threshold) of the way to every node but the root."""
        own = [so_far] if so_far else []
        if self.feature[node] < 0:
            return own
        f, t = self.feature[node], self.threshold[node]
        return own + self.paths(self.left[node], (*so_far, (f, False, t))) + self.paths(self.right[node], (*so_far, (f, True, t)))


def _edges(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for k in range(x.shape[1])]


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 30, depth: int = 3, rate: float = 0.3, least: float = 3.0, ridge: float = 1.0) -> tuple[float, list[Tree]]:
    """(first score, trees); scores add up to a logit."""
    edges = _edges(x)
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1) if x.shape[1] else np.zeros((len(x), 0), int)
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    score, grown = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = Tree()
        _grow(tree, np.arange(len(y)), binned, edges, y - p, np.maximum(p * (1 - p), 1e-6), depth, least, ridge, rate)
        score += tree.predict(x)
        grown.append(tree)
    return base, grown


def _grow(tree: Tree, rows: np.ndarray, binned, edges, g, h, depth: int, least: float, ridge: float, rate: float) -> int:
    node = len(tree.feature)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    for column, value in ((tree.feature, -1), (tree.threshold, 0.0), (tree.left, -1), (tree.right, -1), (tree.value, float(rate * total_g / (total_h + ridge)))):
        column.append(value)
    if not depth or len(rows) < 2 * least:
        return node
    best, choice = 1e-6, None
    for k, e in enumerate(edges):
        if not len(e):
            continue
        own = binned[rows, k]
        sum_g, sum_h, n = (np.cumsum(np.bincount(own, weights=w, minlength=len(e) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
        gain = sum_g**2 / (sum_h + ridge) + (total_g - sum_g) ** 2 / (total_h - sum_h + ridge) - total_g**2 / (total_h + ridge)
        gain[(n < least) | (len(rows) - n < least)] = -1
        at = int(np.argmax(gain))
        if gain[at] > best:
            best, choice = gain[at], (k, at)
    if choice is None:
        return node
    k, at = choice
    below = binned[rows, k] <= at
    tree.feature[node], tree.threshold[node] = k, float(edges[k][at])
    tree.left[node] = _grow(tree, rows[below], binned, edges, g, h, depth - 1, least, ridge, rate)
    tree.right[node] = _grow(tree, rows[~below], binned, edges, g, h, depth - 1, least, ridge, rate)
    return node


def predict(model: tuple[float, list[Tree]], x: np.ndarray) -> np.ndarray:
    base, trees = model
    return 1 / (1 + np.exp(-(base + sum((t.predict(x) for t in trees), np.zeros(len(x))))))
