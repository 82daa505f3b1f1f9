"""Small gradient-boosted trees and isotonic calibration in numpy, for dense features of bounded samples."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Tree:
    """A full binary tree: split feature and threshold of the inner nodes, values of the leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while node.size and node[0] < len(self.feature):
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.threshold[node])
        return self.value[node - len(self.feature)]


@dataclass
class Boosted:
    """Sum of trees on the log-odds scale."""

    base: float
    trees: list[Tree] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.predict(x)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _grow(codes, edges, grad, hess, depth: int, rate: float, reg: float) -> Tree:
    inner = 2**depth - 1
    feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(grad), np.int64)
    n_features = codes.shape[1]
    for level in range(depth):
        first, width = 2**level - 1, 2**level
        at = node - first
        for j in range(n_features):
            slot = at * BINS + codes[:, j]
            g = np.bincount(slot, grad, width * BINS).reshape(width, BINS).cumsum(1)
            h = np.bincount(slot, hess, width * BINS).reshape(width, BINS).cumsum(1)
            total_g, total_h = g[:, -1:], h[:, -1:]
            gain = g**2 / (h + reg) + (total_g - g) ** 2 / (total_h - h + reg) - total_g**2 / (total_h + reg)
            gain[:, len(edges[j]) :] = -np.inf
            best = gain.argmax(1)
            score = gain[np.arange(width), best]
            if j == 0:
                top, cut = np.full(width, 1e-9), np.full(width, -1)
            better = score > top
            top[better], cut[better] = score[better], best[better]
            feature[first : first + width][better] = j
        for k in range(width):
            if cut[k] >= 0:
                threshold[first + k] = edges[feature[first + k]][cut[k]]
        chosen = feature[node]
        split = np.where(cut[at] >= 0, cut[at], BINS)
        node = 2 * node + 1 + (codes[np.arange(len(node)), chosen] > split)
    leaf = node - inner
    g = np.bincount(leaf, grad, inner + 1)
    h = np.bincount(leaf, hess, inner + 1)
    return Tree(feature, threshold, rate * -g / (h + reg))


def fit_boosted(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, reg: float = 1.0
) -> Boosted:
    """Logistic boosting on quantile bins."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))[: BINS - 1] for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    share = np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6)
    model = Boosted(float(np.log(share / (1 - share))))
    raw = np.full(len(x), model.base)
    for _ in range(trees):
        p = sigmoid(raw)
        tree = _grow(codes, edges, weight * (p - y), weight * np.maximum(p * (1 - p), 1e-9), depth, rate, reg)
        model.trees.append(tree)
        raw += tree.predict(x)
    return model


def fit_isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of the nondecreasing fit of ``y`` on ``score`` (interpolate between them)."""
    order = np.argsort(score, kind="stable")
    values: list[list[float]] = []  # mean, weight, first score, last score
    for s, t, w in zip(score[order], y[order].astype(float), weight[order].astype(float)):
        if values and values[-1][3] == s:
            last = values[-1]
            last[0] = (last[0] * last[1] + t * w) / (last[1] + w)
            last[1] += w
        else:
            values.append([t, w, s, s])
        while len(values) > 1 and values[-2][0] >= values[-1][0]:
            b, a = values.pop(), values[-1]
            a[0] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1])
            a[1] += b[1]
            a[3] = b[3]
    knots = [(v[k], v[0]) for v in values for k in ((2, 3) if v[2] < v[3] else (2,))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])
