"""Gradient-boosted trees on the driver, for bounded samples, with isotonic calibration.

A fitted model is a handful of small arrays. It scores NumPy rows, or compiles to a Spark column expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Tree:
    """A full binary tree: node k has children 2k + 1 (value <= cut) and 2k + 2. Leaves hold values."""

    feature: list[int]
    cut: list[float]
    leaf: np.ndarray

    def values(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        feature, cut = np.array(self.feature), np.array(self.cut)
        for _ in range(len(self.leaf).bit_length() - 1):
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        return self.leaf[node - len(self.feature)]

    def column(self, of: Callable[[int], Column], node: int = 0) -> Column:
        if node >= len(self.feature):
            return F.lit(float(self.leaf[node - len(self.feature)]))
        if not np.isfinite(self.cut[node]):
            return self.column(of, 2 * node + 1)
        return F.when(of(self.feature[node]) <= float(self.cut[node]), self.column(of, 2 * node + 1)).otherwise(self.column(of, 2 * node + 2))


@dataclass
class Boosted:
    prior: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    #: Steps of the calibration: margins and the probabilities from there on.
    steps: np.ndarray = field(default_factory=lambda: np.zeros(0))
    chances: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Least margin of each step.
    lows: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.prior + sum((t.values(x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Isotonic regression of the labels on the margins, by pooling adjacent violators."""
        values, place = np.unique(self.margin(x), return_inverse=True)
        blocks: list[list[float]] = []  # sum, count, first and last margin; equal margins are one point
        for v, s, n in zip(values.tolist(), np.bincount(place, y).tolist(), np.bincount(place).tolist(), strict=True):
            blocks.append([s, n, v, v])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                s, n, _, last = blocks.pop()
                blocks[-1][0] += s
                blocks[-1][1] += n
                blocks[-1][3] = last
        self.steps = np.array([(b[2] + b[3]) / 2 for b in blocks])
        self.chances = np.array([b[0] / b[1] for b in blocks])
        self.lows = np.array([b[2] for b in blocks])

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; a hundredth of the plain logistic keeps the order within a step."""
        m = self.margin(x)
        plain = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
        return plain if not len(self.steps) else 0.99 * np.interp(m, self.steps, self.chances) + 0.01 * plain

    def margin_column(self, of: Callable[[int], Column]) -> Column:
        total = F.lit(float(self.prior))
        for t in self.trees:
            total = total + t.column(of)
        return total


def _grow(x: np.ndarray, bins: list[np.ndarray], binned: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, ridge: float) -> Tree:
    feature, cut = [0] * (2**depth - 1), [np.inf] * (2**depth - 1)
    node = np.zeros(len(x), np.int64)
    for level in range(depth):
        for k in range(2**level - 1, 2 ** (level + 1) - 1):
            mine = np.flatnonzero(node == k)
            best = 1e-6
            if len(mine) >= 8:
                base = g[mine].sum() ** 2 / (h[mine].sum() + ridge)
                for f, edges in enumerate(bins):
                    if not len(edges):
                        continue
                    gs = np.cumsum(np.bincount(binned[mine, f], g[mine], len(edges) + 1))
                    hs = np.cumsum(np.bincount(binned[mine, f], h[mine], len(edges) + 1))
                    gain = gs[:-1] ** 2 / (hs[:-1] + ridge) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + ridge) - base
                    at = int(np.argmax(gain))
                    if gain[at] > best:
                        best, feature[k], cut[k] = gain[at], f, float(edges[at])
            node[mine] = 2 * k + 1 + (x[mine, feature[k]] > cut[k])
    leaf = np.zeros(2**depth)
    place = node - (2**depth - 1)
    np.add.at(gs := np.zeros(2**depth), place, g)
    np.add.at(hs := np.zeros(2**depth), place, h)
    leaf = -rate * gs / (hs + ridge)
    return Tree(feature, cut, leaf)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, n_bins: int = 32) -> Boosted:
    """Logistic loss, histogram splits."""
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(p / (1 - p))))
    bins = []
    for f in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins + 1)[1:-1]))
        bins.append(q[q < x[:, f].max()])
    binned = np.stack([np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(bins)], axis=1)
    m = np.full(len(x), model.prior)
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-m))
        t = _grow(x, bins, binned, chance - y, chance * (1 - chance), depth, rate, ridge)
        model.trees.append(t)
        m += t.values(x)
    return model
