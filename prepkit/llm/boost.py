"""Gradient-boosted trees on weighted rows, small enough for the driver, with scores as Spark columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Trees:
    """``trees`` are nested (feature, threshold, left, right) or leaf values; a row goes left where value <= threshold."""

    bias: float
    trees: list

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for tree in self.trees:
            _descend(tree, x, np.arange(len(x)), total)
        return 1 / (1 + np.exp(-total))

    def column(self, features: Sequence[Column]) -> Column:
        """The probability as an expression over feature columns that are not null."""
        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + _column(tree, features)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _descend(tree, x, rows, total) -> None:
    if not isinstance(tree, tuple):
        total[rows] += tree
        return
    feature, threshold, left, right = tree
    goes = x[rows, feature] <= threshold
    _descend(left, x, rows[goes], total)
    _descend(right, x, rows[~goes], total)


def _column(tree, features) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, threshold, left, right = tree
    return F.when(features[feature] <= F.lit(float(threshold)), _column(left, features)).otherwise(_column(right, features))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 24, depth: int = 3,
          rate: float = 0.3, bins: int = 32, smoothing: float = 1.0) -> Trees:
    """Logistic loss, second-order leaves, splits at quantiles of the features. Depends on rows and order only."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    weight = np.ones(len(y)) if weight is None else np.asarray(weight, np.float64)
    if not len(y) or weight.sum() <= 0:
        return Trees(0.0, [])
    mean = np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1) if x.shape[1] else np.zeros((len(y), 0), int)
    out = Trees(float(np.log(mean / (1 - mean))), [])
    total = np.full(len(y), out.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        gradient, curve = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        tree = _grow(codes, cuts, gradient, curve, np.arange(len(y)), depth, rate, smoothing)
        out.trees.append(tree)
        _descend(tree, x, np.arange(len(y)), total)
    return out


def _grow(codes, cuts, gradient, curve, rows, depth, rate, smoothing):
    g, h = gradient[rows].sum(), curve[rows].sum()
    best = (1e-9, None, None)
    if depth and len(rows) > 1:
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            gs = np.cumsum(np.bincount(codes[rows, f], gradient[rows], len(c) + 1))[:-1]
            hs = np.cumsum(np.bincount(codes[rows, f], curve[rows], len(c) + 1))[:-1]
            gain = gs**2 / (hs + smoothing) + (g - gs) ** 2 / (h - hs + smoothing) - g**2 / (h + smoothing)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = (gain[k], f, k)
    if best[1] is None:
        return float(rate * g / (h + smoothing))
    _, f, k = best
    left = codes[rows, f] <= k
    grow = lambda r: _grow(codes, cuts, gradient, curve, r, depth - 1, rate, smoothing)
    return (f, float(cuts[f][k]), grow(rows[left]), grow(rows[~left]))
