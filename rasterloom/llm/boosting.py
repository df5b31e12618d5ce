"""Gradient-boosted trees for a yes/no label, in numpy: small, deterministic, trained in the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class BoostedTrees:
    """Full binary trees of one depth. feature, cut: a row per tree, a column per inner node; value: a column per leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.value.shape[1]))
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += value[at - (len(value) - 1)]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 2.0) -> BoostedTrees:
    """Newton boosting of the logistic loss on histograms of quantile bins."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    offset = binned + np.arange(width) * bins
    base = float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
    total = np.full(n, base)
    features, thresholds, values = [], [], []
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (y - p), weight * p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            best = 1e-6
            if len(mine) > 1:
                o = offset[mine].ravel()
                sums = [np.bincount(o, np.repeat(v[mine], width), width * bins).reshape(width, bins).cumsum(1) for v in (g, h)]
                (gl, hl), gt, ht = (s[:, :-1] for s in sums), sums[0][:, -1:], sums[1][:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < 0.5) | (ht - hl < 0.5)] = 0
                j, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[j, b] > best and b < len(cuts[j]):
                    feature[node], cut[node] = j, cuts[j][b]
            at[mine] = 2 * node + 1 + (x[mine, feature[node]] > cut[node])
        leaf = at - inner
        gs, hs = (np.bincount(leaf, v, 2**depth) for v in (g, h))
        value = rate * gs / (hs + ridge)
        total += value[leaf]
        features.append(feature), thresholds.append(cut), values.append(value)
    return BoostedTrees(np.array(features), np.array(thresholds), np.array(values), base)
