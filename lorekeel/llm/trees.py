"""Gradient-boosted oblivious trees for a binary target, in numpy.

Every level of a tree asks one question of all rows, so a tree of depth d is d comparisons and one
look-up in 2**d leaves, and prediction runs over whole columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    feature: np.ndarray  # trees x depth
    threshold: np.ndarray  # trees x depth
    leaf: np.ndarray  # trees x 2**depth
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the positive class; ``x`` is features x rows."""
        out = np.full(x.shape[1], self.bias, np.float32)
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(x.shape[1], np.int16)
            for k in range(len(f)):
                at |= (x[f[k]] > t[k]).astype(np.int16) << k
            out += leaf[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 5, rate: float = 0.25, bins: int = 32, ridge: float = 2.0) -> Forest:
    """Fit on ``x`` (features x rows) and ``y`` in {0, 1}; deterministic. A constant target gives its prior."""
    n_feat, n = x.shape
    mean = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    bias = float(np.log(mean / (1 - mean)))
    cuts, binned = [], np.zeros((n_feat, n), np.int64)
    for f in range(n_feat):
        c = np.unique(np.quantile(x[f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0)
        cuts.append(c)
        binned[f] = np.searchsorted(c, x[f], "left")  # x > c[b] exactly when its bin is above b
    feature, threshold, leaves = [], [], []
    m = np.full(n, bias)
    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-m))
        g, h = y - p, p * (1 - p)
        at, fs, ts = np.zeros(n, np.int64), [], []
        for level in range(depth):
            size, best = 1 << level, (-1.0, 0, 0)
            for f in range(n_feat):
                if not len(cuts[f]):
                    continue
                key = at * bins + binned[f]
                gs = np.bincount(key, g, size * bins).reshape(size, bins)
                hs = np.bincount(key, h, size * bins).reshape(size, bins)
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
                gain = (gl**2 / (hl + ridge) + gr**2 / (hr + ridge)).sum(0)[: len(cuts[f])]
                b = int(gain.argmax())
                if gain[b] > best[0]:
                    best = (float(gain[b]), f, b)
            _, f, b = best
            fs.append(f)
            ts.append(cuts[f][b] if len(cuts[f]) else np.inf)
            at |= (binned[f] > b).astype(np.int64) << level
        gs, hs = np.bincount(at, g, 1 << depth), np.bincount(at, h, 1 << depth)
        leaf = rate * gs / (hs + ridge)
        m += leaf[at]
        feature.append(fs)
        threshold.append(ts)
        leaves.append(leaf)
    k = len(feature)
    return Forest(np.array(feature, np.int64).reshape(k, depth), np.array(threshold, np.float32).reshape(k, depth), np.array(leaves, np.float32).reshape(k, 1 << depth), bias)
