"""Gradient-boosted trees for logistic loss: fitted with numpy, applied in numpy or as a Spark column expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Boosted:
    """Trees of one depth as level-order arrays: of each tree the features and thresholds of its inner nodes, and its leaf values."""

    bias: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    @property
    def depth(self) -> int:
        return int(self.leaf.shape[1]).bit_length() - 1

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (len(v) - 1)]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))

    def column(self, features: list[Column]) -> Column:
        """The raw score (log-odds) over feature columns."""

        def tree(f, t, v, node=0) -> Column:
            if node >= len(f):
                return F.lit(float(v[node - len(f)]))
            a, b = (tree(f, t, v, 2 * node + k) for k in (1, 2))
            return F.when(features[f[node]] > F.lit(float(t[node])), b).otherwise(a)

        out = F.lit(float(self.bias))
        for f, t, v in zip(self.feature.tolist(), self.threshold.tolist(), self.leaf.tolist(), strict=True):
            out = out + tree(f, t, v)
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0, weight: np.ndarray | None = None) -> Boosted:
    """Second-order boosting over quantile bins; the same data give the same model."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    w = np.ones(len(y)) if weight is None else weight
    cuts = []
    for j in range(x.shape[1]):
        u = np.unique(x[:, j])
        mid = (u[1:] + u[:-1]) / 2
        cuts.append(mid if len(mid) < bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])))
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1) if x.shape[1] else np.zeros((len(x), 0), int)
    p0 = np.clip((w * y).sum() / w.sum(), 1e-3, 1 - 1e-3)
    bias = float(np.log(p0 / (1 - p0)))
    z = np.full(len(y), bias)
    inner, leaves = 2**depth - 1, 2**depth
    fs, ts, vs = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g, h = w * (p - y), w * np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                k = (node - base) * (len(c) + 1) + code[:, j]
                gs = np.bincount(k, g, width * (len(c) + 1)).reshape(width, -1)
                hs = np.bincount(k, h, width * (len(c) + 1)).reshape(width, -1)
                gl, hl = np.cumsum(gs, 1)[:, :-1], np.cumsum(hs, 1)[:, :-1]
                gt, ht = gs.sum(1)[:, None], hs.sum(1)[:, None]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                for n in np.flatnonzero(top > best + 1e-9):
                    best[n], feature[base + n], threshold[base + n] = top[n], j, c[at[n]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        node -= inner
        value = -rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + ridge)
        z += value[node]
        fs.append(feature)
        ts.append(threshold)
        vs.append(value)
    return Boosted(bias, np.array(fs), np.array(ts), np.array(vs))


def threshold_for(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score from which on the precision is reached; above all scores if none does."""
    order = np.argsort(-score, kind="stable")
    s, good = score[order], np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ends = np.append(s[1:] != s[:-1], True)
    ok = np.flatnonzero(ends & (good >= precision))
    return float(s[ok[-1]]) if len(ok) else float("inf")
