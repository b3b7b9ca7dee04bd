"""Gradient boosting with symmetric trees: fitted on a bounded sample, applied as one Catalyst expression.

A symmetric tree asks the same question of all nodes of a level, so a tree is `depth` (feature, cut) pairs
and 2**depth leaf values, and a whole model is one literal array that a built-in `aggregate` folds over."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Boosted:
    base: float
    trees: tuple[tuple[tuple[int, ...], tuple[float, ...], tuple[float, ...]], ...]  # features, cuts, leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for features, cuts, leaves in self.trees:
            at = np.zeros(len(x), dtype=int)
            for d, (f, c) in enumerate(zip(features, cuts, strict=True)):
                at += (x[:, f] > c).astype(int) << d
            out += np.asarray(leaves)[at]
        return out

    def column(self, features: Column) -> Column:
        """The margin as an expression over an array<double>."""
        trees = F.array(*(F.struct(F.array(*map(F.lit, f)).alias("f"), F.array(*map(F.lit, c)).alias("c"), F.array(*map(F.lit, v)).alias("v")) for f, c, v in self.trees))
        depth = len(self.trees[0][0]) if self.trees else 0

        def leaf(t: Column) -> Column:
            at = F.lit(1)
            for d in range(depth):
                at = at + F.when(F.get(features, F.get(t["f"], F.lit(d))) > F.get(t["c"], F.lit(d)), F.lit(1 << d)).otherwise(F.lit(0))
            return F.element_at(t["v"], at)

        return F.aggregate(trees, F.lit(self.base), lambda acc, t: acc + leaf(t)) if self.trees else F.lit(self.base)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 16, l2: float = 1.0) -> Boosted:
    """Logistic loss, second-order gains, quantile cuts. y of one class gives a constant model."""
    n = len(y)
    p = min(max(y.mean() if n else 0.5, 0.01), 0.99)
    base = float(np.log(p / (1 - p)))
    if n == 0 or y.min() == y.max():
        return Boosted(base, ())
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    cuts = [c if len(c) else np.array([0.5]) for c in cuts]
    binned = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]  # x > c[i]  <=>  bin > i
    margin, out = np.full(n, base), []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h, node = y - q, q * (1 - q), np.zeros(n, dtype=int)
        chosen: list[tuple[int, int]] = []
        for d in range(depth):
            best = (-1.0, 0, 0)
            for j, b in enumerate(binned):
                k = len(cuts[j]) + 1
                gs = np.bincount(node * k + b, g, minlength=k << d).reshape(-1, k).cumsum(1)
                hs = np.bincount(node * k + b, h, minlength=k << d).reshape(-1, k).cumsum(1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = (gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2)).sum(0)
                i = int(gain.argmax())
                if gain[i] > best[0] + 1e-12:
                    best = (float(gain[i]), j, i)
            chosen.append(best[1:])
            node += (binned[best[1]] > best[2]).astype(int) << d
        gs, hs = np.bincount(node, g, minlength=1 << depth), np.bincount(node, h, minlength=1 << depth)
        leaves = rate * gs / (hs + l2)
        margin += leaves[node]
        out.append((tuple(j for j, _ in chosen), tuple(float(cuts[j][i]) for j, i in chosen), tuple(map(float, leaves))))
    return Boosted(base, tuple(out))


def calibrated(margin: np.ndarray, y: np.ndarray, precision: float, floor: float = float("-inf")) -> float:
    """The lowest threshold, of the held-out margins that are `floor` or more, at which what passes has the precision; infinite if
    there is none. Equal margins pass together."""
    order = np.argsort(-margin, kind="stable")
    m, good = margin[order], np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(m[1:] != m[:-1], True) if len(m) else np.zeros(0, dtype=bool)
    ok = np.flatnonzero(last & (good >= precision) & (m >= floor))
    return float(m[ok[-1]]) if len(ok) else float("inf")


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b): 1 / (1 + exp(-(a margin + b))) is the chance of y on held-out margins (Platt, 1999, with his smoothed targets)."""
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p) - 1e-6 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def auc(margin: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve; ties count half."""
    _, at, n = np.unique(margin, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    n1 = y.sum()
    return float((rank[y > 0].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))) if 0 < n1 < len(y) else float("nan")
