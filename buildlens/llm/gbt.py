"""Gradient-boosted regression trees for two classes, fitted on bounded samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """A binary tree in arrays; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while (inner := self.feature[at] >= 0).any():
            f = np.maximum(self.feature[at], 0)
            go = np.where(x[np.arange(len(x)), f] <= self.cut[at], self.left[at], self.right[at])
            at = np.where(inner, go, at)
        return self.value[at]


def grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, ridge: float = 1.0, least: int = 5) -> Tree:
    """A regression tree on gradients and Hessians.

    bins has, for every row and feature, how many of the feature's cuts lie below the
    value; one histogram over all features finds the best cut of a node.
    """
    width = np.array([len(t) + 1 for t in cuts])
    base = np.concatenate([[0], np.cumsum(width)])
    feature_of = np.repeat(np.arange(len(cuts)), width)
    last = np.zeros(base[-1], dtype=bool)
    last[base[1:] - 1] = True
    f, c, lo, hi, v = [], [], [], [], []

    def node(rows: np.ndarray, d: int) -> int:
        k = len(f)
        gs, hs = g[rows].sum(), h[rows].sum()
        for a, z in ((f, -1), (c, 0.0), (lo, 0), (hi, 0), (v, -gs / (hs + ridge))):
            a.append(z)
        if d == depth or len(rows) < 2 * least:
            return k
        at = (bins[rows] + base[:-1]).ravel()
        sums = []
        for w in (g[rows], h[rows], np.ones(len(rows))):
            cell = np.cumsum(np.bincount(at, np.repeat(w, len(cuts)), base[-1]))
            sums.append(cell - np.concatenate([[0.0], cell])[base[:-1]][feature_of])
        gl, hl, nl = sums
        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
        gain[last | (nl < least) | (len(rows) - nl < least)] = 0
        i = int(gain.argmax())
        if gain[i] > 1e-6:
            j, q = int(feature_of[i]), int(i - base[feature_of[i]])
            f[k], c[k] = j, float(cuts[j][q])
            go = bins[rows, j] <= q
            lo[k] = node(rows[go], d + 1)
            hi[k] = node(rows[~go], d + 1)
        return k

    node(np.arange(len(bins)), 0)
    return Tree(np.array(f), np.array(c), np.array(lo), np.array(hi), np.array(v))


def boost(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float = 0.2) -> tuple[float, list[Tree]]:
    """Logistic gradient boosting: (first score, trees whose values have the rate in them)."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    raw = np.full(len(y), base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33))[:-1]) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(t, x[:, j], side="left") for j, t in enumerate(cuts)], axis=1)
    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        t = grow(bins, p - y, p * (1 - p), cuts, depth)
        t.value = t.value * rate
        raw += t.predict(x)
        out.append(t)
    return base, out


def raw_scores(base: float, trees: list[Tree], x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), base)
    for t in trees:
        out += t.predict(x)
    return out
