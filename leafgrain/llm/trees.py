"""Gradient-boosted trees for a yes/no label on a bounded sample, kept as flat numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees: node i has children 2i+1 and 2i+2; a row goes right if its value exceeds the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row, all trees at once."""
        nodes = self.feature.shape[1]
        depth = (nodes + 1).bit_length() - 1
        tree = np.arange(len(self.feature))
        out = np.empty(len(x))
        for a in range(0, len(x), 4096):
            rows = x[a:a + 4096]
            at = np.zeros((len(rows), len(tree)), np.int64)
            for _ in range(depth):
                value = np.take_along_axis(rows, self.feature[tree, at], 1)
                at = 2 * at + 1 + (value > self.threshold[tree, at])
            out[a:a + 4096] = self.base + self.leaf[tree, at - nodes].sum(1)
        return out


def sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 80, depth: int = 4,
              rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Boosts logistic loss by histograms of second-order gradients.

    ``monotone`` maps a feature to +1 (the margin never falls as it grows) or -1. A split that would break a constraint
    is not taken, and the children's values stay on their side of the middle, so that later splits cannot break it.
    Without rows, or with one class only, the model is a constant.
    """
    rows, width = x.shape
    inner, leaves = 2 ** depth - 1, 2 ** depth
    share = (y.sum() + 0.5) / (rows + 1)
    base = float(np.log(share / (1 - share)))
    if not rows or y.min() == y.max():
        return Trees(np.zeros((1, inner), np.int64), np.full((1, inner), np.inf), np.zeros((1, leaves)), base)
    sign = np.zeros(width)
    for f, s in (monotone or {}).items():
        sign[f] = s
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    cut = np.full((width, bins), np.inf)
    for f, e in enumerate(edges):
        cut[f, :len(e)] = e
    code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    flat = code + np.arange(width) * bins
    margin = np.full(rows, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = sigmoid(margin)
        grad, hess = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(rows, np.int64)
        low, high = np.full(1, -np.inf), np.full(1, np.inf)
        for level in range(depth):
            count = 2 ** level
            g, h = (np.bincount((node[:, None] * (width * bins) + flat).ravel(), np.repeat(w, width), count * width * bins)
                    .reshape(count, width, bins) for w in (grad, hess))
            gl, hl = g.cumsum(2), h.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gr, hr = gt - gl, ht - hl
            limit = lambda w: np.clip(w, low[:, None, None], high[:, None, None])
            wl, wr, w0 = limit(-gl / (hl + l2)), limit(-gr / (hr + l2)), limit(-gt / (ht + l2))
            score = lambda w, a, b: -(a * w + 0.5 * (b + l2) * w * w)
            gain = score(wl, gl, hl) + score(wr, gr, hr) - score(w0, gt, ht)
            wrong = (sign[:, None] * (wr - wl) < 0) | (hl < least) | (hr < least) | ~np.isfinite(cut)
            gain[wrong] = 0
            best = gain.reshape(count, -1).argmax(1)
            take = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
            f, b = best // bins, best % bins
            at = slice(count - 1, 2 * count - 1)
            feature[at] = np.where(take, f, 0)
            threshold[at] = np.where(take, cut[f, b], np.inf)
            right = x[np.arange(rows), feature[at][node]] > threshold[at][node]
            node = 2 * node + right
            here = np.arange(count)
            middle = (wl[here, f, b] + wr[here, f, b]) / 2
            s = np.where(take, sign[f], 0)
            low, high = np.repeat(low, 2), np.repeat(high, 2)
            low[1::2] = np.where(s > 0, middle, low[1::2])
            high[0::2] = np.where(s > 0, middle, high[0::2])
            low[0::2] = np.where(s < 0, middle, low[0::2])
            high[1::2] = np.where(s < 0, middle, high[1::2])
        g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
        value = rate * np.clip(-g / (h + l2), low, high)
        margin += value[node]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base)


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit (pool adjacent violators), shrunk a little towards one half."""
    if not len(score):
        return np.array([0.0]), np.array([0.0])
    points, at = np.unique(score, return_inverse=True)
    weight, total = np.bincount(at).astype(float), np.bincount(at, y)
    pools: list[list[float]] = []
    for x, w, t in zip(points, weight, total):
        pools.append([w, t, x, x])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w1, t1, _, b1 = pools.pop()
            pools[-1][0] += w1
            pools[-1][1] += t1
            pools[-1][3] = b1
    knots = [k for w, t, a, b in pools for k in ((a, (t + 0.5) / (w + 1)), (b, (t + 0.5) / (w + 1)))]
    x, v = np.array(knots).T
    return x, np.maximum.accumulate(v)
