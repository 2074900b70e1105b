"""Gradient-boosted trees for a yes/no label, with monotonic constraints, in numpy.

The trees are grown level by level on binned features and kept as flat node arrays, so that a
batch of rows is scored by index steps alone. A constrained feature never raises (or lowers)
the score as it grows: a split against the direction is refused, and both sides of an accepted
one are bounded by the middle of their values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Node arrays, one row per tree; `left` and `right` of a leaf point at itself."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for t in range(len(self.feature)):
            node = np.zeros(len(rows), dtype=np.int32)
            for _ in range(self.depth):
                down = rows[every, self.feature[t, node]] <= self.threshold[t, node]
                node = np.where(down, self.left[t, node], self.right[t, node])
            out += self.value[t, node]
        return out

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -40, 40)))


def _grow(binned, edges, grad, hess, signs, depth, bins, least, ridge):
    """One tree: lists of feature, threshold, left, right, value and the leaf of every row."""
    feature, threshold, left, right, value = [0], [np.inf], [0], [0], [0.0]
    low, high = [-np.inf], [np.inf]
    rows_of = {0: np.arange(len(grad))}
    leaf = np.zeros(len(grad), dtype=np.int32)

    def weight(g, h, lo, hi):
        return np.clip(-g / (h + ridge), lo, hi)

    def gain(g, h, w):
        return -(g * w + 0.5 * (h + ridge) * w * w)

    value[0] = float(weight(grad.sum(), hess.sum(), -np.inf, np.inf))
    level = [0]
    for _ in range(depth):
        following = []
        for node in level:
            rows = rows_of.pop(node)
            g_all, h_all = grad[rows].sum(), hess[rows].sum()
            here = gain(g_all, h_all, weight(g_all, h_all, low[node], high[node]))
            best = (1e-6, None)
            for f in range(binned.shape[1]):
                g = np.bincount(binned[rows, f], grad[rows], bins).cumsum()[:-1]
                h = np.bincount(binned[rows, f], hess[rows], bins).cumsum()[:-1]
                n = np.bincount(binned[rows, f], minlength=bins).cumsum()[:-1]
                wl = weight(g, h, low[node], high[node])
                wr = weight(g_all - g, h_all - h, low[node], high[node])
                won = gain(g, h, wl) + gain(g_all - g, h_all - h, wr) - here
                fair = (n >= least) & (len(rows) - n >= least) & (signs[f] * (wr - wl) >= 0)
                won = np.where(fair, won, -np.inf)
                at = int(won.argmax())
                if won[at] > best[0]:
                    best = (won[at], (f, at, float(wl[at]), float(wr[at])))
            if best[1] is None:
                continue
            f, at, wl, wr = best[1]
            middle = (wl + wr) / 2
            go = binned[rows, f] <= at
            for side, w in ((go, wl), (~go, wr)):
                child = len(feature)
                for into, x in zip((feature, threshold, left, right, value), (0, np.inf, child, child, w)):
                    into.append(x)
                first = side is go
                lo, hi = low[node], high[node]
                if signs[f]:
                    if first == (signs[f] > 0):
                        hi = min(hi, middle)
                    else:
                        lo = max(lo, middle)
                low.append(lo)
                high.append(hi)
                rows_of[child] = rows[side]
                leaf[rows[side]] = child
                following.append(child)
            feature[node], threshold[node] = f, edges[f][at]
            left[node], right[node] = len(feature) - 2, len(feature) - 1
        level = following
    return feature, threshold, left, right, value, leaf


def fit(rows: np.ndarray, label: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3,
        rate: float = 0.2, bins: int = 48, least: int = 5, ridge: float = 1.0) -> Trees:
    """Fit on `rows`; `signs` holds -1, 0 or 1 per feature. Without both labels the score is constant."""
    label = np.asarray(label, dtype=float)
    nodes = 2 ** (depth + 1) - 1
    shape = (trees, nodes)
    out = Trees(np.zeros(shape, np.int16), np.full(shape, np.inf), np.tile(np.arange(nodes), (trees, 1)),
                np.tile(np.arange(nodes), (trees, 1)), np.zeros(shape), 0.0, depth)
    share = (label.sum() + 0.5) / (len(label) + 1)
    out.base = float(np.log(share / (1 - share)))
    if len(label) == 0 or label.min() == label.max():
        return out
    edges, binned = [], np.zeros(rows.shape, dtype=np.int32)
    for f in range(rows.shape[1]):
        cuts = np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1]))
        edges.append(np.append(cuts, np.full(bins - len(cuts), np.inf)))
        binned[:, f] = np.searchsorted(cuts, rows[:, f], side="left")
    margin = np.full(len(label), out.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        feature, threshold, left, right, value, leaf = _grow(
            binned, edges, p - label, np.maximum(p * (1 - p), 1e-6), signs, depth, bins, least, ridge)
        n = len(feature)
        out.feature[t, :n], out.threshold[t, :n] = feature, threshold
        out.left[t, :n], out.right[t, :n] = left, right
        out.value[t, :n] = rate * np.array(value)
        margin += out.value[t, leaf]
    return out
