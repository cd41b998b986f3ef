"""Histogram gradient boosting for a 0/1 target, in numpy: training on the driver, scoring anywhere.

A fitted model is five flat arrays over the nodes of all trees, so scoring walks every (row, tree) pair
one level at a time without Python loops over rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees, end to end.  Leaves have left == right == their own index, so a walk may overrun them."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1 for each row of x."""
        out = np.full(len(x), self.base)
        if not len(self.roots):
            return out
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            rows = np.arange(len(part))[:, None]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                go_left = part[rows, self.feature[at]] <= self.threshold[at]
                at = np.where(go_left, self.left[at], self.right[at])
            out[lo : lo + 4096] += self.value[at].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -40, 40)))


def constant(p: float) -> Trees:
    p = min(max(p, 1e-6), 1 - 1e-6)
    none, whole = np.zeros(0), np.zeros(0, np.int64)
    return Trees(float(np.log(p / (1 - p))), whole, whole, none, whole, whole, none, 0)


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: dict[int, int] | None = None,
    trees: int = 80,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    l2: float = 1.0,
    min_rows: int = 10,
) -> Trees:
    """Newton boosting of the logistic loss.

    monotone: +1 or -1 for features whose growth may only raise or only lower the score.  A split that breaks
    this is not taken, and the midpoint of its two values bounds everything below it, so the whole ensemble obeys.
    No rows, or a single class: a constant model.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    if not len(y):
        return constant(0.5)
    if y.min() == y.max():
        return constant((y.sum() + 0.5) / (len(y) + 1))
    n, n_features = x.shape
    sign = np.zeros(n_features)
    for f, s in (monotone or {}).items():
        sign[f] = s
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(n_features)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(n_features)], axis=1)
    flat_bin = binned + np.arange(n_features) * bins
    p0 = y.mean()
    base = float(np.log(p0 / (1 - p0)))
    raw = np.full(n, base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left_depth: int, low: float, high: float) -> int:
        me = len(nodes)
        sum_g, sum_h = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-sum_g / (sum_h + l2), low, high))
        nodes.append([0, 0.0, me, me, value * rate])
        if left_depth == 0 or len(rows) < 2 * min_rows:
            raw[rows] += value * rate
            return me
        keys = flat_bin[rows].ravel()
        shape = (n_features, bins)
        hist = [np.bincount(keys, np.repeat(v[rows], n_features), n_features * bins).reshape(shape) for v in (g, h)]
        count = np.bincount(keys, minlength=n_features * bins).reshape(shape)
        gl, hl, cl = (np.cumsum(a, axis=1)[:, :-1] for a in (*hist, count))
        gr, hr, cr = sum_g - gl, sum_h - hl, len(rows) - cl
        wl, wr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
        gain_of = lambda gg, hh, w: -(gg * w + 0.5 * (hh + l2) * w * w)
        gain = gain_of(gl, hl, wl) + gain_of(gr, hr, wr) - gain_of(sum_g, sum_h, value)
        ok = (cl >= min_rows) & (cr >= min_rows) & (sign[:, None] * (wr - wl) >= 0)
        gain = np.where(ok, gain, -np.inf)
        f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if not gain[f, b] > 1e-6:
            raw[rows] += value * rate
            return me
        goes = binned[rows, f] <= b
        mid = (wl[f, b] + wr[f, b]) / 2
        bound_l, bound_r = (low, high), (low, high)
        if sign[f] > 0:
            bound_l, bound_r = (low, mid), (mid, high)
        elif sign[f] < 0:
            bound_l, bound_r = (mid, high), (low, mid)
        left = grow(rows[goes], g, h, left_depth - 1, *bound_l)
        right = grow(rows[~goes], g, h, left_depth - 1, *bound_r)
        nodes[me] = [int(f), float(cuts[f][b]), left, right, 0.0]
        return me

    everything = np.arange(n)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        roots.append(grow(everything, p - y, np.maximum(p * (1 - p), 1e-9), depth, -4.0, 4.0))
    a = np.array(nodes)
    whole = lambda k: a[:, k].astype(np.int64)
    return Trees(base, np.array(roots), whole(0), a[:, 1].copy(), whole(2), whole(3), a[:, 4].copy(), depth)
