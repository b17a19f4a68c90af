"""Gradient-boosted trees for a yes/no target on binned features, with monotonic constraints, in numpy.

Fitting works on the bounded sample it is given. A fitted model is a set of flat node arrays, so that scoring is a few
vectorised gathers for each level of a tree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Row t of each array is tree t; node i has children 2i+1 and 2i+2, leaves carry feature -1."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values for each row of `x`."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = (self.feature.shape[1] + 1).bit_length() - 2
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                f = feature[at]
                inner = f >= 0
                at = np.where(inner, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > threshold[at]), at)
            out += value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _best_split(g: np.ndarray, h: np.ndarray, sign: np.ndarray, low: float, high: float, reg: float, least: float) -> tuple[float, int, int]:
    """Best gain, feature and bin over the histograms g, h (features x bins) of one node."""
    gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    gt, ht = g.sum(axis=1)[:, None], h.sum(axis=1)[:, None]
    gr, hr = gt - gl, ht - hl
    left, right = np.clip(-gl / (hl + reg), low, high), np.clip(-gr / (hr + reg), low, high)
    gain = lambda v, g, h: -(g * v + 0.5 * (h + reg) * v * v)
    parent = np.clip(-gt / (ht + reg), low, high)
    total = gain(left, gl, hl) + gain(right, gr, hr) - gain(parent, gt, ht)
    total[(hl < least) | (hr < least) | (sign[:, None] * (right - left) < 0)] = -np.inf
    at = int(np.argmax(total))
    f, b = divmod(at, total.shape[1])
    return float(total[f, b]), f, b


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, reg: float = 1.0, least: float = 2.0) -> Trees:
    """Fit logistic loss. `monotone[f]` is 1 or -1 where the score may only rise or fall with feature f, else 0.

    Without rows, or with one class only, the model is a constant.
    """
    p = (y.sum() + 1.0) / (len(y) + 2.0)
    base, size = float(np.log(p / (1 - p))), 2 ** (depth + 1) - 1
    empty = lambda kind, fill: np.full((trees, size), fill, kind)
    model = Trees(base, empty(np.int64, -1), empty(np.float64, 0.0), empty(np.float64, 0.0))
    if not len(y) or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    width = bins + 1
    flat = binned + np.arange(x.shape[1]) * width
    margin = np.full(len(y), base)
    for t in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        nodes = {0: (np.arange(len(y)), -np.inf, np.inf)}
        for at in range(size):
            if at not in nodes:
                continue
            rows, low, high = nodes.pop(at)
            best = (-np.inf, 0, 0)
            if at < size // 2 and len(rows) > 1:
                keys = flat[rows].ravel()
                hist = [np.bincount(keys, np.repeat(v[rows], x.shape[1]), x.shape[1] * width).reshape(-1, width) for v in (g, h)]
                best = _best_split(*hist, monotone, low, high, reg, least)
            if best[0] <= 1e-6 or best[2] >= len(cuts[best[1]]):
                value = float(np.clip(-g[rows].sum() / (h[rows].sum() + reg), low, high)) * rate
                model.value[t, at] = value
                margin[rows] += value
                continue
            _, f, b = best
            model.feature[t, at], model.threshold[t, at] = f, cuts[f][b]
            right = binned[rows, f] > b
            mid = 0.5 * sum(np.clip(-g[s].sum() / (h[s].sum() + reg), low, high) for s in (rows[~right], rows[right]))
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(monotone[f])]
            nodes[2 * at + 1] = (rows[~right], *bounds[0])
            nodes[2 * at + 2] = (rows[right], *bounds[1])
    return model
