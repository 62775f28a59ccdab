"""Gradient-boosted regression trees for bounded samples, on quantile bins, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

TREES, DEPTH, RATE, BINS, LEAST_LEAF, SHRINK = 160, 4, 0.1, 48, 8, 1.0


@dataclass
class Boosted:
    edges: list[np.ndarray]
    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)  # per tree: one entry per inner node
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)
    depth: int = DEPTH

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1).astype(np.int32)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out = np.full(len(b), self.base)
        rows = np.arange(len(b))
        for f, c, v in zip(self.features, self.cuts, self.leaves):
            at = np.zeros(len(b), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, f[at]] > c[at])
            out += v[at - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Boosted:
    """Squared loss; every tree is complete to ``depth``, a node without gain sends all rows left."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    m = Boosted(edges, float(y.mean()), depth=depth)
    b = m.binned(x)
    n, d = b.shape
    now = np.full(n, m.base)
    inner = 2**depth - 1
    for _ in range(trees):
        g = y - now
        f, c = np.zeros(inner, dtype=np.int64), np.full(inner, BINS, dtype=np.int64)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            node = at - first
            best = np.zeros(width)
            for j in range(d):
                key = node * BINS + b[:, j]
                s = np.bincount(key, g, width * BINS).reshape(width, BINS)
                k = np.bincount(key, minlength=width * BINS).reshape(width, BINS)
                ls, lk = s.cumsum(1), k.cumsum(1)
                rs, rk = ls[:, -1:] - ls, lk[:, -1:] - lk
                gain = ls**2 / (lk + SHRINK) + rs**2 / (rk + SHRINK) - ls[:, -1:] ** 2 / (lk[:, -1:] + SHRINK)
                gain[(lk < LEAST_LEAF) | (rk < LEAST_LEAF)] = 0
                top = gain.argmax(1)
                value = gain[np.arange(width), top]
                better = value > best + 1e-12
                f[first : first + width][better] = j
                c[first : first + width][better] = top[better]
                best[better] = value[better]
            at = 2 * at + 1 + (b[np.arange(n), f[at]] > c[at])
        leaf = at - inner
        s = np.bincount(leaf, g, inner + 1)
        k = np.bincount(leaf, minlength=inner + 1)
        v = rate * s / (k + SHRINK)
        now += v[leaf]
        m.features.append(f)
        m.cuts.append(c)
        m.leaves.append(v)
    return m


def thresholds(p: np.ndarray, y: np.ndarray, levels: range) -> np.ndarray:
    """Cuts between neighbouring levels that misplace fewest of the given predictions."""
    order = np.argsort(p, kind="stable")
    ps, ys = p[order], y[order]
    mid = np.concatenate([[-np.inf], (ps[1:] + ps[:-1]) / 2, [np.inf]])
    out = []
    for k in list(levels)[:-1]:
        low = ys <= k
        wrong = np.concatenate([[0], np.cumsum(~low)]) + (low.sum() - np.concatenate([[0], np.cumsum(low)]))
        best = np.flatnonzero(wrong == wrong.min())
        near = mid[best]
        out.append(float(near[np.argmin(np.abs(near - (k + 0.5)))]))
    return np.maximum.accumulate(np.array(out))
