"""A random forest of axis-parallel trees in numpy, small enough to ship to workers."""

from __future__ import annotations

import numpy as np


class Forest:
    """Bagged classification trees; ``score`` is the mean leaf share of positives."""

    def __init__(self, trees: int = 40, depth: int = 9, leaf: int = 4, bins: int = 24, seed: int = 7) -> None:
        self.trees, self.depth, self.leaf, self.bins, self.seed = trees, depth, leaf, bins, seed
        self.nodes: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, self.bins))) for j in range(x.shape[1])]
        tries = max(1, round(x.shape[1] ** 0.5))
        for _ in range(self.trees):
            rows = rng.integers(0, len(x), len(x))
            feature, cut, left, right, value = [], [], [], [], []

            def grow(own: np.ndarray, level: int) -> int:
                at = len(feature)
                share = float(y[own].mean())
                for store, v in ((feature, 0), (cut, 0.0), (left, at), (right, at), (value, share)):
                    store.append(v)
                if level == self.depth or len(own) < 2 * self.leaf or share in (0.0, 1.0):
                    return at
                best = (share * (1 - share) * len(own) - 1e-9, None, None)
                for j in rng.choice(x.shape[1], tries, replace=False):
                    below = x[own, j][:, None] <= cuts[j][None, :]
                    n = below.sum(axis=0)
                    pos = (below & (y[own] > 0)[:, None]).sum(axis=0)
                    m, rest = len(own) - n, y[own].sum() - pos
                    ok = (n >= self.leaf) & (m >= self.leaf)
                    if not ok.any():
                        continue
                    n, m = np.maximum(n, 1), np.maximum(m, 1)
                    impurity = np.where(ok, pos * (n - pos) / n + rest * (m - rest) / m, np.inf)
                    k = int(impurity.argmin())
                    if impurity[k] < best[0]:
                        best = (impurity[k], j, cuts[j][k])
                if best[1] is None:
                    return at
                side = x[own, best[1]] <= best[2]
                feature[at], cut[at] = int(best[1]), float(best[2])
                left[at] = grow(own[side], level + 1)
                right[at] = grow(own[~side], level + 1)
                return at

            grow(rows, 0)
            self.nodes.append(tuple(map(np.array, (feature, cut, left, right, value))))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, cut, left, right, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth + 1):
                at = np.where(x[every, feature[at]] <= cut[at], left[at], right[at])
            total += value[at]
        return total / max(1, len(self.nodes))
