"""Small gradient-boosted trees (Newton steps, logistic loss) on dense features."""

from __future__ import annotations

import numpy as np


class Trees:
    """Complete trees of fixed depth: node i has children 2i + 1 and 2i + 2."""

    def __init__(self, depth: int = 3, rounds: int = 60, rate: float = 0.2, least: float = 4.0, ridge: float = 1.0):
        self.depth, self.rounds, self.rate, self.least, self.ridge = depth, rounds, rate, least, ridge
        self.start = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        total = np.full(len(y), self.start)
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-total))
            g, h = p - y, p * (1 - p)
            feature, cut, value = np.full(inner, -1), np.zeros(inner), np.zeros(2 ** (self.depth + 1) - 1)
            node = np.zeros(len(y), dtype=int)
            for i in range(inner):
                own = np.flatnonzero(node == i)
                best = (1e-6, -1, 0)
                if own.size:
                    gs, hs = g[own].sum(), h[own].sum()
                    base = gs * gs / (hs + self.ridge)
                    for f, c in enumerate(cuts):
                        if not c.size:
                            continue
                        gl = np.cumsum(np.bincount(binned[own, f], g[own], c.size + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[own, f], h[own], c.size + 1))[:-1]
                        gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - base
                        gain[(hl < self.least / 4) | (hs - hl < self.least / 4)] = 0
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), f, k)
                if best[1] >= 0:
                    feature[i], cut[i] = best[1], cuts[best[1]][best[2]]
                    node[own] = 2 * i + 1 + (binned[own, best[1]] > best[2])
                else:
                    node[own] = 2 * i + 1
            for leaf in range(inner, value.size):
                own = node == leaf
                if own.any():
                    value[leaf] = -self.rate * g[own].sum() / (h[own].sum() + self.ridge)
            total += value[node]
            self.trees.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        at = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (x[at, f] > cut[node]))
            total += value[node]
        return total
