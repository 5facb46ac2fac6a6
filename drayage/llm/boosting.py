"""Gradient-boosted trees for two classes, on histograms of binned features."""

import numpy as np

BINS = 16


class BoostedTrees:
    """Logistic loss; all trees are complete and of one depth."""

    def __init__(self, trees: int = 30, depth: int = 4, rate: float = 0.3, least: float = 5.0):
        self.count, self.depth, self.rate, self.least = trees, depth, rate, least

    def _binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for f, edges in enumerate(self.edges):
            out[:, f] = np.searchsorted(edges, x[:, f], side="right")
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        cuts = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], cuts)) if len(np.unique(x[:, f])) > 2 else np.array([0.5]) for f in range(x.shape[1])]
        bins = self._binned(x)
        n, width = bins.shape
        flat = bins.astype(np.int64) + np.arange(width) * BINS
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.prior = float(np.log(share / (1 - share)))
        score = np.full(n, self.prior)
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature = np.zeros((self.count, inner), np.int64)
        self.cut = np.full((self.count, inner), BINS, np.int64)
        self.value = np.zeros((self.count, leaves))
        for t in range(self.count):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            g_all, h_all = np.repeat(g, width), np.repeat(h, width)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                here = 2**level
                at = (node[:, None] * (width * BINS) + flat).ravel()
                shape = (here, width, BINS)
                gs = np.bincount(at, g_all, here * width * BINS).reshape(shape).cumsum(2)
                hs = np.bincount(at, h_all, here * width * BINS).reshape(shape).cumsum(2)
                g_sum, h_sum = gs[:, :1, -1:], hs[:, :1, -1:]
                gain = gs**2 / (hs + 1) + (g_sum - gs) ** 2 / (h_sum - hs + 1) - g_sum**2 / (h_sum + 1)
                gain[(hs < self.least / 10) | (h_sum - hs < self.least / 10)] = 0
                best = gain.reshape(here, -1).argmax(1)
                worth = gain.reshape(here, -1)[np.arange(here), best] > 1e-6
                own = slice(here - 1, 2 * here - 1)
                self.feature[t, own] = np.where(worth, best // BINS, 0)
                self.cut[t, own] = np.where(worth, best % BINS, BINS)
                f, c = self.feature[t, here - 1 + node], self.cut[t, here - 1 + node]
                node = 2 * node + (bins[np.arange(n), f] > c)
            gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
            self.value[t] = self.rate * gs / (hs + 1)
            score += self.value[t, node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the class 1."""
        bins = self._binned(x)
        rows = np.arange(len(bins))
        out = np.full(len(bins), self.prior)
        for t in range(self.count):
            node = np.zeros(len(bins), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (bins[rows, self.feature[t, at]] > self.cut[t, at])
            out += self.value[t, node]
        return out
