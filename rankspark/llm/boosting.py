"""Gradient-boosted regression trees for two classes, in numpy, on binned features."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Boosted:
    start: float
    #: per tree: feature, threshold and leaf value of every node of a complete binary tree
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        depth = int(np.log2(self.features.shape[1] + 1))
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, ridge: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss; a node splits at the bin edge of greatest gain, or not at all."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    width = x.shape[1]
    # bins of all features side by side: one histogram per node
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1) + BINS * np.arange(width)
    usable = np.arange(BINS)[None, :] < np.array([len(e) for e in edges])[:, None]
    start = float(np.log(max(y.sum(), 1) / max((1 - y).sum(), 1)))
    score = np.full(len(y), start)
    inner = 2 ** depth - 1
    all_f, all_c, all_l = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        f, c, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            if len(own) > 4:
                flat = binned[own].ravel()
                lg, lh = (np.bincount(flat, np.repeat(v[own], width), BINS * width).reshape(width, BINS).cumsum(axis=1) for v in (g, h))
                total_g, total_h = g[own].sum(), h[own].sum()
                gain = lg ** 2 / (lh + ridge) + (total_g - lg) ** 2 / (total_h - lh + ridge) - total_g ** 2 / (total_h + ridge)
                j, k = np.unravel_index(np.where(usable, gain, -np.inf).argmax(), gain.shape)
                if gain[j, k] > 1e-6:
                    f[node], c[node] = j, edges[j][k]
            at[own] = 2 * node + 1 + (x[own, f[node]] > c[node])
        for k in range(inner + 1):
            own = at == inner + k
            leaf[k] = rate * g[own].sum() / (h[own].sum() + ridge)
        score += leaf[at - inner]
        all_f.append(f)
        all_c.append(c)
        all_l.append(leaf)
    return Boosted(start, np.array(all_f), np.array(all_c), np.array(all_l))
