"""Bagged decision trees over numeric features, trained on a bounded sample, applied anywhere with numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


def _cuts(values: np.ndarray) -> np.ndarray:
    """Thresholds: quantiles of the values and, as most rows may share one value, of the distinct values."""
    at = np.linspace(0, 1, BINS + 1)[1:-1]
    return np.unique(np.concatenate([np.quantile(v, at) for v in (values, np.unique(values))]))


class Tree:
    """A binary tree in arrays: the feature and threshold of each node, and the mean label of each leaf."""

    def __init__(self, x: np.ndarray, edges: list[np.ndarray], y: np.ndarray, depth: int, least: int):
        self.feature, self.threshold, self.left, self.value = [], [], [], []
        self._grow(x, edges, y, depth, least)
        self.feature, self.left = np.asarray(self.feature), np.asarray(self.left)
        self.threshold, self.value = np.asarray(self.threshold, float), np.asarray(self.value, float)

    def _node(self, y: np.ndarray) -> int:
        self.feature.append(-1)
        self.threshold.append(0.0)
        self.left.append(0)
        self.value.append(float(y.mean()) if len(y) else 0.0)
        return len(self.feature) - 1

    def _grow(self, x: np.ndarray, edges: list[np.ndarray], y: np.ndarray, depth: int, least: int) -> None:
        todo = [(self._node(y), np.arange(len(y)), depth)]
        while todo:
            node, rows, left = todo.pop()
            if not left or len(rows) < 2 * least or not 0 < self.value[node] < 1:
                continue
            labels, best = y[rows], (1e-9, -1, -1)
            p, n = labels.sum(), len(rows)
            whole = p * (n - p) / n
            for f, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                b = x[rows, f]
                total = np.bincount(b, minlength=len(cuts) + 1)[:-1].cumsum()
                ones = np.bincount(b, labels, minlength=len(cuts) + 1)[:-1].cumsum()
                ok = (total >= least) & (n - total >= least)
                with np.errstate(divide="ignore", invalid="ignore"):
                    rest = ones * (total - ones) / total + (p - ones) * (n - total - p + ones) / (n - total)
                gain = np.where(ok, whole - rest, 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
            _, f, k = best
            if f >= 0:
                low = x[rows, f] <= k
                self.feature[node], self.threshold[node] = f, edges[f][k]
                a = self._node(labels[low])
                self._node(labels[~low])
                self.left[node] = a
                todo += [(a, rows[low], left - 1), (a + 1, rows[~low], left - 1)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            rows = np.flatnonzero(inner)
            a = at[rows]
            at[rows] = self.left[a] + (x[rows, f[rows]] > self.threshold[a])


class BaggedTrees:
    """Trees grown on bootstrap samples; their mean is the score."""

    def __init__(self, x: np.ndarray, y: np.ndarray, strata: np.ndarray | None = None, trees: int = 25, depth: int = 16, least: int = 2, share: float = 0.6, seed: int = 11):
        """``strata`` numbers the rows' groups: a bootstrap sample draws from each group by the fourth root of its size,
        so that rare groups are seen. ``share`` of the features is open to each tree, so that the trees differ."""
        rng = np.random.default_rng(seed)
        edges = [_cuts(x[:, f]) for f in range(x.shape[1])] if len(x) else []
        binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]) if len(x) else x
        self.trees = []
        p = None
        if strata is not None and len(x):
            _, group, size = np.unique(strata, return_inverse=True, return_counts=True)
            p = size[group] ** -0.75
            p /= p.sum()
        for _ in range(trees if len(x) else 0):
            rows = rng.choice(len(y), len(y), p=p)
            open_ = rng.random(len(edges)) < share
            self.trees.append(Tree(binned[rows], [e if o else e[:0] for e, o in zip(edges, open_)], y[rows].astype(float), depth, least))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1; 0 without any training rows."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        return np.mean([t.predict(x) for t in self.trees], axis=0)
