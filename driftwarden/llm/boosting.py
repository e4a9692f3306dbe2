"""Small gradient-boosted trees for a bounded number of rows: logistic loss, histogram splits, numpy only."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BoostedTrees:
    """Binary classifier of depth-limited trees over binned features; the same rows give the same trees."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.penalty = rounds, depth, rate, bins, penalty
        self.edges: list[np.ndarray] = []
        self.trees: list[list[tuple[int, int, float]]] = []  # per node: feature (-1: leaf), bin, value
        self.start = 0.0
        self.scale, self.shift = 1.0, 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        grid = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, k], grid)) for k in range(x.shape[1])]
        b = self._binned(x)
        mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = sigmoid(f)
            tree, step = self._tree(b, p - y, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            f += step
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[list, np.ndarray]:
        nodes = 2 ** (self.depth + 1) - 1
        tree, at, step = [(-1, 0, 0.0)] * nodes, np.zeros(len(g), np.int64), np.zeros(len(g))
        for node in range(nodes):
            own = np.flatnonzero(at == node)
            if not len(own):
                continue
            gs, hs = g[own].sum(), h[own].sum()
            best = (1e-6, -1, 0)
            if node < 2**self.depth - 1:
                for k in range(b.shape[1]):
                    gl = np.cumsum(np.bincount(b[own, k], g[own], self.bins))[:-1]
                    hl = np.cumsum(np.bincount(b[own, k], h[own], self.bins))[:-1]
                    gain = gl**2 / (hl + self.penalty) + (gs - gl) ** 2 / (hs - hl + self.penalty) - gs**2 / (hs + self.penalty)
                    top = int(gain.argmax())
                    if gain[top] > best[0] + 1e-9:
                        best = (float(gain[top]), k, top)
            if best[1] < 0:
                value = -self.rate * gs / (hs + self.penalty)
                tree[node] = (-1, 0, float(value))
                step[own], at[own] = value, -1
            else:
                tree[node] = (best[1], best[2], 0.0)
                at[own] = 2 * node + 1 + (b[own, best[1]] > best[2])
        return tree, step

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, f = self._binned(x), np.full(len(x), self.start)
        for tree in self.trees:
            feature, cut, value = (np.array([n[k] for n in tree]) for k in range(3))
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = feature[at] >= 0
                go = b[np.arange(len(x)), np.maximum(feature[at], 0)] > cut[at]
                at = np.where(inner, 2 * at + 1 + go, at)
            f += value[at]
        return f

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Platt scaling on rows not fitted on: probability = sigmoid(scale * margin + shift)."""
        m = self.margin(x)
        a, c = 1.0, 0.0
        goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(50):
            p = sigmoid(a * m + c)
            w = np.maximum(p * (1 - p), 1e-6)
            grad = np.array([((p - goal) * m).sum() + 1e-3 * (a - 1), (p - goal).sum()])
            hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-9]])
            move = np.linalg.solve(hess + 1e-9 * np.eye(2), grad)
            a, c = a - move[0], c - move[1]
            if abs(move).max() < 1e-8:
                break
        self.scale, self.shift = float(a), float(c)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.margin(x) + self.shift) if len(x) else np.zeros(0)
