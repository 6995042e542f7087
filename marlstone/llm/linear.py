"""Logistic regression on sparse and dense features, for samples that fit the driver."""

from __future__ import annotations

import numpy as np


class Sparse:
    """Rows of binary features: their indices end to end, and each row's bounds."""

    def __init__(self, rows, n_features: int):
        self.n = n_features
        sizes = np.array([len(r) for r in rows], np.int64)
        self.row = np.repeat(np.arange(len(rows)), sizes)
        self.col = np.concatenate([np.asarray(r, np.int64) for r in rows]) if sizes.sum() else np.zeros(0, np.int64)
        self.n_rows = len(rows)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n_rows)

    def t_dot(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, r[self.row], self.n)

    def only(self, columns: np.ndarray) -> Sparse:
        """Without the entries of other columns; the columns keep their numbers."""
        keep = columns[self.col]
        out = Sparse([], self.n)
        out.row, out.col, out.n_rows = self.row[keep], self.col[keep], self.n_rows
        return out

    def take(self, index: np.ndarray) -> Sparse:
        new = np.full(self.n_rows, -1)
        new[index] = np.arange(len(index))
        keep = new[self.row] >= 0
        out = Sparse([], self.n)
        out.row, out.col, out.n_rows = new[self.row[keep]], self.col[keep], len(index)
        return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logit(p):
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


class Logistic:
    """p = sigmoid(sparse . w + standardised dense . v + bias), L2-regularised, fitted by L-BFGS.

    The last ``unscaled`` dense columns keep their scale: probabilities that hardly differ in training are not blown up."""

    def __init__(self, l2: float = 1.0, steps: int = 150, unscaled: int = 0):
        self.l2, self.steps, self.unscaled = l2, steps, unscaled

    def fit(self, dense: np.ndarray, y: np.ndarray, sparse: Sparse | None = None) -> Logistic:
        n, d = dense.shape
        self.mean = dense.mean(axis=0) if n else np.zeros(d)
        self.scale = (dense.std(axis=0) if n else np.ones(d)) + 1e-9
        self.scale[d - self.unscaled :] = 1
        k = sparse.n if sparse else 0
        rate = (y.sum() + 0.5) / (n + 1)
        self.w, self.v, self.bias = np.zeros(k), np.zeros(d), float(logit(rate))
        if n == 0 or y.min() == y.max():
            return self  # nothing to learn from: the rate alone
        x = (dense - self.mean) / self.scale

        def loss(t):
            z = x @ t[k:-1] + t[-1] + (sparse.dot(t[:k]) if sparse else 0)
            p = sigmoid(z)
            r = p - y
            g = np.concatenate([(sparse.t_dot(r) if sparse else np.zeros(0)) + self.l2 * t[:k], x.T @ r + self.l2 * t[k:-1], [r.sum()]])
            return np.logaddexp(0, z).sum() - y @ z + 0.5 * self.l2 * (t[:-1] @ t[:-1]), g

        t = np.concatenate([self.w, self.v, [self.bias]])
        f, g = loss(t)
        past: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(self.steps):
            q, alphas = g.copy(), []
            for s, u in reversed(past):
                alphas.append(s @ q / (s @ u))
                q -= alphas[-1] * u
            q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(g).max())
            for (s, u), a in zip(past, reversed(alphas)):
                q += (a - u @ q / (s @ u)) * s
            step, slope = 1.0, g @ q
            while True:
                new = t - step * q
                f2, g2 = loss(new)
                if f2 <= f - 1e-4 * step * slope or step < 1e-6:
                    break
                step /= 2
            s, u = new - t, g2 - g
            done = f - f2 < 1e-7 * max(1.0, abs(f))
            t, f, g = new, f2, g2
            if s @ u > 1e-12:
                past = [*past[-9:], (s, u)]
            if done:
                break
        self.w, self.v, self.bias = t[:k], t[k:-1], float(t[-1])
        return self

    def margin(self, dense: np.ndarray, sparse: Sparse | None = None) -> np.ndarray:
        z = (dense - self.mean) / self.scale @ self.v + self.bias
        return z + sparse.dot(self.w) if sparse else z

    def predict(self, dense: np.ndarray, sparse: Sparse | None = None) -> np.ndarray:
        return sigmoid(self.margin(dense, sparse))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut, between neighbouring probabilities, of the largest F1; 1.1 (nothing passes) without positives."""
    if not len(y) or not y.sum():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(p[order][1:] < p[order][:-1], True)  # ties stand on one side
    k = int(np.argmax(np.where(last, f1, -1)))
    low = p[order][k + 1] if k + 1 < len(y) else 0.0
    return float((p[order][k] + low) / 2)
