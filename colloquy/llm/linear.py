"""Logistic regression on sparse rows of a bounded sample, and calibration of its scores."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse rows: for row i, columns ``cols[starts[i]:starts[i + 1]]`` with values ``vals``."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]], width: int):
        sizes = [len(c) for c, _ in parts]
        self.n, self.width = len(parts), width
        self.row = np.repeat(np.arange(self.n), sizes)
        self.cols = np.concatenate([c for c, _ in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        self.vals = np.concatenate([v for _, v in parts]).astype(np.float64) if parts else np.zeros(0)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.cols] * self.vals, self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, r[self.row] * self.vals, self.width)


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0)))


def minimise(f, x: np.ndarray, rounds: int = 100, memory: int = 10, tol: float = 1e-8) -> np.ndarray:
    """Limited-memory quasi-Newton descent; ``f`` returns value and gradient."""
    value, grad = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = grad.copy(), []
        for s, y in reversed(steps):
            a = s @ q / (s @ y)
            q -= a * y
            alphas.append(a)
        if steps:
            s, y = steps[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(steps, reversed(alphas)):
            q += s * (a - y @ q / (s @ y))
        slope, t = grad @ q, 1.0 if steps else 1.0 / max(1.0, np.sqrt(grad @ grad))
        while t > 1e-10:
            trial = x - t * q
            new, new_grad = f(trial)
            if new <= value - 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = trial - x, new_grad - grad
        done = value - new <= tol * max(1.0, abs(value))
        x, value, grad = trial, new, new_grad
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        if done:
            break
    return x


def fit_logistic(rows: Rows, y: np.ndarray, ridge: float, pairs: Rows | None = None, pair_weight: float = 0.0, balance: bool = True) -> tuple[np.ndarray, float]:
    """Weights and intercept.

    ``pairs`` holds feature differences whose scores should be zero; their mean square is added with
    ``pair_weight``. With ``balance`` both classes weigh the same.
    """
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return np.zeros(rows.width), 0.0
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) if balance else np.full(len(y), 1.0 / len(y))

    def loss(x):
        w, b = x[:-1], x[-1]
        z = rows.dot(w) + b
        p = sigmoid(z)
        value = share @ (np.logaddexp(0.0, z) - y * z) + 0.5 * ridge * (w @ w)
        r = share * (p - y)
        grad = np.append(rows.back(r) + ridge * w, r.sum())
        if pairs is not None and pairs.n and pair_weight:
            d = pairs.dot(w)
            value += pair_weight * (d @ d) / pairs.n
            grad[:-1] += pairs.back(2.0 * pair_weight * d / pairs.n)
        return value, grad

    x = minimise(loss, np.zeros(rows.width + 1), tol=1e-5)
    return x[:-1], float(x[-1])


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 200, weights: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and intercept that turn scores into probabilities; slope 1 and the prior where one class is missing.

    Targets are smoothed by a count of one, so separable scores keep finite slopes. ``weights`` says how many rows of
    the corpus each row stands for, so that probabilities follow the corpus's shares and not the sample's.
    """
    z, y = np.asarray(z, float), np.asarray(y, float)
    pos, neg = y.sum(), len(y) - y.sum()
    spread = z.std() if len(z) else 0.0
    if not pos or not neg or not spread:
        return 1.0, 0.0
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    u = (z - z.mean()) / spread
    share = np.full(len(z), 1.0 / len(z)) if weights is None else np.asarray(weights, float) / np.sum(weights)

    def loss(x):
        v = x[0] * u + x[1]
        r = (sigmoid(v) - t) * share
        return float(share @ (np.logaddexp(0.0, v) - t * v) + 1e-6 * x[0] ** 2), np.array([(r * u).sum() + 2e-6 * x[0], r.sum()])

    a, b = minimise(loss, np.array([1.0, 0.0]), rounds)
    return (a / spread, b - a * z.mean() / spread) if a > 0 else (1.0, 0.0)
