"""Logistic regression on sparse hashed features, fitted by full-batch gradient steps on a bounded sample."""

from __future__ import annotations

import numpy as np


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_sparse(row, dim, value, labels, classes: int, dims: int, steps: int = 120, rate: float = 0.3, l2: float = 1e-4):
    """Softmax weights ``(dims, classes)`` and bias for samples given as triples; classes weigh alike whatever their size.

    Steps are Adam's, from zero: the same input gives the same model.
    """
    used, dim = np.unique(dim, return_inverse=True)
    n, k = len(labels), len(used)
    weight = (n / np.maximum(np.bincount(labels, minlength=classes), 1) / classes)[labels]
    want = np.eye(classes)[labels]
    theta = np.zeros((k + 1, classes))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        scores = np.stack([np.bincount(row, theta[dim, c] * value, minlength=n) for c in range(classes)], axis=1) + theta[k]
        gap = (softmax(scores) - want) * weight[:, None] / n
        grad = np.stack([np.bincount(dim, gap[row, c] * value, minlength=k) for c in range(classes)], axis=1)
        grad = np.concatenate([grad, gap.sum(axis=0, keepdims=True)]) + l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    weights = np.zeros((dims, classes))
    weights[used] = theta[:k]
    return weights, theta[k]


def fit_dense(features: np.ndarray, labels: np.ndarray, steps: int = 400, l2: float = 1e-3, weighted: bool = False) -> np.ndarray:
    """Coefficients and bias of a small binary model, by Newton steps; ``weighted`` gives both classes the same weight."""
    x = np.concatenate([features, np.ones((len(features), 1))], axis=1)
    weight = np.ones(len(labels))
    if weighted:
        weight = (len(labels) / 2 / np.maximum(np.bincount(labels, minlength=2), 1))[labels]
    theta = np.zeros(x.shape[1])
    for _ in range(min(steps, 50)):
        p = sigmoid(x @ theta)
        grad = x.T @ (weight * (p - labels)) + l2 * theta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + (l2 + 1e-9) * np.eye(len(theta))
        step = np.linalg.solve(hess, grad)
        theta -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
    return theta


def platt(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities (Platt's scaling with his smoothed targets)."""
    pos, neg = int(labels.sum()), int(len(labels) - labels.sum())
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(scores.std()), 1e-9)
    x = np.stack([scores / scale, np.ones(len(scores))], axis=1)
    theta = np.array([0.0, np.log((pos + 1) / (neg + 1))])
    for _ in range(100):
        p = sigmoid(x @ theta)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - target) + 1e-4 * theta)
        theta -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
    return float(theta[0]) / scale, float(theta[1])
