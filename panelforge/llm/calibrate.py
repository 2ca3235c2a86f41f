"""Logistic fits on small bounded matrices (driver side)."""

from __future__ import annotations

import numpy as np


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0)))


def logistic_fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights (last one: intercept) of a ridge logistic regression by
    Newton's method.  ``x`` is standardised inside and the weights are
    returned for the raw columns."""
    mu, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 0, sd, 1.0)
    z = np.column_stack([(x - mu) / sd, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = sigmoid(z @ w)
        grad = z.T @ (p - y) + l2 * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    raw = w[:-1] / sd
    return np.append(raw, w[-1] - raw @ mu)
