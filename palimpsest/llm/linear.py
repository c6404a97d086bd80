"""Small linear models in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def dual_logistic(gram: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 150, balanced: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions of the 0/1 columns of ``y`` on rows with inner products ``gram``: a factor per row, and intercepts.

    Accelerated gradient descent from zero; the step follows from the largest
    eigenvalue, so it needs no tuning and reruns agree.  The weights stay
    combinations of the rows, so the rows themselves are not needed.
    ``balanced`` gives both classes of a column the same total weight.
    """
    n = len(gram)
    y = y.reshape(n, -1).astype(np.float32)
    share = np.ones_like(y)
    if balanced:
        ones = y.mean(axis=0)
        share = np.where(y > 0, 0.5 / np.maximum(ones, 1e-9), 0.5 / np.maximum(1 - ones, 1e-9)).astype(np.float32)
    v = np.full(n, 1 / np.sqrt(n), dtype=np.float32)
    for _ in range(12):
        v = gram @ v
        v /= max(float(np.linalg.norm(v)), 1e-12)
    step = 1 / ((float(v @ (gram @ v)) / n + 1) * 0.25 * float(share.max()) + l2)
    a, b = np.zeros_like(y), np.zeros(y.shape[1], np.float32)
    aa, bb, t = a, b, 1.0
    for _ in range(steps):
        g = ((sigmoid(gram @ aa + bb) - y) * share / n).astype(np.float32)
        na, nb = aa - step * (g + l2 * aa), bb - step * g.sum(axis=0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        aa, bb = na + (t - 1) / nt * (na - a), nb + (t - 1) / nt * (nb - b)
        a, b, t = na, nb, nt
    return a, b


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 150, balanced: bool = True,
             gram: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, columns) and intercepts of :func:`dual_logistic` on the rows of ``x``."""
    a, b = dual_logistic(x @ x.T if gram is None else gram, y, l2, steps, balanced)
    return (x.T @ a).astype(np.float32), b


def folds(n: int, k: int) -> np.ndarray:
    """Fold of each of ``n`` rows, in turn."""
    return np.arange(n) % k
