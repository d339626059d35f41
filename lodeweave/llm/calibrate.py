"""Turning raw model outputs into scores, and scores into decisions."""

from __future__ import annotations

import numpy as np


def best_cut(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float | None:
    """The middle of the widest gap between neighbouring outputs among the cuts of largest F1; None without both labels."""
    if not y.any() or y.all():
        return None
    order = np.argsort(-z, kind="stable")
    z, y, weight = z[order], y[order], weight[order]
    hit = np.cumsum(weight * y)
    f1 = 2 * hit / (np.cumsum(weight) + hit[-1])
    gap = np.append(z[:-1] - z[1:], 1.0)
    f1[gap <= 0] = -1
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    k = best[np.argmax(gap[best])]
    return float(z[k] - gap[k] / 2)


def scale(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The slope of a one-variable logistic fit, held between 0.2 and 20."""
    a = b = 0.0
    a = 1.0
    target = np.where(y > 0, 0.98, 0.02)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, w = weight * (p - target), weight * p * (1 - p) + 1e-9
        m = np.array([[np.sum(w * z * z) + 1e-3, np.sum(w * z)], [np.sum(w * z), np.sum(w) + 1e-3]])
        step = np.linalg.solve(m, [np.sum(g * z), np.sum(g)])
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -4, 4))
    return float(np.clip(a, 0.2, 20))


def squash(z: np.ndarray, slope: float, cut: float, at: float) -> np.ndarray:
    """Scores in 0..1, increasing in z, that equal `at` where z is `cut`."""
    return 1 / (1 + np.exp(-np.clip(slope * (z - cut) + np.log(at / (1 - at)), -40, 40)))
