"""A small ridge-penalised logistic regression for calibration on the driver."""

from __future__ import annotations

import numpy as np


class Logistic:
    """Fitted by Newton steps on standardised features; without both classes it returns the share of ones."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2):
        self.share = float(y.mean()) if len(y) else 0.0
        self.weights = None
        if not len(y) or y.min() == y.max():
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack([np.ones(len(y)), (x - self.mean) / self.scale])
        w = np.zeros(z.shape[1])
        penalty = np.diag([1e-6] + [ridge * len(y) / 10] * x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
            step *= min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.share)
        z = self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
