"""Logistic calibration from counted cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def fit_cells(cells: pa.Table, features: list[str], ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Intercept and weights by Newton steps on rows (features, mark 0/1, n).

    The ridge pulls the weights, on standardised features, to zero; the intercept is free but for one
    imagined row of each mark. Without rows all weights are zero.
    """
    if not cells.num_rows:
        return np.zeros(len(features) + 1)
    x = np.column_stack([cells[f].to_numpy().astype(np.float64) for f in features])
    y, n = cells["mark"].to_numpy().astype(np.float64), cells["n"].to_numpy().astype(np.float64)
    mean = (n @ x) / n.sum()
    scale = np.sqrt((n @ (x - mean) ** 2) / n.sum())
    scale[scale == 0] = 1.0
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    z = np.vstack([z, np.eye(1, z.shape[1]), np.eye(1, z.shape[1])])
    y, n = np.append(y, [0.0, 1.0]), np.append(n, [1.0, 1.0])
    penalty = np.diag([0.0, *[ridge] * len(features)])
    w = np.zeros(z.shape[1])

    def loss(w: np.ndarray) -> float:
        t = z @ w
        return float(n @ (np.logaddexp(0, t) - y * t)) + 0.5 * float(w @ penalty @ w)

    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (n * (y - p)) - penalty @ w)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    weights = w[1:] / scale
    return np.concatenate(([w[0] - weights @ mean], weights))
