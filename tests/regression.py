"""Least squares of one group in NumPy, to compare the aggregates with."""

from __future__ import annotations

import math

import numpy as np


def student_tail(t: float, df: int) -> float:
    """Two-sided p-value of Student's t, by the finite sums for whole degrees of freedom."""
    angle = math.atan2(abs(t), math.sqrt(df))
    s, c = math.sin(angle), math.cos(angle)
    term, total = (c, 0.0) if df % 2 else (1.0, 0.0)
    for k in range(1 if df % 2 else 0, df - 1, 2):
        total += term
        term *= c * c * (k + 1) / (k + 2)
    inside = 2 / math.pi * (angle + s * total) if df % 2 else s * total
    return max(0.0, 1.0 - inside)


def ols_hac(y: np.ndarray, x: np.ndarray, errors: str = "hac") -> dict:
    """Least squares of y on a constant and x. With ``hac``, Newey-West errors (Bartlett
    weights, min(floor(sqrt n), 12) lags) and normal p-values; with ``classic``, the
    errors of independent residuals and p-values of Student's t."""
    n = len(y)
    empty = {"alpha_daily": 0.0, "alpha_annual": 0.0, "t_stat": 0.0, "p_value": 1.0, "r2": 0.0, "adj_r2": 0.0, "ic": 0.0, "ir": 0.0, "n_obs": 0, "betas": [0.0] * x.shape[1]}
    if n < 30 or y.std() < 1e-10:
        return empty
    z = np.column_stack([np.ones(n), x])
    inv = np.linalg.pinv(z.T @ z)
    beta = inv @ z.T @ y
    fitted = z @ beta
    u = y - fitted
    if errors == "classic":
        var = inv * float(u @ u) / (n - z.shape[1])
    else:
        s = (z * u[:, None]).T @ (z * u[:, None])
        lags = min(int(math.sqrt(n)), 12)
        for k in range(1, lags + 1):
            g = (z[k:] * u[k:, None]).T @ (z[:-k] * u[:-k, None])
            s += (1 - k / (lags + 1)) * (g + g.T)
        var = inv @ s @ inv
    t = float(beta[0] / math.sqrt(var[0, 0])) if var[0, 0] > 0 else 0.0
    p = student_tail(t, n - z.shape[1]) if errors == "classic" else math.erfc(abs(t) / math.sqrt(2))
    total = float(((y - y.mean()) ** 2).sum())
    r2 = 1 - float((u**2).sum()) / total if total > 0 else 0.0
    k = x.shape[1]
    resid = float(u.std(ddof=1))
    annual = float((1 + beta[0]) ** 252 - 1)
    return {
        "alpha_daily": float(beta[0]), "alpha_annual": annual, "t_stat": t, "p_value": p, "r2": r2,
        "adj_r2": 1 - (1 - r2) * (n - 1) / (n - k - 1) if n > k + 1 else r2, "ic": float(np.corrcoef(y, fitted)[0, 1]) if fitted.std() > 1e-15 else 0.0,
        "ir": annual / (resid * math.sqrt(252)) if resid > 1e-12 else 0.0, "n_obs": n, "betas": [float(b) for b in beta[1:]]}
