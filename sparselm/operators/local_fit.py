"""The L1-penalised fit of one small moment problem, inside a task.

The same consensus method as :mod:`.admm` with a single block: eigen-factor,
soft threshold, the same stopping rule. Several penalties run side by side and
stop on their own.
"""

from __future__ import annotations

import math

import numpy as np


def fit_moments(G: np.ndarray, c: np.ndarray, lams, rho: float | str = "auto",
                max_iter: int = 5000, abs_tol: float = 1e-8, rel_tol: float = 1e-8):
    """Minimise ``½zᵀGz − cᵀz + λ‖z‖₁`` for every λ: (K×p coefficients, rounds,
    converged)."""
    from .admm import eigen_factor, soft_threshold_np

    K, p = len(lams), len(c)
    Z = np.zeros((K, p))
    if p == 0:
        return Z, np.zeros(K, int), np.ones(K, bool)
    mean = float(np.trace(G)) / p
    rho = (mean if mean > 0 else 1.0) if rho == "auto" else float(rho)
    B, s = eigen_factor(G)
    U = np.zeros((K, p))
    done, rounds = np.zeros(K, bool), np.zeros(K, int)
    kappa = np.asarray(lams, dtype=np.float64) / rho
    for _ in range(max_iter):
        live = np.flatnonzero(~done)
        if not len(live):
            break
        X = (((c + rho * (Z[live] - U[live])) @ B.T) / (s + rho)) @ B
        old = Z[live]
        new = np.stack([soft_threshold_np(v, kappa[k]) for k, v in zip(live, X + U[live])])
        U[live] += X - new
        Z[live] = new
        rounds[live] += 1
        norm = lambda M: np.sqrt((M * M).sum(axis=1))
        pri = math.sqrt(p) * abs_tol + rel_tol * np.maximum(norm(X), norm(new))
        dual = math.sqrt(p) * abs_tol + rel_tol * rho * norm(U[live])
        done[live] = (norm(X - new) < pri) & (rho * norm(new - old) < dual)
    return Z, rounds, done


def support_fit(G: np.ndarray, c: np.ndarray, lam: float, most: int = 2000) -> np.ndarray:
    """Minimise ``½xᵀGx − cᵀx + λ‖x‖₁`` by coordinate descent on the columns that
    are non-zero or break optimality; now and then the equations of the support
    are solved, and their solution is the answer if it has the support's signs
    and no other column breaks optimality. After ``most`` sweeps, what descent
    has reached."""
    x, g, size = np.zeros(len(c)), np.array(c, dtype=np.float64), np.diag(G).copy()
    for sweep in range(1, most + 1):
        active = np.flatnonzero(((x != 0) | (np.abs(g) > lam)) & (size > 0))
        for i in active.tolist():
            old, v = x[i], g[i] + size[i] * x[i]
            x[i] = math.copysign(max(abs(v) - lam, 0.0), v) / size[i]
            if x[i] != old:
                g -= (x[i] - old) * G[i]
        on = np.flatnonzero(x)
        if sweep % 20 and len(on):
            continue
        sign = np.sign(x[on])
        try:
            exact = np.linalg.solve(G[np.ix_(on, on)], c[on] - lam * sign)
        except np.linalg.LinAlgError:
            continue
        slope = c - exact @ G[on]
        slope[on] = 0.0
        if (np.sign(exact) == sign).all() and (np.abs(slope) <= lam * (1 + 1e-9)).all():
            x = np.zeros(len(c))
            x[on] = exact
            break
    return x
