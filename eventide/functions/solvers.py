"""Small dense solvers that run inside a task on one curve."""

from __future__ import annotations

from itertools import combinations

import numpy as np


def nnls_small(A: np.ndarray, B: np.ndarray) -> np.ndarray:
    """Exact non-negative least squares for a few columns, many right sides.

    With at most a handful of columns every active set can be solved; the
    feasible solution with the smallest residual is the answer.  ``A`` is
    (rows, p), ``B`` (rows, curves); returns (curves, p).
    """
    p, m = A.shape[1], B.shape[1]
    best = np.zeros((m, p))
    cost = np.einsum("ij,ij->j", B, B)
    for size in range(1, p + 1):
        for cols in combinations(range(p), size):
            sub = A[:, cols]
            x = np.linalg.lstsq(sub, B, rcond=None)[0]
            r = B - sub @ x
            c = np.einsum("ij,ij->j", r, r)
            better = np.all(x >= 0, axis=0) & (c < cost)
            best[better] = 0.0
            best[np.ix_(better, cols)] = x[:, better].T
            cost[better] = c[better]
    return best


def least_squares(fun, x0, lower=None, upper=None, *, max_iter: int = 200, tol: float = 1e-12):
    """Damped Gauss-Newton with box limits; returns (x, cost, jacobian, ok)."""
    x = np.asarray(x0, dtype=float)
    lo = np.full(x.size, -np.inf) if lower is None else np.asarray(lower, dtype=float)
    hi = np.full(x.size, np.inf) if upper is None else np.asarray(upper, dtype=float)
    x = np.clip(x, lo, hi)
    r = fun(x)
    cost, damping, ok = 0.5 * float(r @ r), 1e-3, False
    J = None
    for _ in range(max_iter):
        J = np.empty((r.size, x.size))
        for k in range(x.size):
            h = 1e-6 * max(abs(x[k]), 1e-3)
            up, dn = x.copy(), x.copy()
            up[k], dn[k] = min(x[k] + h, hi[k]), max(x[k] - h, lo[k])
            J[:, k] = (fun(up) - fun(dn)) / (up[k] - dn[k])
        g, H = J.T @ r, J.T @ J
        free = ~(((x <= lo) & (g > 0)) | ((x >= hi) & (g < 0)))
        if not free.any() or np.max(np.abs(g[free])) < tol:
            ok = True
            break
        moved = False
        for _ in range(30):
            D = H[np.ix_(free, free)] + damping * np.diag(np.maximum(np.diag(H)[free], 1e-12))
            step = np.zeros(x.size)
            step[free] = -np.linalg.lstsq(D, g[free], rcond=None)[0]
            trial = np.clip(x + step, lo, hi)
            rt = fun(trial)
            ct = 0.5 * float(rt @ rt)
            if np.isfinite(ct) and ct < cost:
                gain = (cost - ct) / max(cost, 1e-300)
                x, r, cost, moved = trial, rt, ct, True
                damping = max(damping / 5.0, 1e-12)
                break
            damping *= 4.0
        if not moved or gain < tol:
            ok = True
            break
    return x, cost, J, ok
