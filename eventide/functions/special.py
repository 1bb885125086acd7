"""Distribution functions that SQL lacks, as Arrow batch functions.

They only ever see one row per statistical test.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    if not (math.isfinite(df) and df > 0) or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile (p > 0.5) by bisection on the two-sided tail."""
    if not (math.isfinite(df) and df > 0):
        return math.nan
    tail, lo, hi = 2.0 * (1.0 - p), 0.0, 2.0
    while t_two_sided(hi, df) > tail and hi < 1e12:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if t_two_sided(mid, df) > tail else (lo, mid)
    return 0.5 * (lo + hi)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def signed_rank_p(w_plus: float, w_minus: float, n: int, ties: float, zeros: int) -> float:
    """Two-sided Wilcoxon signed-rank p: exact up to 50 untied pairs, else normal."""
    if n == 0:
        return 1.0
    t = min(w_plus, w_minus)
    if n <= 50 and ties == 0 and zeros == 0:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return min(1.0, 2.0 * float(ways[: int(t) + 1].sum()) / 2.0**n)
    mean = n * (n + 1) / 4.0
    var = n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0
    return normal_two_sided((t - mean) / math.sqrt(var)) if var > 0 else math.nan


def rank_sum_p(u: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided Mann-Whitney p: exact for small untied samples, else normal."""
    if n1 == 0 or n2 == 0:
        return math.nan
    big = max(u, n1 * n2 - u)
    if ties == 0 and min(n1, n2) <= 8:
        # Ways to reach each rank sum, by number of picked ranks.
        top = n1 * n2
        ways = np.zeros((n1 + 1, top + 1))
        ways[0, 0] = 1.0
        for j in range(1, n1 + n2 + 1):
            for k in range(min(j, n1), 0, -1):
                gain = j - k
                if gain <= top:
                    ways[k, gain:] += ways[k - 1, : top + 1 - gain]
        dist = ways[n1]
        return min(1.0, 2.0 * float(dist[math.ceil(big):].sum() / dist.sum()))
    n = n1 + n2
    var = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return math.nan
    return min(1.0, normal_two_sided(max(big - n1 * n2 / 2.0 - 0.5, 0.0) / math.sqrt(var)))


def _rows(fn, *cols: pd.Series) -> pd.Series:
    def one(values):
        if any(v is None or v != v for v in values):
            return None
        return fn(*values)

    return pd.Series([one(v) for v in zip(*cols)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _rows(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def t_ppf_975(df: pd.Series) -> pd.Series:
    return _rows(lambda d: t_quantile(0.975, d), df)


@F.pandas_udf(DoubleType())
def wilcoxon_p(
    w_plus: pd.Series, w_minus: pd.Series, n: pd.Series, ties: pd.Series, zeros: pd.Series
) -> pd.Series:
    return _rows(
        lambda a, b, k, tie, z: signed_rank_p(a, b, int(k), tie, int(z)),
        w_plus, w_minus, n, ties, zeros,
    )


@F.pandas_udf(DoubleType())
def mann_whitney_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return _rows(lambda a, b, c, tie: rank_sum_p(a, int(b), int(c), tie), u, n1, n2, ties)


def _scaled_erfc(z: float) -> float:
    """exp(z^2) erfc(z) for z >= 0."""
    if z < 25.0:
        return math.exp(z * z) * math.erfc(z)
    r = 1.0 / (2.0 * z * z)
    return (1.0 - r * (1.0 - 3.0 * r * (1.0 - 5.0 * r))) / (z * math.sqrt(math.pi))


# exp(z^2) erfc(z) / t with t = 2 / (2 + z) is smooth on (0, 1].
_ERFC = np.polynomial.chebyshev.chebinterpolate(
    lambda s: np.array([_scaled_erfc(4.0 / (v + 1.0) - 2.0) / ((v + 1.0) / 2.0) for v in s]), 40
)


def log_ndtr(x: np.ndarray) -> np.ndarray:
    """Logarithm of the standard normal distribution function."""
    x = np.asarray(x, dtype=float)
    z = np.abs(x) / math.sqrt(2.0)
    t = 2.0 / (2.0 + z)
    scaled = np.polynomial.chebyshev.chebval(2.0 * t - 1.0, _ERFC) * t
    left = math.log(0.5) + np.log(scaled) - z * z
    return np.where(x < 0, left, np.log1p(-np.exp(np.minimum(left, 0.0))))
