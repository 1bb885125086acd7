"""Small column expressions with the NaN and rounding rules of the domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite_or_null(c: Column | str) -> Column:
    """NaN and infinities become NULL, so that SQL aggregates skip them."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(~bad, c)


def nan_to_null(c: Column | str) -> Column:
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(c), c)


def clean(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: finite_or_null(c) for c in cols})


def sem(c: Column | str) -> Column:
    """Standard error with ddof 1; NULL for fewer than two values."""
    return F.stddev_samp(c) / F.sqrt(F.count(c))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def lag_count(window: tuple[float, float], dt: float) -> int:
    """Index of the last point of a lag grid (round half up)."""
    start, end = check_window(window)
    if not dt > 0:
        raise ValueError("dt must be finite and positive")
    return int((end - start) / dt + 0.5)


def check_window(window: tuple[float, float]) -> tuple[float, float]:
    if len(window) != 2 or not float(window[0]) < float(window[1]):
        raise ValueError("window must contain increasing start and end values")
    return float(window[0]), float(window[1])
