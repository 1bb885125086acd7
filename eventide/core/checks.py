"""Input contracts.  A check is one small aggregation; operators stay lazy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.core.series import Series, shift


class ContractError(ValueError):
    """An input table violates a documented contract."""


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "table") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"{what} lacks columns: {', '.join(missing)}")


def require_none(df: DataFrame, message: str) -> None:
    """Raise when the frame of violations holds any row; show one of them."""
    bad = df.limit(1).collect()
    if bad:
        raise ContractError(f"{message}: {bad[0].asDict()}")


def require_rows(df: DataFrame, message: str) -> None:
    if df.isEmpty():
        raise ContractError(message)


def not_increasing(df: DataFrame, s: Series) -> DataFrame:
    """Rows whose time is missing, infinite or not after the previous row.

    Ties share a block and an order position, so they show up as equal
    neighbours.
    """
    t = F.col(s.t)
    odd = df.filter(t.isNull() | F.isnan(t) | (F.abs(t) == F.lit(float("inf"))))
    stepped = shift(df.select(*s.keys, s.t), s, back={"_prev": s.t})
    return odd.select(*s.keys, s.t).unionByName(
        stepped.filter(F.col("_prev") >= t).select(*s.keys, s.t)
    )


def require_series(df: DataFrame, s: Series, what: str = "signal") -> None:
    require_columns(df, [*s.keys, s.t], what)
    require_none(not_increasing(df, s), f"{what} times must be finite and strictly increasing")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
