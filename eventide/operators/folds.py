"""Cross-validation folds as small range tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _split(k: int, total: str, offset: str = "0") -> list[str]:
    """Start and stop of part ``fold`` when ``total`` items form ``k`` parts."""
    size, extra = f"floor({total} / {k})", f"pmod({total}, {k})"
    start = f"{offset} + fold * {size} + least(fold, {extra})"
    return [f"CAST({start} AS BIGINT) AS test_start",
            f"CAST({start} + {size} + IF(fold < {extra}, 1, 0) AS BIGINT) AS test_stop"]


def blocked_folds(sizes: DataFrame, keys: list[str], n_folds: int = 5, gap: int = 0) -> DataFrame:
    """Contiguous test blocks; training rows keep ``gap`` rows from the block.

    ``sizes``: keys, n.  Output: keys, fold, test_start, test_stop (half-open),
    train_before (rows below are training), train_after (rows from here on).
    """
    x = sizes.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    x = x.selectExpr(*keys, "n", "fold", *_split(n_folds, "n"))
    return x.selectExpr(
        *keys, "fold", "test_start", "test_stop",
        f"greatest(0, test_start - {gap}) AS train_before",
        f"least(n, test_stop + {gap}) AS train_after",
        "n",
    )


def forward_folds(
    sizes: DataFrame,
    keys: list[str],
    *,
    n_folds: int = 5,
    initial_train_fraction: float = 0.5,
) -> DataFrame:
    """Expanding-window test ranges over row positions (``sizes``: keys, n)."""
    x = sizes.withColumn("_first", F.ceil(F.col("n") * initial_train_fraction).cast("bigint"))
    x = x.withColumn("_rest", F.col("n") - F.col("_first"))
    x = x.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    return x.selectExpr(*keys, "n", "fold", *_split(n_folds, "_rest", "_first"))


def assign_forward(
    rows: DataFrame, folds: DataFrame, keys: list[str], *, index: str = "i", t: str = "t",
    gap: float = 0.0,
) -> DataFrame:
    """Rows with ``fold, role``; training times lie strictly before start - gap.

    A row occurs once per fold that uses it, at most ``n_folds`` times.
    """
    starts = rows.join(folds, keys).filter(F.col(index) == F.col("test_start")).select(
        *keys, "fold", "test_start", "test_stop", (F.col(t) - gap).alias("_cutoff")
    )
    x = rows.join(starts, keys)
    test = (F.col(index) >= F.col("test_start")) & (F.col(index) < F.col("test_stop"))
    role = F.when(test, "test").when(F.col(t) < F.col("_cutoff"), "train")
    return x.withColumn("role", role).filter(F.col("role").isNotNull()).drop(
        "test_start", "test_stop", "_cutoff"
    )


def group_folds(rows: DataFrame, group: str) -> DataFrame:
    """One fold per group, sorted by group."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_test"))
