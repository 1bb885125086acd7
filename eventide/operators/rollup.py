"""Hierarchical roll-ups: trial -> session -> mouse -> group, means of means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.core.numeric import sem
from eventide.core.ranks import percentiles


def roll_up(
    trials: DataFrame,
    *,
    at: list[str],
    session: list[str],
    mouse: list[str],
    group: list[str],
    value: str = "v",
) -> DataFrame:
    """Group mean, SEM and mouse count; every mouse weighs the same.

    ``session``, ``mouse`` and ``group`` name nested key columns, ``at`` the
    columns kept through all levels (a lag, a metric).  Each level is a
    partial-aggregated groupBy, so a hot mouse is reduced before the shuffle.
    """
    per_session = trials.groupBy(*group, *mouse, *session, *at).agg(F.avg(value).alias(value))
    per_mouse = per_session.groupBy(*group, *mouse, *at).agg(F.avg(value).alias(value))
    return per_mouse.groupBy(*group, *at).agg(
        F.avg(value).alias("mean"),
        sem(value).alias("sem"),
        F.count(value).alias("n_mice"),
    )


def mouse_metrics(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Session metrics (``value``, ``n_trials``) to one row per ``keys``."""
    return sessions.groupBy(*keys).agg(
        F.avg("value").alias("value"),
        F.count(F.lit(1)).alias("n_sessions"),
        F.sum("n_trials").alias("n_trials"),
    )


def group_metrics(mice: DataFrame, keys: list[str]) -> DataFrame:
    return mice.groupBy(*keys).agg(
        F.avg("value").alias("mean"), sem("value").alias("sem"), F.count("value").alias("n_mice")
    )


def trial_metrics(trials: DataFrame, session: list[str], mouse: list[str]) -> tuple[DataFrame, DataFrame]:
    """Trial values to session mean / sd / n, then to an equal-weight mouse mean."""
    per_session = trials.groupBy(*session).agg(
        F.avg("value").alias("value"),
        F.stddev_samp("value").alias("sd"),
        F.count("value").alias("n_trials"),
    )
    per_mouse = per_session.groupBy(*mouse).agg(
        F.avg("value").alias("value"),
        F.count(F.lit(1)).alias("n_sessions"),
        F.sum("n_trials").alias("n_trials"),
    )
    return per_session, per_mouse


def robust_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, SEM, median and quartiles (exact, linear interpolation)."""
    q = percentiles(df, keys, value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    m = df.groupBy(*keys).agg(F.avg(value).alias("mean"), sem(value).alias("sem"))
    return m.join(q, keys)


def tumbling_bins(
    df: DataFrame,
    keys: list[str],
    k: int,
    *,
    index: str = "i",
    value: str = "v",
    reducer: str = "sum",
) -> DataFrame:
    """Groups of ``k`` adjacent samples; an incomplete last group is dropped."""
    agg = {"sum": F.sum, "mean": F.avg}[reducer]
    return (
        df.groupBy(*keys, F.floor(F.col(index) / k).alias("bin"))
        .agg(agg(value).alias(value), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == k)
        .drop("_n")
    )


def block_reduce(
    df: DataFrame, keys: list[str], k: int, *, index: str = "i", value: str = "v"
) -> DataFrame:
    """Block mean, sum and any over ``k`` samples, skipping missing values."""
    return df.groupBy(*keys, F.floor(F.col(index) / k).alias("bin")).agg(
        F.avg(value).alias("block_mean"),
        F.coalesce(F.sum(value), F.lit(0.0)).alias("block_sum"),
        F.coalesce(F.max(F.col(value) != 0), F.lit(False)).alias("block_any"),
        F.count(F.lit(1)).alias("n"),
    )


def paired_difference(
    mice: DataFrame,
    *,
    condition: str,
    first: str | Column,
    second: str | Column,
    mouse: list[str],
    at: list[str],
    group: list[str],
    value: str = "v",
) -> DataFrame:
    """Second minus first condition for mice that have both; mean and SEM."""
    a = F.max(F.when(F.col(condition) == first, F.col(value)))
    b = F.max(F.when(F.col(condition) == second, F.col(value)))
    per_mouse = (
        mice.groupBy(*group, *mouse, *at)
        .agg((b - a).alias("_d"))
        .filter(F.col("_d").isNotNull())
    )
    return per_mouse.groupBy(*group, *at).agg(
        F.avg("_d").alias("mean"), sem("_d").alias("sem"), F.count("_d").alias("n_mice")
    )


def pivot_wide(mice: DataFrame, columns: list[str], *, mouse: str = "mouse") -> DataFrame:
    """One row per mouse, one column per ``group__condition__metric``.

    The column list is passed in, so the pivot needs no extra job.
    """
    label = F.concat_ws("__", "grp", "cond", "metric")
    return mice.withColumn("_c", label).groupBy(mouse).pivot("_c", columns).agg(F.max("value"))


def transform_series(
    df: DataFrame, keys: list[str], mode: str, *, value: str = "v"
) -> DataFrame:
    """Whole-session transform: native, mean subtraction or population z-score."""
    if mode == "native":
        return df
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias("_m"), F.stddev_pop(value).alias("_sd")
    )
    x = df.join(stats, keys)
    shifted = F.col(value) - F.col("_m")
    if mode == "zscore":
        shifted = shifted / F.when(F.col("_sd") > 0, F.col("_sd"))
    elif mode != "subtract":
        raise ValueError("mode must be 'native', 'subtract' or 'zscore'")
    return x.withColumn(value, shifted).drop("_m", "_sd")


def contiguous_blocks(df: DataFrame, keys: list[str], k: int, *, index: str = "i") -> DataFrame:
    """Assign ``k`` near-equal blocks of ordered rows, larger blocks first.

    ``index`` is the zero-based position; needs one count per series instead
    of a sort (``ntile`` would sort a whole series in one task).
    """
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    x = df.join(n, keys)
    i, size, extra = F.col(index), F.floor(F.col("_n") / k), F.pmod(F.col("_n"), F.lit(k))
    head = (size + 1) * extra
    # Rows past the larger blocks exist only when the small blocks are not empty.
    block = F.when(i < head, F.floor(i / (size + 1))).otherwise(
        extra + F.floor((i - head) / F.when(size > 0, size))
    )
    return x.withColumn("block", block.cast("bigint")).drop("_n")


def decimate(df: DataFrame, keys: list[str], max_points: int, *, index: str = "i") -> DataFrame:
    """At most ``max_points`` rows per series at truncated linspace positions."""
    if max_points < 2:
        raise ValueError("max_points must be at least two")
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    x = df.join(n, keys)
    i, m = F.col(index), F.lit(max_points - 1)
    step = (F.col("_n") - 1) / m
    # Row i is picked when some j has trunc(j * step) == i.
    j = F.ceil(i / step)
    picked = (F.floor(j * step) == i) | (F.floor((j - 1) * step) == i) | (
        F.floor((j + 1) * step) == i
    )
    return x.filter((F.col("_n") <= max_points) | picked).drop("_n")


def correlation(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    g = df.filter(both).groupBy(*keys) if keys else df.filter(both).groupBy()
    return g.agg(F.corr(a, b).alias("r"), F.count(F.lit(1)).alias("n")).withColumn(
        "r", F.when(F.col("n") >= 3, F.col("r"))
    )


def best_channel(correlations: DataFrame, keys: list[str]) -> DataFrame:
    """Channel with the highest correlation per series (first channel on ties)."""
    w = Window.partitionBy(*keys).orderBy(F.col("r").desc_nulls_last(), "channel")
    return correlations.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
