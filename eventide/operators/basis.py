"""Temporal bases and lagged designs.

A basis is a table ``lag_i, lag_t, col, w`` whose size is set by parameters
(lags times columns), so it may be broadcast whatever the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.core.series import Series, halo_rows


def _lags(start: float, stop: float, dt: float) -> int:
    return math.ceil((stop + 0.5 * dt - start) / dt)


def _bump(distance: Column) -> Column:
    return F.when(F.abs(distance) <= 1, 0.5 * (1 + F.cos(F.lit(math.pi) * distance))).otherwise(0.0)


def _grid(spark: SparkSession, start: float, stop: float, dt: float, count: int) -> DataFrame:
    n = _lags(start, stop, dt)
    lags = spark.range(n, numPartitions=1).select(F.col("id").cast("int").alias("lag_i"))
    return lags.select(
        "lag_i",
        (F.lit(start) + F.col("lag_i") * dt).alias("lag_t"),
        F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("col"),
    )


def _check(window, count, dt) -> tuple[float, float]:
    start, stop = map(float, window)
    if not start < stop:
        raise ValueError("window must contain increasing values")
    if count < 1:
        raise ValueError("count must be positive")
    if not dt > 0:
        raise ValueError("dt must be positive")
    return start, stop


def _linear(t: Column, col: Column, start: float, stop: float, count: int, dt: float) -> Column:
    step = (stop - start) / (count - 1) if count > 1 else stop - start
    width = max(step, dt)
    centre = F.lit(start) + col * F.lit(step if count > 1 else 0.0)
    return _bump((t - centre) / width)


def raised_cosine(
    spark: SparkSession, window: tuple[float, float], count: int, dt: float
) -> DataFrame:
    """Overlapping raised cosines with evenly spaced centres."""
    start, stop = _check(window, count, dt)
    g = _grid(spark, start, stop, dt, count)
    return g.withColumn("w", _linear(F.col("lag_t"), F.col("col"), start, stop, count, dt))


def zero_split(
    spark: SparkSession,
    window: tuple[float, float],
    count: int,
    dt: float,
    *,
    pre_count: int | None = None,
) -> DataFrame:
    """Raised cosines that are separate before and after time zero.

    Columns before zero vanish from zero on; later columns vanish up to the
    onset and have log-warped centres.
    """
    start, stop = _check(window, count, dt)
    if stop <= 0:
        return raised_cosine(spark, window, count, dt)
    if start < 0:
        if count < 2:
            raise ValueError("a basis across zero needs at least two columns")
        if pre_count is None:
            pre_count = min(max(round(count * abs(start) / (abs(start) + stop)), 1), count - 1)
        if not 1 <= pre_count < count:
            raise ValueError("pre_count must be between one and count - 1")
    else:
        pre_count = 0
    g = _grid(spark, start, stop, dt, count)
    g = g.withColumn(
        "lag_t", F.when(F.abs("lag_t") <= abs(dt) * 1e-8, 0.0).otherwise(F.col("lag_t"))
    )
    t, col = F.col("lag_t"), F.col("col")
    onset = max(start, 0.0)
    post = count - pre_count
    width = math.log1p(stop - onset) / post
    warped = F.log1p(F.greatest(t - onset, F.lit(0.0)))
    after = F.when(
        t > onset, _bump((warped - (col - pre_count + 1) * width) / width)
    ).otherwise(0.0)
    if pre_count == 0:
        return g.withColumn("w", after)
    before = F.when(t < 0, _linear(t, col, start, 0.0, pre_count, dt)).otherwise(0.0)
    return g.withColumn("w", F.when(col < pre_count, before).otherwise(after))


def signed_lags(basis: DataFrame, dt: float) -> DataFrame:
    """Replace the lag ordinal by the signed lag in samples."""
    return basis.withColumn("lag_i", F.rint(F.col("lag_t") / dt).cast("int"))


def apply_basis(
    events: DataFrame,
    basis: DataFrame,
    keys: list[str],
    lengths: DataFrame,
    lag_range: tuple[int, int],
    *,
    index: str = "i",
    value: str = "v",
    predictor: bool = False,
) -> DataFrame:
    """Design entries ``keys, index, col, x`` from the non-zero event samples.

    Default convention: ``x[t] = sum v[t - lag] w[lag]`` (a response after the
    event, zero beyond the edges).  With ``predictor`` the sign flips to
    ``v[t + lag]``.  ``basis``: ``lag_i`` (signed samples within
    ``lag_range``), ``col``, ``w``; ``lengths``: keys, ``n``.  Only occupied
    samples are expanded.
    """
    sign = -1 if predictor else 1
    lags = F.sequence(F.lit(lag_range[0]), F.lit(lag_range[1]))
    weights = F.broadcast(basis.filter("w <> 0").select("lag_i", "col", "w"))
    hits = events.filter(F.col(value) != 0).withColumn("lag_i", F.explode(lags)).join(
        weights, "lag_i"
    )
    placed = hits.withColumn(index, F.col(index) + sign * F.col("lag_i"))
    inside = placed.join(lengths, keys).filter((F.col(index) >= 0) & (F.col(index) < F.col("n")))
    return inside.groupBy(*keys, index, "col").agg(
        F.sum(F.col(value) * F.col("w")).alias("x")
    )


def wide_design(
    entries: DataFrame, rows: DataFrame, keys: list[str], columns: list[int], *, index: str = "i",
    prefix: str = "x",
) -> DataFrame:
    """Dense rows from sparse entries; absent entries are zero."""
    aggs = [
        F.coalesce(F.sum(F.when(F.col("col") == c, F.col("x"))), F.lit(0.0)).alias(f"{prefix}{c}")
        for c in columns
    ]
    wide = entries.groupBy(*keys, index).agg(*aggs)
    return rows.join(wide, [*keys, index], "left").fillna(0.0, [f"{prefix}{c}" for c in columns])


def lag_columns(
    df: DataFrame,
    s: Series,
    columns: dict[str, list[int]],
    *,
    leads: dict[str, tuple[str, int]] | None = None,
    sums: dict[str, tuple[str, int, int]] | None = None,
    edge_value: float | None = None,
) -> DataFrame:
    """Lagged copies ``<col>_lag<k>`` of regular samples indexed by ``s.t``.

    ``leads``: ``{out: (col, k)}``; ``sums``: ``{out: (col, first, last)}`` of
    following rows.  Row blocks carry a halo of the largest lag, so a series
    of any length is spread over tasks and the result equals ``lag`` over the
    whole series.
    """
    leads, sums = leads or {}, sums or {}
    back = max([k for ks in columns.values() for k in ks] + [0])
    fwd = max(
        [-k for ks in columns.values() for k in ks]
        + [k for _, k in leads.values()]
        + [b for _, _, b in sums.values()]
        + [0]
    )
    h = halo_rows(df, s, max(back, 0), max(fwd, 0))
    w = Window.partitionBy(*s.keys, "_block").orderBy(s.t)
    made = {}
    for c, ks in columns.items():
        for k in ks:
            name = f"{c}_lag{k}" if k >= 0 else f"{c}_lead{-k}"
            made[name] = F.lag(c, k).over(w) if k >= 0 else F.lead(c, -k).over(w)
    for out, (c, k) in leads.items():
        made[out] = F.lead(c, k).over(w)
    for out, (c, first, last) in sums.items():
        frame = w.rowsBetween(first, last)
        full = F.count(F.lit(1)).over(frame) == last - first + 1
        made[out] = F.when(full, F.sum(c).over(frame))
    x = h.withColumns(made).filter("_own").drop("_block", "_own")
    if edge_value is not None:
        x = x.fillna(edge_value, list(made))
    return x


def reconstruct_kernel(
    basis: DataFrame, coefficients: DataFrame, keys: list[str], out: str = "k"
) -> DataFrame:
    """Kernel per lag: ``sum_col w * coefficient`` (coefficients: keys, col, b)."""
    x = coefficients.join(F.broadcast(basis), "col")
    return x.groupBy(*keys, "lag_i", "lag_t").agg(F.sum(F.col("w") * F.col("b")).alias(out))


def predict_from_kernel(
    events: DataFrame,
    kernel: DataFrame,
    keys: list[str],
    rows: DataFrame,
    lag_range: tuple[int, int],
    *,
    index: str = "i",
    value: str = "v",
    intercept: float = 0.0,
) -> DataFrame:
    """Prediction ``intercept + sum v[t - lag] k[lag]`` without a design matrix."""
    lags = F.sequence(F.lit(lag_range[0]), F.lit(lag_range[1]))
    hits = events.filter(F.col(value) != 0).withColumn("lag_i", F.explode(lags)).join(
        F.broadcast(kernel.select("lag_i", "k")), "lag_i"
    )
    placed = hits.withColumn(index, F.col(index) + F.col("lag_i"))
    sums = placed.groupBy(*keys, index).agg(F.sum(F.col(value) * F.col("k")).alias("_p"))
    return rows.join(sums, [*keys, index], "left").withColumn(
        "prediction", F.coalesce("_p", F.lit(0.0)) + intercept
    ).drop("_p")
