"""Event-aligned windows: extraction, normalisation, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.core.numeric import check_window, lag_count, sem
from eventide.core.series import Series, asof, shift


def lag_grid(window: tuple[float, float], dt: float) -> Column:
    """Array of ``(lag_i, rel_t)``; times by multiplication, never accumulated."""
    start, _ = check_window(window)
    return F.transform(
        F.sequence(F.lit(0), F.lit(lag_count(window, dt))),
        lambda i: F.struct(i.alias("lag_i"), (F.lit(start) + i * F.lit(float(dt))).alias("rel_t")),
    )


def interpolate(
    queries: DataFrame,
    samples: DataFrame,
    s: Series,
    *,
    value: str = "v",
    out: str = "v",
    clamp: bool = False,
) -> DataFrame:
    """Linear interpolation of a sampled signal at query times.

    Outside the samples the result is NULL, or the end value with ``clamp``.
    A missing value (NULL sample) next to a query makes the result NULL.
    """
    kept = [c for c in queries.columns if c != out]
    if not clamp:
        # Samples know their successor, so one backward scan finds the segment.
        segments = shift(
            samples.select(*s.keys, s.t, value), s, ahead={"_t1": s.t, "_v1": value}
        )
        x = asof(
            queries, segments, s,
            back={"_t0": s.t, "_v0": value, "_t1": "_t1", "_v1": "_v1"},
        )
        return x.selectExpr(
            *kept,
            f"IF({s.t} = _t0, _v0, _v0 + ({s.t} - _t0) * ((_v1 - _v0) / (_t1 - _t0))) AS {out}",
        )
    x = asof(
        queries,
        samples.select(*s.keys, s.t, value),
        s,
        back={"_t0": s.t, "_v0": value},
        ahead={"_t1": s.t, "_v1": value},
    )
    # A query on a sample finds that sample on both sides.
    between = f"IF(_t0 = _t1, _v0, _v0 + ({s.t} - _t0) * ((_v1 - _v0) / (_t1 - _t0)))"
    return x.selectExpr(
        *kept, f"CASE WHEN _t0 IS NULL THEN _v1 WHEN _t1 IS NULL THEN _v0 ELSE {between} END AS {out}"
    )


def complete_windows(
    events: DataFrame, bounds: DataFrame, s: Series, window: tuple[float, float]
) -> DataFrame:
    """Events whose window lies inside the recording ``[lo, hi]``, both inclusive."""
    start, end = check_window(window)
    e = F.col(s.t)
    x = events.join(bounds, list(s.keys))
    return x.filter((e + start >= F.col("lo")) & (e + end <= F.col("hi"))).drop("lo", "hi")


def recording_bounds(samples: DataFrame, s: Series) -> DataFrame:
    return samples.groupBy(*s.keys).agg(F.min(s.t).alias("lo"), F.max(s.t).alias("hi"))


def extract(
    samples: DataFrame,
    events: DataFrame,
    s: Series,
    window: tuple[float, float] = (-5.0, 10.0),
    dt: float = 0.02,
    *,
    require_complete: bool = True,
    value: str = "v",
    event_id: str = "event_i",
) -> DataFrame:
    """Interpolated trials: events columns plus ``lag_i, rel_t, v``.

    ``events`` carries keys, ``s.t`` and ``event_id``.  With
    ``require_complete`` the end points of the window are probed first, so an
    incomplete event never reaches the lag grid.
    """
    start, end = check_window(window)
    base = events.withColumn("event_t", F.col(s.t))
    if require_complete:
        base = complete_windows(base, recording_bounds(samples, s), s, window)
    grid = base.withColumn("_lag", F.explode(lag_grid(window, dt))).select(
        *[F.col(c) for c in base.columns if c != s.t],
        F.col("_lag.lag_i").alias("lag_i"),
        F.col("_lag.rel_t").alias("rel_t"),
        (F.col("event_t") + F.col("_lag.rel_t")).alias(s.t),
    )
    return interpolate(grid, samples, s, value=value).drop(s.t)


def normalise(
    trials: DataFrame,
    trial_keys: list[str],
    *,
    mode: str = "zscore",
    baseline: tuple[float, float] = (-5.0, 0.0),
    value: str = "v",
) -> DataFrame:
    """Per-trial baseline subtraction or z-score over ``[b0, b1)``."""
    if mode == "none":
        return trials
    if mode not in ("subtract", "zscore"):
        raise ValueError("mode must be 'none', 'subtract' or 'zscore'")
    b0, b1 = check_window(baseline)
    w = Window.partitionBy(*trial_keys)
    rel = F.col("rel_t")
    base = F.when((rel >= b0) & (rel < b1), F.col(value))
    shifted = F.col(value) - F.avg(base).over(w)
    if mode == "zscore":
        sd = F.stddev_samp(base).over(w)
        shifted = shifted / F.when(sd > 0, sd)
    return trials.withColumn(value, shifted)


def event_rate(
    events: DataFrame,
    alignments: DataFrame,
    s: Series,
    window: tuple[float, float] = (-5.0, 10.0),
    dt: float = 0.1,
    *,
    bounds: DataFrame | None = None,
    require_complete: bool = True,
    event_id: str = "event_i",
) -> DataFrame:
    """Rate histogram around alignments, zero bins included.

    Bins are half-open, the last one closed.  A bin count is the difference of
    two running counts at its edges, so dense trains cost no event pairs.
    """
    start, end = check_window(window)
    n = lag_count(window, dt)
    if n < 1 or abs(n * dt - (end - start)) > 1e-8 + 1e-5 * abs(end - start):
        raise ValueError("the window must be divisible by dt")
    base = alignments.withColumn("event_t", F.col(s.t))
    if bounds is not None and require_complete:
        base = complete_windows(base, bounds, s, window)
    edges = base.withColumn("_e", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn(
        s.t, F.col("event_t") + (F.lit(start) + F.col("_e") * dt)
    )
    train = events.select(*s.keys, s.t)
    one = {"_c": "1L"}
    inner = asof(edges.filter(F.col("_e") < n), train, s, totals=one, back_inclusive=False)
    final = asof(edges.filter(F.col("_e") == n), train, s, totals=one)
    cumulative = inner.unionByName(final)
    order = Window.partitionBy(*s.keys, event_id).orderBy("_e")
    rate = (F.lead("_c").over(order) - F.col("_c")) / F.lit(float(dt))
    out = (
        cumulative.withColumn("v", rate)
        .filter(F.col("_e") < n)
        .withColumn("rel_t", F.lit(start) + F.col("_e") * dt + dt / 2)
        .withColumnRenamed("_e", "lag_i")
        .drop("_c", s.t)
    )
    if bounds is not None and not require_complete:
        centre = F.col("event_t") + F.col("rel_t")
        out = (
            out.join(bounds, list(s.keys))
            .withColumn("v", F.when(centre.between(F.col("lo"), F.col("hi")), F.col("v")))
            .drop("lo", "hi")
        )
    return out


def native_samples(
    samples: DataFrame, events: DataFrame, s: Series, window: tuple[float, float]
) -> DataFrame:
    """Recorded samples inside each event window, without resampling.

    The join key holds the time cell of window length, so a sample meets only
    events whose window touches its cell.
    """
    start, end = check_window(window)
    span = end - start
    cell = F.floor(F.col(s.t) / span)
    left = events.withColumn("event_t", F.col(s.t)).withColumn(
        "_cell",
        F.explode(
            F.sequence(
                F.floor((F.col(s.t) + start) / span), F.floor((F.col(s.t) + end) / span)
            )
        ),
    ).drop(s.t)
    right = samples.withColumn("_cell", cell)
    rel = F.col(s.t) - F.col("event_t")
    return (
        left.join(right, [*s.keys, "_cell"])
        .withColumn("rel_t", rel)
        .filter(F.col("rel_t").between(start, end))
        .drop("_cell", s.t)
    )


def mean_and_sem(df: DataFrame, keys: list[str], value: str = "v", n: str = "n") -> DataFrame:
    """Mean, SEM (ddof 1, NULL below two values) and count per group."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), sem(value).alias("sem"), F.count(value).alias(n)
    )
