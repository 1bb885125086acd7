"""Response metrics of peri-event traces (long form: one row per lag)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.core.numeric import check_window

# Metric names by signal type.
TRACE_METRICS = ("mean", "auc", "peak", "peak_latency")
ALL_TRACE = (
    "mean", "auc", "positive_auc", "negative_auc",
    "peak", "peak_latency", "trough", "trough_latency",
)
LICK_METRICS = ("lick_count", "any_lick", "first_lick_latency")
RUN_METRICS = ("distance", "moving_fraction", "movement_onset_latency")


def metrics_for(signal_type: str) -> tuple[str, ...]:
    table = {"photometry": ALL_TRACE, "licking": LICK_METRICS, "running": RUN_METRICS}
    if signal_type not in table:
        raise ValueError(f"unknown signal type: {signal_type}")
    return table[signal_type]


def smoothing_width(peak_smoothing: float, dt: float, n: int) -> int:
    """Odd boxcar width: rounded half-even, capped at ``n``."""
    width = min(max(1, round(peak_smoothing / dt)), n)
    return width if width % 2 else width - 1


def moving_average(
    df: DataFrame, keys: list[str], order: str, samples: int, *, value: str = "v", out: str = "sm"
) -> DataFrame:
    """Centred boxcar over ``samples`` rows that skips missing values.

    A trace is bounded by its lag grid, so one window per trace is enough.
    """
    if samples % 2 == 0:
        samples -= 1
    h = (samples - 1) // 2
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-h, h)
    return df.withColumn(out, F.avg(value).over(w))


def _trapezoid(v: Column, nxt: Column, step: Column) -> Column:
    return F.sum((v + nxt) / 2 * step)


def response_metrics(
    traces: DataFrame,
    keys: list[str],
    *,
    window: tuple[float, float] = (0.0, 2.0),
    dt: float,
    n_lags: int,
    metrics: tuple[str, ...] = TRACE_METRICS,
    peak_smoothing: float = 0.1,
    movement_threshold: float = 1.0,
    value: str = "v",
    t: str = "rel_t",
) -> DataFrame:
    """One row per trace with a column per metric.

    The window is closed.  Missing values are skipped, except that an area
    with a missing sample is missing; the first extremum wins.
    """
    lo, hi = check_window(window)
    wanted = set(metrics)
    order = Window.partitionBy(*keys).orderBy(t)
    v = F.col(value)
    x = traces
    smooth = {"peak", "peak_latency", "trough", "trough_latency"} & wanted
    if smooth:
        # Smoothing sees the whole trace, before the window is cut.
        x = moving_average(x, keys, t, smoothing_width(peak_smoothing, dt, n_lags), value=value)
    x = x.filter(F.col(t).between(lo, hi))
    if {"auc", "positive_auc", "negative_auc"} & wanted:
        x = x.withColumns({"_nv": F.lead(value).over(order), "_nt": F.lead(t).over(order)})
    if smooth:
        whole = Window.partitionBy(*keys)
        x = x.withColumns({"_mx": F.max("sm").over(whole), "_mn": F.min("sm").over(whole)})
    whole_trace = F.count(value) == F.count(F.lit(1))
    step = F.col("_nt") - F.col(t)

    def clipped(f) -> Column:
        a = F.when(v.isNotNull(), f(v, F.lit(0.0)))
        b = F.when(F.col("_nv").isNotNull(), f(F.col("_nv"), F.lit(0.0)))
        return F.when(whole_trace, _trapezoid(a, b, step))

    above = F.sum(F.when(v.isNotNull(), F.greatest(v, F.lit(0.0)))) * dt
    definitions = {
        "mean": lambda: F.avg(value),
        "auc": lambda: F.when(whole_trace, _trapezoid(v, F.col("_nv"), step)),
        "positive_auc": lambda: clipped(F.greatest),
        "negative_auc": lambda: clipped(F.least),
        "lick_count": lambda: above,
        "distance": lambda: above,
        "any_lick": lambda: F.max((v > 0).cast("double")),
        "first_lick_latency": lambda: F.min(F.when(v > 0, F.col(t))),
        "moving_fraction": lambda: F.avg((v > movement_threshold).cast("double")),
        "movement_onset_latency": lambda: F.min(F.when(v > movement_threshold, F.col(t))),
        "peak": lambda: F.max("sm"),
        "peak_latency": lambda: F.min(F.when(F.col("sm") == F.col("_mx"), F.col(t))),
        "trough": lambda: F.min("sm"),
        "trough_latency": lambda: F.min(F.when(F.col("sm") == F.col("_mn"), F.col(t))),
    }
    unknown = wanted - definitions.keys()
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    return x.groupBy(*keys).agg(*[definitions[m]().alias(m) for m in metrics])


def metric_long(wide: DataFrame, keys: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """Wide metrics to rows ``metric, value``."""
    return wide.unpivot(keys, list(metrics), "metric", "value")


def metric_units(signal_units: str, signal_type: str = "photometry") -> Column:
    """Unit text of the ``metric`` column."""
    m = F.col("metric")
    return (
        F.when(m.endswith("latency"), "s")
        .when(m == "lick_count", "licks")
        .when(m == "distance", "cm")
        .when(m.isin("any_lick", "moving_fraction"), "proportion")
        .when(m.endswith("auc"), f"{signal_units}*s")
        .otherwise(signal_units)
    )


def smooth_rate(
    df: DataFrame, keys: list[str], order: str, *, rate_hz: float, seconds: float = 0.5,
    value: str = "v",
) -> DataFrame:
    """Zero-padded boxcar event rate; edges divide by the full width."""
    width = max(1, round(seconds * rate_hz))
    back = width // 2
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-back, width - 1 - back)
    return df.withColumn("rate", F.sum(value).over(w) / F.lit(width / rate_hz))
