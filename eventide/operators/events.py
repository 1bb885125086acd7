"""Event detection: pulses, merged pulses, bouts and their grid features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.core.series import Series, asof, running, runs, shift


def midrange_threshold(df: DataFrame, s: Series, value: str = "v") -> DataFrame:
    """Half-way level between minimum and maximum of every series."""
    return df.groupBy(*s.keys).agg(((F.min(value) + F.max(value)) * 0.5).alias("threshold"))


def pulses(
    df: DataFrame,
    s: Series,
    *,
    value: str = "v",
    index: str = "i",
    threshold: float | Column = 1.5,
    min_width: float | None = None,
    max_width: float | None = None,
    include_boundary: bool = True,
    width_in: str = "time",
) -> DataFrame:
    """High pulses of a digital channel.

    High means strictly above the threshold.  The offset is the first low
    sample (the last sample when a pulse is still high at the end).  Width
    limits are inclusive.  ``width_in='samples'`` measures the width in rows.
    Output: keys, ``onset_t, offset_t, rise_i, fall_i``.
    """
    level = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    base = df.select(
        *s.keys, s.t, F.col(index).alias("_i"), (F.col(value) > level).alias("_hi")
    )
    x = shift(base, s, back={"_was": "_hi"}, ahead={"_next": "_hi"})
    first, last = F.col("_was").isNull(), F.col("_next").isNull()
    rises = F.when(first, F.col("_hi") & F.lit(include_boundary)).otherwise(
        F.col("_hi") & ~F.col("_was")
    )
    falls = F.when(first, F.lit(False)).otherwise(~F.col("_hi") & F.col("_was"))
    if include_boundary:
        falls = falls | (last & F.col("_hi") & ~first)
    # A pulse that starts on the very last sample has no later fall and is
    # dropped, so its row counts as a rise only.
    edges = (
        x.withColumn("_rise", rises)
        .withColumn("_fall", falls & ~(rises & last))
        .filter("_rise or _fall")
    )
    paired = shift(
        edges.select(*s.keys, s.t, "_i", "_rise"),
        s,
        ahead={"_off_t": s.t, "_off_i": "_i", "_off_rise": "_rise"},
    )
    out = paired.filter(F.col("_rise") & F.col("_off_t").isNotNull() & ~F.col("_off_rise")).select(
        *s.keys,
        F.col(s.t).alias("onset_t"),
        F.col("_off_t").alias("offset_t"),
        F.col("_i").alias("rise_i"),
        F.col("_off_i").alias("fall_i"),
    )
    width = (
        F.col("fall_i") - F.col("rise_i")
        if width_in == "samples"
        else F.col("offset_t") - F.col("onset_t")
    )
    if min_width is not None:
        out = out.filter(width >= min_width)
    if max_width is not None:
        out = out.filter(width <= max_width)
    return out


def merge_pulses(
    df: DataFrame,
    s: Series,
    *,
    max_gap: float = 0.5,
    onset: str = "onset_t",
    offset: str = "offset_t",
) -> DataFrame:
    """Join pulses whose gap (onset minus previous offset) is at most ``max_gap``."""
    series = Series(s.keys, onset, s.width)
    x = runs(
        df.select(*s.keys, onset, offset),
        series,
        f"{onset} - _before > {float(max_gap)!r}D",
        before={"_before": offset},
    )
    return (
        x.groupBy(*s.keys, "_run")
        .agg(
            F.min(onset).alias(onset),
            F.max(offset).alias(offset),
            F.count(F.lit(1)).alias("n_pulses"),
        )
        .drop("_run")
    )


def bouts(
    df: DataFrame,
    s: Series,
    *,
    max_gap: float = 1.0,
    min_count: int = 5,
) -> DataFrame:
    """Groups of events separated by at most ``max_gap``.

    Output: keys, ``onset_t, offset_t, n, start_i, stop_i`` with a half-open
    index range, ``offset_t`` being the time of the last event.
    """
    if max_gap <= 0:
        raise ValueError("max_gap must be positive")
    if min_count < 1:
        raise ValueError("min_count must be at least one")
    x = runs(
        df.select(*s.keys, s.t),
        s,
        f"{s.t} - _before > {float(max_gap)!r}D",
        before={"_before": s.t},
    )
    return (
        x.groupBy(*s.keys, "_run")
        .agg(
            F.min(s.t).alias("onset_t"),
            F.max(s.t).alias("offset_t"),
            F.count(F.lit(1)).alias("n"),
            F.min(F.col("_pos") - 1).alias("start_i"),
            F.max("_pos").alias("stop_i"),
        )
        .filter(F.col("n") >= min_count)
        .drop("_run")
    )


def grid_bin(t: Column, t0: Column | float, dt: float) -> Column:
    """Bin of a time on a regular grid with edges half a step around it."""
    t0 = t0 if isinstance(t0, Column) else F.lit(float(t0))
    return F.floor((t - (t0 - dt / 2)) / dt).cast("bigint")


def event_counts_on_grid(
    df: DataFrame, s: Series, bounds: DataFrame, dt: float, out: str = "n"
) -> DataFrame:
    """Events per grid sample; the last edge is closed.

    ``bounds`` holds keys, ``t0`` (first sample time) and ``n_bins``.  Only
    occupied bins are returned.
    """
    x = df.join(bounds, list(s.keys))
    raw = grid_bin(F.col(s.t), F.col("t0"), dt)
    right_edge = F.col("t0") + (F.col("n_bins") - 0.5) * dt
    k = F.when(F.col(s.t) == right_edge, F.col("n_bins") - 1).otherwise(raw)
    return (
        x.withColumn("bin", k)
        .filter((F.col("bin") >= 0) & (F.col("bin") < F.col("n_bins")))
        .groupBy(*s.keys, "bin")
        .agg(F.count(F.lit(1)).alias(out))
    )


def bout_grid_features(
    found: DataFrame, s: Series, bounds: DataFrame, dt: float
) -> DataFrame:
    """Bout onsets, durations and occupancy on a regular grid.

    Returns the bins that hold any of the three; a bout covers every bin from
    its onset to its offset.  ``bounds``: keys, ``t0``, ``n_bins``.
    """
    x = found.join(bounds, list(s.keys))
    last_bin = F.col("n_bins") - 1
    right_edge = F.col("t0") + (F.col("n_bins") - 0.5) * dt
    first = F.when(F.col("onset_t") == right_edge, last_bin).otherwise(
        grid_bin(F.col("onset_t"), F.col("t0"), dt)
    )
    stop = F.least(grid_bin(F.col("offset_t"), F.col("t0"), dt), last_bin)
    x = x.withColumn("_a", first).withColumn("_b", stop)
    x = x.filter((F.col("_a") >= 0) & (F.col("_a") <= last_bin))
    x = x.withColumn("bin", F.explode(F.sequence("_a", F.greatest("_a", "_b"))))
    at_onset = F.col("bin") == F.col("_a")
    return x.groupBy(*s.keys, "bin").agg(
        F.sum(F.when(at_onset, 1).otherwise(0)).alias("onset_count"),
        F.sum(F.when(at_onset, F.col("offset_t") - F.col("onset_t")).otherwise(0.0)).alias(
            "duration_at_onset"
        ),
        F.lit(1).alias("occupancy"),
    )


def trial_bout_features(
    licks: DataFrame,
    keys: tuple[str, ...],
    *,
    sample: str = "k",
    rate_hz: float,
    max_gap: float = 1.0,
    min_count: int = 3,
    width: float | None = None,
) -> DataFrame:
    """Bout features of event samples inside trials (a trial is one series).

    Rows: keys, sample, ``onset, size, occupancy, rate``; the duration of a
    bout is ``(last - first + 1) / rate_hz`` and its rate ``n / duration``.
    """
    s = Series(keys, "_t", width)
    found = bouts(
        licks.select(*keys, (F.col(sample) / rate_hz).alias("_t")),
        s,
        max_gap=max_gap,
        min_count=min_count,
    )
    first = F.rint(F.col("onset_t") * rate_hz).cast("bigint")
    last = F.rint(F.col("offset_t") * rate_hz).cast("bigint")
    x = found.select(*keys, first.alias("_a"), last.alias("_b"), "n").withColumn(
        sample, F.explode(F.sequence("_a", "_b"))
    )
    duration = F.greatest((F.col("_b") - F.col("_a") + 1) / rate_hz, F.lit(1.0 / rate_hz))
    at_onset = F.col(sample) == F.col("_a")
    return x.select(
        *keys,
        sample,
        F.when(at_onset, 1.0).otherwise(0.0).alias("onset"),
        F.when(at_onset, F.col("n").cast("double")).otherwise(0.0).alias("size"),
        F.lit(1.0).alias("occupancy"),
        (F.col("n") / duration).alias("rate"),
    )


def signal_quality(
    df: DataFrame, keys: tuple[str, ...], value: str = "v", *, tolerance: float = 1e-12
) -> DataFrame:
    """One quality row per series: empty and flat-zero signals are invalid."""
    v = F.col(value)
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    q = df.groupBy(*keys).agg(
        F.count(finite).alias("n"),
        F.min(finite).alias("minimum"),
        F.max(finite).alias("maximum"),
        (F.max(finite) - F.min(finite)).alias("peak_to_peak"),
        F.stddev_pop(finite).alias("sd"),
        F.max(F.abs(finite)).alias("max_abs"),
    )
    status = (
        F.when(F.col("n") == 0, "invalid_empty")
        .when(F.col("max_abs") <= tolerance, "invalid_flat_zero")
        .otherwise("valid")
    )
    return q.withColumn("status", status)


def local_maxima(
    df: DataFrame, s: Series, *, value: str = "v", index: str = "i", height: float = 2.0
) -> DataFrame:
    """Peaks of at least ``height``; a plateau reports its middle sample."""
    x = runs(
        df.select(*s.keys, s.t, index, value),
        s,
        f"{value} <> _before",
        before={"_before": value},
        using=[value],
    )
    plateaus = x.groupBy(*s.keys, "_run").agg(
        F.min(s.t).alias(s.t),
        F.min(index).alias("_i0"),
        F.max(index).alias("_i1"),
        F.max(value).alias(value),
    )
    y = shift(plateaus, s, back={"_before": value}, ahead={"_after": value})
    v = F.col(value)
    return y.filter((v >= height) & (v > F.col("_before")) & (v > F.col("_after"))).select(
        *s.keys, F.floor((F.col("_i0") + F.col("_i1")) / 2).cast("bigint").alias(index), value
    )


def preceding_gap(df: DataFrame, s: Series, recording_start: str | None = None) -> DataFrame:
    """Time since the previous event; the recording start stands in for the first."""
    x = shift(df, s, back={"_prev": s.t})
    before = F.coalesce(F.col("_prev"), F.col(recording_start)) if recording_start else F.col("_prev")
    return x.withColumn("gap", F.col(s.t) - before).drop("_prev")


def coverage(df: DataFrame, bounds: DataFrame, keys: tuple[str, ...], t: str = "t") -> DataFrame:
    """Share of samples inside the recorded interval ``[lo, hi]`` of a series."""
    inside = F.col(t).between(F.col("lo"), F.col("hi")).cast("double")
    return df.join(bounds, list(keys)).groupBy(*keys).agg(F.avg(inside).alias("coverage"))


def bouts_with_delivery(
    found: DataFrame, deliveries: DataFrame, s: Series, window: tuple[float, float]
) -> DataFrame:
    """Flag bouts with a delivery in the closed window; latency of the last one."""
    q = found.withColumn("_at", F.col("onset_t") + window[1])
    hit = asof(
        q.withColumn(s.t, F.col("_at")),
        deliveries.select(*s.keys, s.t),
        s,
        back={"_d": s.t},
    )
    ok = F.col("_d") >= F.col("onset_t") + window[0]
    return hit.select(
        *[F.col(c) for c in found.columns if c != s.t],
        F.coalesce(ok, F.lit(False)).alias("has_delivery"),
        F.when(ok, F.col("_d") - F.col("onset_t")).alias("delivery_latency"),
    )


def delivery_progress(df: DataFrame, s: Series) -> DataFrame:
    """``ordinal`` k (1-based), ``n_total`` and ``progress`` (k-1)/(n-1)."""
    x = running(df, s, {"ordinal": "1L"})
    totals = df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("n_total"))
    x = x.join(totals, list(s.keys))
    k, n = F.col("ordinal"), F.col("n_total")
    return x.withColumn("progress", F.when(n > 1, (k - 1) / (n - 1)).otherwise(F.lit(0.0)))


def delivery_stage(progressed: DataFrame) -> DataFrame:
    """First delivery, then equal thirds of the rest by ``floor(3 k / n)``."""
    j, m = F.col("ordinal") - 2, F.col("n_total") - 1
    third = F.least(F.floor(3 * j / m), F.lit(2)).cast("bigint")
    return progressed.withColumn(
        "stage",
        F.when(F.col("ordinal") == 1, "first")
        .when(third == 0, "early")
        .when(third == 1, "middle")
        .otherwise("late"),
    )
