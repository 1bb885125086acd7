"""Trial plans: manifest metrics, paired lick-bout trials, lick-window trials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.core.lineage import cut
from eventide.core.numeric import lag_count
from eventide.core.series import Series
from eventide.operators import matching as mt
from eventide.operators import metrics as me
from eventide.operators import perievent as pe
from eventide.operators import rollup as ru
from eventide.plans.psth import trial_table


def manifest_metrics(
    samples: DataFrame,
    events: DataFrame,
    s: Series,
    *,
    labels: list[str],
    session: list[str],
    window: tuple[float, float],
    dt: float,
    metrics: tuple[str, ...] = me.TRACE_METRICS,
    response_window: tuple[float, float] = (0.0, 2.0),
    peak_smoothing: float = 0.1,
    movement_threshold: float = 1.0,
    **options,
) -> dict[str, DataFrame]:
    """Metrics per trial and on session-mean traces, rolled up to groups.

    ``events`` carries ``labels`` (mouse, grp, cond) and ``session`` columns.
    """
    trials = cut(trial_table(samples, events, s, window=window, dt=dt, **options))
    settings = dict(
        window=response_window, dt=dt, n_lags=lag_count(window, dt) + 1, metrics=metrics,
        peak_smoothing=peak_smoothing, movement_threshold=movement_threshold,
    )
    identity = [*labels, *session]
    per_trial = me.response_metrics(trials, [*identity, "event_i"], **settings)
    means = trials.groupBy(*identity, "lag_i", "rel_t").agg(F.avg("v").alias("v"))
    counts = trials.groupBy(*identity).agg(F.countDistinct("event_i").alias("n_trials"))
    traces = me.response_metrics(means, identity, **settings)
    sessions = me.metric_long(traces.join(counts, identity), [*identity, "n_trials"], metrics)
    mice = ru.mouse_metrics(sessions, [*labels, "metric"])
    return {
        "trials": me.metric_long(per_trial, [*identity, "event_i"], metrics),
        "sessions": sessions,
        "mice": mice,
        "groups": ru.group_metrics(mice, [c for c in labels if c != "mouse"] + ["metric"]),
    }


def paired_trials(
    samples: DataFrame,
    cues: DataFrame,
    bouts: DataFrame,
    deliveries: DataFrame,
    s: Series,
    *,
    window: tuple[float, float] = (-5.0, 20.0),
    dt: float = 0.02,
    normalization: str = "zscore",
    baseline: tuple[float, float] = (-5.0, 0.0),
    minimum_latency: float = 0.0,
) -> DataFrame:
    """Bout-aligned trials of cue-bounded bout / delivery pairs with latency.

    Trials without any value after normalisation are left out.
    """
    end = samples.groupBy(*s.keys).agg(F.max(s.t).alias("end_t"))
    pairs = cut(
        mt.cue_bounded_match(cues, bouts, deliveries, s, end, minimum_latency=minimum_latency)
    )
    events = pairs.select(*s.keys, F.col("cue_i").alias("event_i"), "latency", F.col("bout_t").alias(s.t))
    trials = trial_table(
        samples, events, s, window=window, dt=dt, normalization=normalization, baseline=baseline
    )
    whole = trials.groupBy(*s.keys, "event_i").agg(F.count("v").alias("_n")).filter("_n > 0")
    return trials.join(whole.drop("_n"), [*s.keys, "event_i"], "left_semi")


def lick_window_trials(
    samples: DataFrame,
    cues: DataFrame,
    licks: DataFrame,
    s: Series,
    *,
    window: tuple[float, float] = (-5.0, 15.0),
    dt: float = 0.02,
    baseline: tuple[float, float] = (-5.0, 0.0),
    lick_window: tuple[float, float] = (8.0, 10.0),
    tolerance: float = 0.01,
) -> DataFrame:
    """z-scored cue trials with a lick late after the cue; last sample dropped."""
    chosen = mt.with_event_in_window(cues, licks, s, lick_window, open_left=True, tolerance=tolerance)
    trials = trial_table(
        samples, cut(chosen), s, window=window, dt=dt, normalization="zscore", baseline=baseline
    )
    return trials.filter(F.col("lag_i") < lag_count(window, dt))


def event_grid(
    events: DataFrame, alignments: DataFrame, s: Series, window: tuple[float, float], dt: float
) -> DataFrame:
    """Occupied samples of 0/1 event grids: nearest sample, duplicates collapse."""
    n = lag_count(window, dt)
    hits = pe.native_samples(events, alignments, s, window)
    k = F.rint((F.col("rel_t") - window[0]) / dt).cast("int")
    return (
        hits.withColumn("lag_i", k)
        .filter((F.col("lag_i") >= 0) & (F.col("lag_i") < n))
        .select(*s.keys, "event_i", "lag_i")
        .distinct()
        .withColumn("v", F.lit(1.0))
    )
