"""The flagship plan: event-aligned mean traces rolled up to groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.core.series import Series
from eventide.operators.perievent import event_rate, extract, normalise
from eventide.operators.rollup import roll_up


def trial_table(
    samples: DataFrame,
    events: DataFrame,
    s: Series,
    *,
    window: tuple[float, float],
    dt: float,
    normalization: str = "zscore",
    baseline: tuple[float, float] = (-5.0, 0.0),
    allow_partial_windows: bool = False,
    signal_kind: str = "continuous",
    bounds: DataFrame | None = None,
    event_id: str = "event_i",
) -> DataFrame:
    """Normalised trials of one signal around one event train.

    Discrete signals (licking) become rates and are never normalised.
    """
    if signal_kind == "train":
        return event_rate(
            samples, events, s, window, dt,
            bounds=bounds, require_complete=not allow_partial_windows, event_id=event_id,
        )
    trials = extract(
        samples, events, s, window, dt,
        require_complete=not allow_partial_windows, event_id=event_id,
    )
    return normalise(trials, [*s.keys, event_id], mode=normalization, baseline=baseline)


def peri_event_means(
    samples: DataFrame,
    events: DataFrame,
    s: Series,
    *,
    session: list[str],
    mouse: list[str],
    group: list[str],
    **options,
) -> DataFrame:
    """Group mean / SEM / n per lag; strata are just further group keys."""
    trials = trial_table(samples, events, s, **options)
    return roll_up(trials, at=["lag_i", "rel_t"], session=session, mouse=mouse, group=group)


def stratum(column: str):
    """Missing or blank labels of a stratum become ``all``."""
    return F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit("all"))


def first_event_only(events: DataFrame, s: Series) -> DataFrame:
    """Earliest event of every series (a map-side combined minimum)."""
    first = events.groupBy(*s.keys).agg(F.min(s.t).alias(s.t))
    return events.join(first, [*s.keys, s.t], "left_semi")
