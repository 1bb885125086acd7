"""Matching of event trains: the range and as-of joins of the domain.

Every match is one linear ``asof`` scan; no event pairs are formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.core.numeric import check_window
from eventide.core.series import Series, asof, index_rows, shift


def _at(df: DataFrame, s: Series, expr) -> DataFrame:
    return df.withColumn("_own_t", F.col(s.t)).withColumn(s.t, expr)


def _back_to_own_time(df: DataFrame, s: Series) -> DataFrame:
    return df.withColumn(s.t, F.col("_own_t")).drop("_own_t")


def first_in_window(
    refs: DataFrame,
    events: DataFrame,
    s: Series,
    window: tuple[float, float],
    *,
    out: str = "match_t",
    payload: dict[str, str] | None = None,
) -> DataFrame:
    """First event with relative time in the closed window, else NULL."""
    lo, hi = check_window(window)
    x = asof(
        _at(refs, s, F.col(s.t) + lo), events, s, ahead={out: s.t, **(payload or {})}
    )
    x = _back_to_own_time(x, s)
    ok = F.col(out) - F.col(s.t) <= hi
    return x.withColumns({c: F.when(ok, F.col(c)) for c in [*(payload or {}), out]})


def last_in_window(
    refs: DataFrame,
    events: DataFrame,
    s: Series,
    window: tuple[float, float],
    *,
    out: str = "match_t",
    payload: dict[str, str] | None = None,
) -> DataFrame:
    """Last event with relative time in the closed window, else NULL."""
    lo, hi = check_window(window)
    x = asof(_at(refs, s, F.col(s.t) + hi), events, s, back={out: s.t, **(payload or {})})
    x = _back_to_own_time(x, s)
    ok = F.col(out) - F.col(s.t) >= lo
    return x.withColumns({c: F.when(ok, F.col(c)) for c in [*(payload or {}), out]})


def count_in_window(
    refs: DataFrame, events: DataFrame, s: Series, window: tuple[float, float], *, out: str = "n"
) -> DataFrame:
    """Number of events in the closed window as a difference of running counts."""
    lo, hi = check_window(window)
    one = {"_c": "1L"}
    upper = _back_to_own_time(
        asof(_at(refs, s, F.col(s.t) + hi), events, s, totals=one).withColumnRenamed("_c", "_hi"), s
    )
    lower = asof(
        _at(upper, s, F.col(s.t) + lo), events, s, totals=one, back_inclusive=False
    ).withColumnRenamed("_c", "_lo")
    return (
        _back_to_own_time(lower, s)
        .withColumn(out, F.col("_hi") - F.col("_lo"))
        .drop("_hi", "_lo")
    )


def first_after_reference(
    refs: DataFrame, events: DataFrame, s: Series, window: tuple[float, float] = (0.0, 20.0)
) -> DataFrame:
    """First event in ``[ref + start, min(ref + stop, next ref))``.

    Output: keys, ``ref_i, ref_t, match_t``; references without a match drop out.
    """
    lo, hi = check_window(window)
    if lo < 0:
        raise ValueError("the window must be nonnegative")
    x = index_rows(refs.select(*s.keys, s.t), s, "ref_i")
    x = shift(x, s, ahead={"_next": s.t})
    x = _back_to_own_time(
        asof(_at(x, s, F.col(s.t) + lo), events, s, ahead={"match_t": s.t}), s
    )
    upper = F.least(F.col(s.t) + hi, F.col("_next"))
    return x.filter(F.col("match_t") < upper).select(
        *s.keys, "ref_i", F.col(s.t).alias("ref_t"), "match_t"
    )


def cue_bounded_match(
    cues: DataFrame,
    bouts: DataFrame,
    deliveries: DataFrame,
    s: Series,
    recording_end: DataFrame,
    *,
    minimum_latency: float = 0.0,
) -> DataFrame:
    """Pair the first bout and first delivery inside each cue-to-cue trial.

    ``recording_end``: keys and ``end_t``, the end of the last trial.
    """
    x = index_rows(cues.select(*s.keys, s.t), s, "cue_i")
    x = shift(x, s, ahead={"_next": s.t})
    last = x.filter(F.col("_next").isNull()).join(recording_end, list(s.keys))
    x = x.filter(F.col("_next").isNotNull()).unionByName(
        last.withColumn("_next", F.col("end_t")).drop("end_t")
    )
    x = asof(x, bouts.select(*s.keys, s.t), s, ahead={"bout_t": s.t})
    x = asof(x, deliveries.select(*s.keys, s.t), s, ahead={"delivery_t": s.t})
    x = x.filter((F.col("bout_t") < F.col("_next")) & (F.col("delivery_t") < F.col("_next")))
    x = x.withColumn("latency", F.col("delivery_t") - F.col("bout_t"))
    return x.filter(F.col("latency") >= minimum_latency).select(
        *s.keys, "cue_i", F.col(s.t).alias("cue_t"), "bout_t", "delivery_t", "latency"
    )


def classify_cues(
    cues: DataFrame,
    licks: DataFrame,
    s: Series,
    *,
    onset: str = "onset_t",
    offset: str = "offset_t",
    post_window: float = 2.0,
) -> DataFrame:
    """Cue trial classes from licks in ``[on, off]`` and ``(off, off + w]``."""
    events = licks.select(*s.keys, s.t)
    x = asof(cues.withColumn(s.t, F.col(onset)), events, s, ahead={"_a": s.t})
    x = asof(
        x.withColumn(s.t, F.col(offset)), events, s, ahead={"_b": s.t}, ahead_inclusive=False
    )
    during = F.coalesce(F.col("_a") <= F.col(offset), F.lit(False))
    after = F.coalesce(F.col("_b") <= F.col(offset) + post_window, F.lit(False))
    x = x.withColumn("cue_lick", during).withColumn("post_lick", after)
    return x.select(
        *[F.col(c) for c in cues.columns if c != s.t],
        "cue_lick",
        "post_lick",
        (F.col("cue_lick") & ~F.col("post_lick")).alias("cue_only"),
        (~F.col("cue_lick") & F.col("post_lick")).alias("post_only"),
        (F.col("cue_lick") & F.col("post_lick")).alias("cue_and_post"),
        (~F.col("cue_lick") & ~F.col("post_lick")).alias("cue_miss"),
    )


def with_event_in_window(
    refs: DataFrame,
    events: DataFrame,
    s: Series,
    window: tuple[float, float],
    *,
    open_left: bool = False,
    tolerance: float = 0.0,
) -> DataFrame:
    """References that have any event in the window (a semi range join)."""
    lo, hi = check_window(window)
    x = asof(
        _at(refs, s, F.col(s.t) + lo),
        events.select(*s.keys, s.t),
        s,
        ahead={"_m": s.t},
        ahead_inclusive=not open_left,
    )
    x = _back_to_own_time(x, s)
    return x.filter(F.col("_m") - F.col(s.t) <= hi + tolerance).drop("_m")
