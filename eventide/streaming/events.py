"""Structured Streaming forms: bins, bouts, pulses, delivery matches.

Input times are event-time timestamps.  Rows later than the watermark are
dropped, where the batch operators refuse unordered input.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def tumbling_counts(
    stream: DataFrame, keys: list[str], *, ts: str = "ts", width: str = "1 hour",
    lateness: str = "10 minutes",
) -> DataFrame:
    """Event count and value sum per time bin."""
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(*keys, F.window(ts, width).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(*keys, F.col("w.start").alias("start"), "n", "total")
    )


def sliding_mean(
    stream: DataFrame, keys: list[str], *, ts: str = "ts", width: str = "1 hour",
    slide: str = "10 minutes", lateness: str = "10 minutes",
) -> DataFrame:
    """Moving average over a sliding time frame."""
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(*keys, F.window(ts, width, slide).alias("w"))
        .agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("w.start").alias("start"), "mean", "n")
    )


def bouts(
    stream: DataFrame, keys: list[str], *, ts: str = "ts", max_gap: str = "1 second",
    min_count: int = 3, lateness: str = "10 seconds",
) -> DataFrame:
    """Session windows; events exactly one gap apart stay in one bout.

    The offset is the last event, not the window end.
    """
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(*keys, F.session_window(ts, max_gap).alias("w"))
        .agg(
            F.min(ts).alias("onset"), F.max(ts).alias("offset"), F.count(F.lit(1)).alias("n")
        )
        .filter(F.col("n") >= min_count)
        .select(*keys, "onset", "offset", "n")
    )


def first_after_reference(
    references: DataFrame, events: DataFrame, key: str, *, window: tuple[str, str] = ("0 seconds", "20 seconds"),
    lateness: str = "10 seconds",
) -> DataFrame:
    """The first event inside the window after each reference: ``key, ref_ts, event_ts``.

    An interval join, then the earliest event per reference.  A reference is closed, and its row
    leaves, when the watermark says that no event of its window can come any more: exactly one row
    per matched reference, whatever the order of arrival within the lateness.
    """
    r = references.select(F.col(key).alias("_k"), F.col("ts").alias("ref_ts")).withWatermark("ref_ts", lateness)
    e = events.select(key, F.col("ts").alias("event_ts")).withWatermark("event_ts", lateness)
    on = (
        (F.col(key) == F.col("_k"))
        & (F.col("event_ts") >= F.col("ref_ts") + F.expr(f"INTERVAL {window[0]}"))
        & (F.col("event_ts") < F.col("ref_ts") + F.expr(f"INTERVAL {window[1]}"))
    )
    return r.join(e, on).groupBy(key, "ref_ts").agg(F.min("event_ts").alias("event_ts"))


_PULSES = "channel string, onset bigint, offset bigint"
#: Rows held back (time in microseconds, value), the last level and the open onset.
_HELD = "at array<bigint>, v array<double>, high boolean, onset bigint"


def _edges(at: np.ndarray, v: np.ndarray, threshold: float, high: bool | None, onset: int | None):
    """Ended pulses (onset, offset) of samples in time order, the level after them and an open onset."""
    level = v > threshold
    before = np.concatenate([[level[0] if high is None else high], level[:-1]])
    up, down = at[level & ~before], at[~level & before]
    if onset is not None:
        up = np.concatenate([[onset], up])
    if len(down) and (not len(up) or down[0] < up[0]):
        down = down[1:]  # high from the start: no onset is known
    left = int(up[-1]) if len(up) > len(down) else None
    return up[:len(down)], down, bool(level[-1]), left


def pulses(stream: DataFrame, *, threshold: float = 1.5, lateness: str = "10 seconds") -> DataFrame:
    """Internal high pulses per channel (``channel, ts, v``), emitted when they end.

    Samples wait until the watermark has passed them and are then taken in time order, so late and
    unordered ones inside the lateness change nothing.  State is what arrived within the lateness.
    """

    def run(key, frames, state):
        at, v, high, onset = ([], [], None, None)
        if state.exists:
            at, v, high, onset = state.get
        frames = list(frames) if not state.hasTimedOut else []
        at = np.concatenate([np.array(at, np.int64), *[f["_at"].to_numpy(np.int64) for f in frames]])
        v = np.concatenate([np.array(v, float), *[f["v"].to_numpy(float) for f in frames]])
        order = np.argsort(at, kind="stable")
        at, v = at[order], v[order]
        passed = int(np.searchsorted(at, state.getCurrentWatermarkMs() * 1000, side="right"))
        up = down = np.empty(0, np.int64)
        if passed:
            up, down, high, onset = _edges(at[:passed], v[:passed], threshold, high, onset)
            onset = None if not high else onset
        state.update((at[passed:].tolist(), v[passed:].tolist(), high, onset))
        if len(at) > passed:
            state.setTimeoutTimestamp(max(int(at[passed]) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"channel": [key[0]] * len(down), "onset": up, "offset": down})

    rows = stream.withWatermark("ts", lateness).select("channel", "ts", F.unix_micros("ts").alias("_at"), F.col("v").cast("double").alias("v"))
    found = rows.groupBy("channel").applyInPandasWithState(
        run, _PULSES, _HELD, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("channel", F.timestamp_micros("onset").alias("onset"), F.timestamp_micros("offset").alias("offset"))
