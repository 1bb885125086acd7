"""Behavioural ordering of trials (heatmap rows) and latency sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.core.lineage import cut
from eventide.core.ranks import distribution, percentiles
from eventide.core.series import Series, index_rows
from eventide.operators.matching import count_in_window, first_in_window, last_in_window

# Default matching windows in seconds and descending sort keys.
DEFAULT_WINDOWS = {
    "ensure_latency": (0.0, 20.0),
    "first_lick_latency": (0.0, 20.0),
    "first_bout_latency": (0.0, 20.0),
    "bout_size": (0.0, 20.0),
    "bout_duration": (0.0, 20.0),
    "post_event_lick_count": (0.0, 20.0),
    "pre_event_lick_rate": (-5.0, 0.0),
    "cue_to_bout_latency": (-20.0, 0.0),
}
AUTO_DESCENDING = (
    "response_mean", "bout_size", "bout_duration", "post_event_lick_count", "pre_event_lick_rate",
)


def sort_values(
    alignments: DataFrame,
    s: Series,
    method: str,
    *,
    trials: DataFrame | None = None,
    events: DataFrame | None = None,
    window: tuple[float, float] | None = None,
    event_id: str = "event_i",
) -> DataFrame:
    """Add ``sort_value`` and ``matched_t`` to alignments (keys, t, event_id).

    ``events`` is the train the method looks at: deliveries, licks, cues, or
    bouts (with ``n`` and ``duration`` for the bout measures).
    """
    window = window or DEFAULT_WINDOWS.get(method)
    none = F.lit(None).cast("double")
    t = F.col(s.t)
    if method == "event_order":
        return alignments.withColumns(
            {"sort_value": F.col("trial").cast("double"), "matched_t": none}
        )
    if method == "response_mean":
        after = F.avg(F.when(F.col("rel_t") >= 0, F.col("v")))
        means = trials.groupBy(*s.keys, event_id).agg(
            F.when(F.max("rel_t") >= 0, after).otherwise(F.avg("v")).alias("sort_value")
        )
        return alignments.join(means, [*s.keys, event_id], "left").withColumn("matched_t", none)
    if method in ("ensure_latency", "first_lick_latency", "first_bout_latency"):
        x = first_in_window(alignments, events, s, window, out="matched_t")
        return x.withColumn("sort_value", F.col("matched_t") - t)
    if method in ("bout_size", "bout_duration"):
        source = "n" if method == "bout_size" else "duration"
        x = first_in_window(
            alignments, events, s, window, out="matched_t", payload={"sort_value": source}
        )
        return x.withColumn("sort_value", F.col("sort_value").cast("double"))
    if method in ("post_event_lick_count", "pre_event_lick_rate"):
        x = count_in_window(alignments, events, s, window, out="_n")
        scale = 1.0 if method == "post_event_lick_count" else float(window[1] - window[0])
        return x.withColumns({"sort_value": F.col("_n") / F.lit(scale), "matched_t": none}).drop("_n")
    if method == "cue_to_bout_latency":
        x = last_in_window(alignments, events, s, window, out="matched_t")
        return x.withColumn("sort_value", t - F.col("matched_t"))
    raise ValueError(f"unknown sort method: {method}")


def order_trials(
    valued: DataFrame,
    keys: list[str],
    method: str,
    *,
    trial: str = "trial",
    direction: str = "auto",
    unmatched: str = "bottom",
    value_width: float | None = None,
) -> DataFrame:
    """Add ``position`` (0-based row of the heatmap).

    Ascending is a stable sort by (value, trial); descending is its exact
    reversal, so ties run by falling trial number.  Trials without a value go
    to the bottom in trial order, or drop out with ``unmatched='exclude'``.
    Positions are exact ranks of (value, trial), computed in value cells.
    """
    valued = cut(valued)
    descending = method in AUTO_DESCENDING if direction == "auto" else direction == "descending"
    matched = valued.filter(F.col("sort_value").isNotNull())
    d = distribution(matched, keys, "sort_value", width=value_width)
    tie = Series((*keys, "sort_value"), trial, None)
    ranked = _rank_inside(matched, tie).join(d, [*keys, "sort_value"])
    ascending_pos = F.col("below") + F.col("_in_tie")
    position = F.col("n") - 1 - ascending_pos if descending else ascending_pos
    out = ranked.withColumn("position", position.cast("bigint")).drop("below", "cnt", "_in_tie")
    if unmatched == "exclude":
        return out.drop("n")
    missing = valued.filter(F.col("sort_value").isNull())
    counts = matched.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    missing = _rank_inside(missing, Series(tuple(keys), trial, None)).join(
        counts, keys, "left"
    )
    missing = missing.withColumn(
        "position", (F.coalesce("n", F.lit(0)) + F.col("_in_tie")).cast("bigint")
    )
    return out.drop("n").unionByName(missing.drop("_in_tie", "n"))


def _rank_inside(df: DataFrame, s: Series) -> DataFrame:
    return index_rows(df, s, "_in_tie")


def mouse_order(valued: DataFrame, *, mouse: str = "mouse", descending: bool = False) -> DataFrame:
    """Order mice by the median key of their matched trials."""
    medians = cut(percentiles(cut(valued), [mouse], "sort_value", {"median_key": 0.5}))
    d = distribution(medians, [], "median_key")
    ranked = _rank_inside(medians, Series(("median_key",), mouse, None)).join(
        d.drop("n"), "median_key"
    )
    total = d.groupBy().agg(F.max("n").alias("total"))
    pos = F.col("below") + F.col("_in_tie")
    if descending:
        # A one-row table; it cannot grow with the data.
        ranked = ranked.join(F.broadcast(total))
        pos = F.col("total") - 1 - pos
    return ranked.select(mouse, "median_key", pos.cast("bigint").alias("mouse_position"))
