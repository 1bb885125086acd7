"""Null models: surrogate onsets, null traces, envelopes, empirical tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.core.checks import require_none
from eventide.core.lineage import cut
from eventide.core.series import Series, asof, running, shift
from eventide.functions.hashed import uniform
from eventide.operators.stats import holm_family


#: Tries of one circular shift before it is given up; later ones are only made where needed.
SHIFT_TRIES = (32, 1024, 10_000)


def null_onsets(
    events: DataFrame,
    s: Series,
    bounds: DataFrame,
    *,
    n_shuffles: int = 500,
    method: str = "random_onsets",
    exclusion: float = 0.0,
    seed: int = 0,
    event_id: str = "event_i",
) -> DataFrame:
    """Surrogate onsets per shuffle: keys, event_id, ``shuffle``, ``s.t``.

    ``bounds`` holds keys, ``lo``, ``hi`` of admissible onsets; series whose ``hi``
    isn't above ``lo`` have no onsets.  Random onsets are uniform over the times that
    keep ``exclusion`` from every real event; a circular shift moves the whole train
    by one offset per shuffle, which keeps it too.  Raises where that leaves nothing.
    """
    if method not in ("random_onsets", "circular_shift"):
        raise ValueError("method is random_onsets or circular_shift")
    if exclusion < 0:
        raise ValueError("exclusion can't be negative")
    bounds = bounds.filter("hi > lo")
    base = events.join(bounds, list(s.keys)).withColumn(
        "shuffle", F.explode(F.sequence(F.lit(0), F.lit(n_shuffles - 1)))
    )
    draw = _random if method == "random_onsets" else _shifted
    return draw(base, events, s, bounds, exclusion, seed, event_id)


def _random(base, events, s, bounds, exclusion, seed, event_id) -> DataFrame:
    keys = list(s.keys)
    u = uniform(seed, *[F.col(k) for k in keys], F.col("shuffle"), F.col(event_id), F.lit(0))
    kept = [c for c in base.columns if c not in (s.t, "lo", "hi")]
    if exclusion == 0:
        return base.withColumn(s.t, F.col("lo") + u * (F.col("hi") - F.col("lo"))).select(*kept, s.t)
    free = cut(_free_times(events, bounds, s, exclusion))
    room = free.groupBy(*keys).agg(F.sum("_length").alias("_room"))
    require_none(
        events.join(bounds, keys).select(*keys).distinct().join(room, keys, "left_anti"),
        "no time keeps the exclusion from every event",
    )
    # Draw along the free times laid end to end, then go back to the clock.
    at = Series(s.keys, "_at", s.width)
    drawn = base.join(room, keys).withColumn("_at", u * F.col("_room")).select(*kept, "_at")
    starts = free.select(*keys, F.col("_before").alias("_at"), F.col(s.t).alias("_start"), "_before")
    found = asof(drawn, starts, at, back={"_s": "_start", "_b": "_before"})
    return found.withColumn(s.t, F.col("_s") + F.col("_at") - F.col("_b")).select(*kept, s.t)


def _free_times(events: DataFrame, bounds: DataFrame, s: Series, exclusion: float) -> DataFrame:
    """Intervals away from all events: keys, start (``s.t``), ``_length``, ``_before`` (free time earlier)."""
    keys = list(s.keys)
    marks = (
        events.join(bounds, keys).select(*keys, s.t, "lo", "hi")
        .unionByName(bounds.select(*keys, (F.col("lo") - exclusion).alias(s.t), "lo", "hi"))
        .filter(F.col(s.t).isNotNull()).distinct()
    )
    start = F.greatest("lo", F.col(s.t) + exclusion)
    end = F.least("hi", F.coalesce(F.col("_next") - exclusion, F.col("hi")))
    gaps = (
        shift(marks, s, ahead={"_next": s.t}).select(*keys, start.alias("_start"), (end - start).alias("_length"))
        .filter("_length > 0").withColumnRenamed("_start", s.t)
    )
    return running(gaps, s, {"_upto": "_length"}).withColumn("_before", F.col("_upto") - F.col("_length")).drop("_upto")


def _shifted(base, events, s, bounds, exclusion, seed, event_id) -> DataFrame:
    keys = list(s.keys)
    lo, span = F.col("lo"), F.col("hi") - F.col("lo")
    u = uniform(seed, *[F.col(k) for k in keys], F.col("shuffle"), F.col("_try"))
    onset = lo + F.pmod(F.pmod(F.col(s.t) - lo, span) + u * span, span)
    kept = [c for c in base.columns if c not in (s.t, "lo", "hi")]

    def moved(rows: DataFrame) -> DataFrame:
        return rows.withColumn(s.t, onset)

    if exclusion == 0:
        return moved(base.withColumn("_try", F.lit(0))).select(*kept, s.t)
    open_ = base.select(*keys, "shuffle").distinct()
    taken, first = None, 0
    for last in SHIFT_TRIES:
        tries = base.join(open_, [*keys, "shuffle"]).withColumn(
            "_try", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
        near = asof(moved(tries), events.select(*keys, s.t), s, back={"_b": s.t}, ahead={"_a": s.t})
        t = F.col(s.t)
        ok = F.coalesce(t - F.col("_b") >= exclusion, F.lit(True)) & F.coalesce(
            F.col("_a") - t >= exclusion, F.lit(True))
        good = near.groupBy(*keys, "shuffle", "_try").agg(F.bool_and(ok).alias("_ok")).filter("_ok")
        found = good.groupBy(*keys, "shuffle").agg(F.min("_try").alias("_try"))
        taken = cut(found if taken is None else taken.unionByName(found))
        open_ = base.select(*keys, "shuffle").distinct().join(taken, [*keys, "shuffle"], "left_anti")
        first = last
        if open_.isEmpty():
            return moved(base.join(taken, [*keys, "shuffle"])).select(*kept, s.t)
    require_none(open_, "no circular shift keeps the exclusion from every event")
    raise AssertionError("unreachable")


def onset_bounds(recording: DataFrame, window: tuple[float, float]) -> DataFrame:
    """Onsets whose whole window is recorded."""
    return recording.withColumns(
        {"lo": F.col("lo") - float(window[0]), "hi": F.col("hi") - float(window[1])}
    )


def envelope(null_means: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """2.5 / 97.5 percentiles over shuffles.

    A group holds one row per shuffle, a parameter, so the exact built-in
    percentile is bounded.
    """
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return null_means.groupBy(*keys).agg(q.alias("_q"), F.count(value).alias("n_shuffles")).select(
        *keys, F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"), "n_shuffles"
    )


def shuffle_tests(observed: DataFrame, null_values: DataFrame, keys: list[str]) -> DataFrame:
    """Empirical two-sided tests of group means against their shuffles.

    ``observed``: keys, ``observed_mean``.  ``null_values``: keys, ``value``
    with one finite value per shuffle (NULL otherwise).
    p = (1 + #{|null - c| >= |obs - c|}) / (n + 1), c the null median.
    """
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    centre = null_values.groupBy(*keys).agg(
        q.alias("_q"), F.avg("value").alias("null_mean"), F.count("value").alias("n_shuffles")
    )
    known = observed.join(centre, keys)
    far = F.abs(F.col("value") - F.col("_q")[1]) >= F.abs(F.col("observed_mean") - F.col("_q")[1])
    hits = (
        null_values.join(known, keys)
        .groupBy(*keys)
        .agg(F.sum(far.cast("bigint")).alias("_hits"))
    )
    return known.join(hits, keys).select(
        *keys,
        "observed_mean",
        "null_mean",
        F.col("_q")[0].alias("null_lower"),
        F.col("_q")[2].alias("null_upper"),
        ((1 + F.col("_hits")) / (F.col("n_shuffles") + 1)).alias("p_value"),
        "n_shuffles",
    )


def null_diagnostics(
    trial_sd: DataFrame,
    *,
    near_zero_ratio: float = 0.01,
    extreme_z: float = 20.0,
) -> DataFrame:
    """Baseline stability of real and null trials.

    ``trial_sd``: ``is_null, sd, max_abs_z, distance``.  A trial is near zero
    when its baseline sd is at most ``near_zero_ratio`` times the median
    positive real sd; more than one percent of such trials raises a flag.  The table is
    read twice, its real trials once more; it need not be written.
    """
    from eventide.core.ranks import percentile_of_few_groups, percentiles

    positive = trial_sd.filter(~F.col("is_null") & (F.col("sd") > 0)).withColumn("_all", F.lit(1))
    level = cut(percentiles(positive, ["_all"], "sd", {"median_sd": 0.5}).select("median_sd"))
    eps = F.lit(2.220446049250313e-16)
    threshold = F.greatest(eps, F.lit(near_zero_ratio) * F.col("median_sd"))
    x = trial_sd.join(F.broadcast(level)).withColumn("_threshold", threshold)  # one row
    out = percentile_of_few_groups(x, ["is_null"], "distance", "median_distance", 0.5, also=[
        F.count(F.lit(1)).alias("n_trials"),
        F.max("_threshold").alias("near_zero_threshold"),
        F.avg((F.col("sd") <= F.col("_threshold")).cast("double")).alias("near_zero_fraction"),
        F.avg((F.col("max_abs_z") >= extreme_z).cast("double")).alias("extreme_fraction"),
        F.min("distance").alias("min_distance"),
    ])
    return out.withColumn(
        "warning", (F.col("near_zero_fraction") > 0.01) | (F.col("extreme_fraction") > 0.01)
    )


def shuffle_family(observed: DataFrame, null_values: DataFrame, keys: list[str]) -> DataFrame:
    """Shuffle tests with Holm-adjusted p-values over all of them, the family's name and size."""
    return holm_family(shuffle_tests(observed, null_values, keys), "all_shuffle_tests_in_run")
