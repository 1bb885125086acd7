"""Clock alignment: affine fits and ordinal matching of pulse trains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.core.checks import ContractError
from eventide.core.lineage import cut
from eventide.core.ranks import percentiles
from eventide.core.series import Series, asof, index_rows, running, shift


def clock_fit(matches: DataFrame, keys: list[str], *, source: str = "ts", target: str = "tt") -> DataFrame:
    """Least squares ``target = intercept + scale * source`` per series.

    Sums are taken around the first pulse, so large epoch times lose nothing.
    Output: keys, ``n, intercept, scale, rms, max_abs, drift_ppm``.
    """
    matches = cut(matches)
    first = matches.groupBy(*keys).agg(
        F.min(source).alias("_s0"), F.min(target).alias("_t0")
    )
    x = matches.join(first, keys).withColumns(
        {"_x": F.col(source) - F.col("_s0"), "_y": F.col(target) - F.col("_t0")}
    )
    fit = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("_y", "_x").alias("scale"),
        F.regr_intercept("_y", "_x").alias("_b"),
        F.first("_s0").alias("_s0"),
        F.first("_t0").alias("_t0"),
    ).filter("n >= 3")
    res = x.join(fit.select(*keys, "scale", "_b"), keys).withColumn(
        "_r", F.col("_y") - (F.col("_b") + F.col("scale") * F.col("_x"))
    )
    quality = res.groupBy(*keys).agg(
        F.sqrt(F.avg(F.col("_r") * F.col("_r"))).alias("rms"), F.max(F.abs("_r")).alias("max_abs")
    )
    return fit.join(quality, keys).select(
        *keys,
        "n",
        (F.col("_t0") + F.col("_b") - F.col("scale") * F.col("_s0")).alias("intercept"),
        "scale",
        "rms",
        "max_abs",
        ((F.col("scale") - 1.0) * 1e6).alias("drift_ppm"),
    )


def positional_matches(source: DataFrame, target: DataFrame, s: Series) -> DataFrame:
    """Pair pulses by position; the surplus of the longer train is left out."""
    a = index_rows(source.select(*s.keys, s.t), s).select(*s.keys, "i", F.col(s.t).alias("ts"))
    b = index_rows(target.select(*s.keys, s.t), s).select(*s.keys, "i", F.col(s.t).alias("tt"))
    return a.join(b, [*s.keys, "i"])


def median_interval(pulses: DataFrame, s: Series, out: str = "period") -> DataFrame:
    x = shift(pulses.select(*s.keys, s.t), s, back={"_p": s.t})
    x = x.select(*s.keys, (F.col(s.t) - F.col("_p")).alias("_d"))
    return percentiles(x, list(s.keys), "_d", {out: 0.5}).drop("n")


def long_gaps(pulses: DataFrame, s: Series, periods: DataFrame, factor: float = 1.5) -> DataFrame:
    """Intervals above ``factor`` periods: internal missing pulses."""
    x = shift(pulses.select(*s.keys, s.t), s, back={"_p": s.t}).join(periods, list(s.keys))
    return x.filter(F.col(s.t) - F.col("_p") > factor * F.col("period")).drop("_p")


def pulse_ordinals(
    pulses: DataFrame, s: Series, periods: DataFrame, *, jitter: float = 0.25
) -> DataFrame:
    """Pulse numbers that tolerate duplicates and missing pulses.

    Ratio of interval to period: below 0.5 a duplicate (step 0), up to
    ``1 + jitter`` one step, else the rounded ratio.  ``explained`` is false
    where an interval fits no whole number of periods.
    """
    eps = 1e-6
    x = shift(pulses.select(*s.keys, s.t), s, back={"_p": s.t}).join(periods, list(s.keys))
    ratio = (F.col(s.t) - F.col("_p")) / F.col("period")
    whole = F.floor(ratio + 0.5)
    single = ratio <= 1.0 + jitter + eps
    step = (
        F.when(F.col("_p").isNull(), 0)
        .when(ratio < 0.5 - eps, 0)
        .when(single, 1)
        .otherwise(whole)
    )
    explained = F.col("_p").isNull() | single | (F.abs(ratio - whole) <= jitter + eps)
    x = x.withColumns({"_step": step.cast("bigint"), "explained": explained})
    x = running(
        x.select(*s.keys, s.t, "explained", "_step"), s, {"ordinal": "_step", "_pos": "1L"}
    )
    return x.withColumn("i", F.col("_pos") - 1).drop("_step", "_pos")


def ordinal_matches(
    source: DataFrame,
    target: DataFrame,
    s: Series,
    source_period: DataFrame,
    target_period: DataFrame,
    *,
    jitter: float = 0.25,
) -> DataFrame:
    """Best source / target pair per common ordinal.

    Candidates of one ordinal are compared on a common clock by one nearest
    neighbour scan.  Output: keys, ``ordinal, source_i, target_i, ts, tt``.
    """
    keys = list(s.keys)
    a = cut(pulse_ordinals(source, s, source_period, jitter=jitter))
    b = cut(pulse_ordinals(target, s, target_period, jitter=jitter))
    a0 = a.groupBy(*keys).agg(F.min(s.t).alias("_a0"))
    b0 = b.groupBy(*keys).agg(F.min(s.t).alias("_b0"))
    scale = (
        source_period.withColumnRenamed("period", "_ps")
        .join(target_period.withColumnRenamed("period", "_pt"), keys)
        .select(*keys, (F.col("_pt") / F.col("_ps")).alias("_scale"))
    )
    left = a.join(a0, keys).join(scale, keys).select(
        *keys, "ordinal", F.col("i").alias("source_i"), F.col(s.t).alias("ts"),
        (F.col("_scale") * (F.col(s.t) - F.col("_a0"))).alias("_u"),
    )
    right = b.join(b0, keys).select(
        *keys, "ordinal", F.col("i").alias("target_i"), F.col(s.t).alias("tt"),
        (F.col(s.t) - F.col("_b0")).alias("_u"),
    )
    o = Series((*keys, "ordinal"), "_u", s.width)
    x = asof(
        left, right, o,
        back={"_bi": "target_i", "_bt": "tt", "_bu": "_u"},
        ahead={"_ni": "target_i", "_nt": "tt", "_nu": "_u"},
    )
    back_err = F.col("_u") - F.col("_bu")
    next_err = F.col("_nu") - F.col("_u")
    use_back = F.col("_ni").isNull() | (back_err <= next_err)
    x = x.withColumns(
        {
            "_err": F.when(use_back, back_err).otherwise(next_err),
            "target_i": F.when(use_back, F.col("_bi")).otherwise(F.col("_ni")),
            "tt": F.when(use_back, F.col("_bt")).otherwise(F.col("_nt")),
        }
    ).filter(F.col("target_i").isNotNull())
    best = F.min(F.struct("_err", "source_i", "target_i", "ts", "tt")).alias("_m")
    return x.groupBy(*keys, "ordinal").agg(best).select(
        *keys, "ordinal", "_m.source_i", "_m.target_i", "_m.ts", "_m.tt"
    )


def unmatched(pulses: DataFrame, matches: DataFrame, s: Series, index: str) -> DataFrame:
    """Pulses without a partner."""
    rows = index_rows(pulses.select(*s.keys, s.t), s).withColumnRenamed("i", index)
    return rows.join(matches.select(*s.keys, index), [*s.keys, index], "left_anti")


def require_fit(
    fits: DataFrame,
    period: float,
    *,
    max_rms_fraction: float | None = None,
    max_residual_fraction: float | None = None,
    max_abs_drift_ppm: float | None = None,
) -> None:
    """Raise when any fit exceeds an acceptance limit."""
    bad = F.lit(False)
    if max_rms_fraction is not None:
        bad = bad | (F.col("rms") > max_rms_fraction * period)
    if max_residual_fraction is not None:
        bad = bad | (F.col("max_abs") > max_residual_fraction * period)
    if max_abs_drift_ppm is not None:
        bad = bad | (F.abs("drift_ppm") > max_abs_drift_ppm)
    rows = fits.filter(bad).limit(1).collect()
    if rows:
        raise ContractError(f"clock alignment residuals or drift are too large: {rows[0].asDict()}")


def to_target_clock(df: DataFrame, fits: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Map source times onto the target clock."""
    x = df.join(fits.select(*keys, "intercept", "scale"), keys)
    return x.withColumn(t, F.col("intercept") + F.col("scale") * F.col(t)).drop("intercept", "scale")
