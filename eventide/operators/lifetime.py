"""Fluorescence-lifetime operators on curves stored as arrays of counts.

A row is one curve.  Corrections and moments are array expressions; fits run
on Arrow batches of independent rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from eventide.core.lineage import cut
from eventide.core.ranks import percentiles
from eventide.core.series import Series, index_rows
from eventide.functions import decay
from eventide.functions.hashed import label
from eventide.functions.solvers import nnls_small


def let(body, **values: Column) -> Column:
    """Evaluate scalars once per row and hand them to ``body`` as a struct.

    An expression that is named inside an array lambda would otherwise be
    evaluated again for every element.
    """
    row = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.transform(F.array(row), body)[0]


def total(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def bin_times(n: Column, resolution: float) -> Column:
    """Bin times ``bin * resolution`` as an array."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * F.lit(float(resolution)))


def correct(
    df: DataFrame,
    *,
    counts: str = "counts",
    background: Column | None = None,
    dead_time: float,
    sampling_frequency: float,
    afterpulse_ratio: float = 0.0,
    out: str = "corrected",
) -> DataFrame:
    """Dead-time aware background and afterpulse correction; negatives stay.

    Adds the corrected array and ``efficiency``.  Rows whose count rate leaves
    no efficiency become NULL.
    """
    if afterpulse_ratio < 0:
        raise ValueError("afterpulse_ratio must be nonnegative")
    fs, dt = float(sampling_frequency), float(dead_time)
    bg = background if background is not None else F.transform(counts, lambda c: F.lit(0.0))
    x = df.withColumn("_bg", bg)

    def fixed(r: Column) -> Column:
        rate, bg_eff = r["n"] * fs, 1.0 - r["b"] * fs * dt
        eff = 1.0 - rate * dt
        after = (rate - r["b"] / bg_eff * eff * fs) * afterpulse_ratio / (fs * r["size"])
        return let(
            lambda q: F.when(
                (q["eff"] > 0) & (q["bg_eff"] > 0),
                F.zip_with(
                    counts, "_bg", lambda c, b: c - b / q["bg_eff"] * q["eff"] - q["after"]
                ),
            ),
            eff=eff, bg_eff=bg_eff, after=after,
        )

    sums = {"n": total(counts), "b": total("_bg"), "size": F.size(counts).cast("double")}
    return x.withColumns(
        {out: let(fixed, **sums), "efficiency": 1.0 - total(counts) * fs * dt}
    ).drop("_bg")


def mpet(
    curve: str, times: Column, *, window: tuple[float, float] = (0.4, 12.3), t0: Column | float = 0.0
) -> Column:
    """Mean photon emission time inside the closed window, NULL without photons."""
    lo, hi = window
    t0 = t0 if isinstance(t0, Column) else F.lit(float(t0))
    kept = F.filter(
        F.zip_with(times, curve, lambda t, c: F.struct(t.alias("t"), c.alias("c"))),
        lambda p: (p["t"] >= lo) & (p["t"] <= hi),
    )
    mass = F.aggregate(kept, F.lit(0.0), lambda a, p: a + p["c"])
    weighted = F.aggregate(kept, F.lit(0.0), lambda a, p: a + p["t"] * p["c"])
    return F.when(mass > 0, weighted / mass - t0)


def median_of(values: Column) -> Column:
    """Median of the non-missing entries of an array."""
    known = F.sort_array(F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x)))

    def middle(r: Column) -> Column:
        n = F.size(r["v"])
        lo, hi = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
        return F.when(n > 0, (F.get(r["v"], lo) + F.get(r["v"], hi)) / 2.0)

    return let(middle, v=known)


def subtract_terminal_baseline(curve: Column | str, *, fraction: float = 0.1) -> Column:
    """Subtract the median of the last ``ceil(fraction * n)`` points."""
    c = F.col(curve) if isinstance(curve, str) else curve
    k = F.greatest(F.lit(1), F.ceil(F.size(c) * fraction).cast("int"))
    level = median_of(F.slice(c, F.size(c) - k + 1, k))
    return let(lambda r: F.transform(c, lambda x: x - r["level"]), level=level)


def centroid(curve: Column, times: Column, window: tuple[float, float] | None = None) -> Column:
    """Centroid of the positive part, NULL without mass."""
    pairs = F.zip_with(
        times, curve,
        lambda t, c: F.struct(t.alias("t"), F.greatest(c, F.lit(0.0)).alias("c")),
    )
    if window is not None:
        pairs = F.filter(pairs, lambda p: (p["t"] >= window[0]) & (p["t"] <= window[1]))
    mass = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["c"])
    weighted = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["t"] * p["c"])
    return F.when(mass > 0, weighted / mass)


def moment_lifetime(
    df: DataFrame, waveform: str, irf: str, times: Column, *,
    window: tuple[float, float] | None = None, out: str = "lifetime",
) -> DataFrame:
    """Signal centroid minus response centroid after baseline subtraction."""
    x = df.withColumns(
        {
            "_w": subtract_terminal_baseline(waveform),
            "_h": subtract_terminal_baseline(irf),
            "_t": times,
        }
    )
    value = centroid(F.col("_w"), F.col("_t"), window) - centroid(F.col("_h"), F.col("_t"), window)
    return x.withColumn(out, value).drop("_w", "_h", "_t")


def average_background(df: DataFrame, keys: list[str], counts: str = "counts") -> DataFrame:
    """Mean count per bin over all curves of a group."""
    x = df.select(*keys, F.posexplode(counts).alias("bin", "c"))
    return x.groupBy(*keys, "bin").agg(F.avg(F.col("c").cast("double")).alias("background"))


def pack_bins(long: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Per-bin rows back to one array per group (bounded by the bin count)."""
    g = long.groupBy(*keys) if keys else long.groupBy()
    packed = F.sort_array(F.collect_list(F.struct("bin", value)))
    return g.agg(F.transform(packed, lambda p: p[value]).alias(out))


def bin_curves(
    df: DataFrame, keys: list[str], k: int, *, index: str = "i", counts: str = "counts",
    reducer: str = "sum",
) -> DataFrame:
    """Sum or mean of ``k`` adjacent curves per bin; incomplete tails drop out."""
    agg = {"sum": F.sum, "mean": F.avg}[reducer]
    x = df.withColumn("group_i", F.floor(F.col(index) / k).cast("bigint")).select(
        *keys, "group_i", F.posexplode(counts).alias("bin", "c")
    )
    return (
        x.groupBy(*keys, "group_i", "bin")
        .agg(agg(F.col("c").cast("double")).alias("c"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == k)
        .drop("_n")
    )


def markers(df: DataFrame, mark: str = "mark", marker: int = 1) -> Column:
    """Bit test of an external marker (1 to 4) in the unsigned marker word."""
    if marker not in (1, 2, 3, 4):
        raise ValueError("marker must be 1, 2, 3 or 4")
    return F.col(mark).cast("bigint").bitwiseAND(F.lit(1 << (marker + 1))) != 0


def fit_target(
    df: DataFrame,
    *,
    times: Sequence[float],
    lifetimes: Sequence[float],
    t0: float,
    sigma: float,
    period: float = 12.5,
    counts: str = "counts",
    residual_background: float = 0.0,
    fit_background: bool = False,
    weighting: str = "none",
) -> DataFrame:
    """Non-negative component counts with the shape fixed.

    Adds ``components`` (short, long), ``background_counts``, ``long_fraction``
    and ``fit_rmse``.  Rows are independent and stay in their partition.
    """
    taus = sorted(map(float, lifetimes))
    basis = decay.component_basis(times, taus, t0, sigma, period, background=fit_background)
    k = len(taus)
    schema = StructType(
        df.schema.fields
        + [
            StructField("components", ArrayType(DoubleType())),
            StructField("background_counts", DoubleType()),
            StructField("long_fraction", DoubleType()),
            StructField("fit_rmse", DoubleType()),
        ]
    )

    def solve(batches):
        for pdf in batches:
            Y = np.array(pdf[counts].tolist(), dtype=float).T
            if Y.size == 0:
                continue
            Z = Y - residual_background
            if weighting == "poisson":
                if (Y < 0).any():
                    raise ValueError("Poisson weighting needs nonnegative curves")
                W = 1.0 / np.sqrt(np.maximum(Y, 1.0))
                X = np.vstack(
                    [nnls_small(basis * W[:, [j]], (Z[:, [j]] * W[:, [j]])) for j in range(Y.shape[1])]
                )
            else:
                X = nnls_small(basis, Z)
            comp = X[:, :k]
            mass = comp.sum(axis=1)
            out = pdf.copy()
            out["components"] = list(comp)
            out["background_counts"] = X[:, k] if fit_background else 0.0
            out["long_fraction"] = np.where(mass > 0, comp[:, -1] / np.where(mass > 0, mass, 1), np.nan)
            out["fit_rmse"] = np.sqrt(((Z - basis @ X.T) ** 2).mean(axis=0))
            yield out

    return df.mapInPandas(solve, schema)


def component_summaries(
    df: DataFrame, *, times: Sequence[float], lifetimes: Sequence[float], t0: float, sigma: float,
    period: float = 12.5, components: str = "components",
) -> DataFrame:
    """Amplitude fraction, weighted lifetimes and the sensor-only emission time."""
    taus = sorted(map(float, lifetimes))
    raw = decay.component_basis(times, taus, t0, sigma, period, normalize=None)
    area = raw.sum(axis=0)
    centre = (np.asarray(times)[:, None] * raw).sum(axis=0) / area
    c = [F.col(components)[j] for j in range(2)]
    a = [c[j] / float(area[j]) for j in range(2)]
    amp, mass = a[0] + a[1], c[0] + c[1]
    return df.withColumns(
        {
            "long_amplitude_fraction": F.when(amp > 0, a[1] / amp),
            "amplitude_weighted_lifetime": F.when(amp > 0, (a[0] * taus[0] + a[1] * taus[1]) / amp),
            "intensity_weighted_lifetime": F.when(mass > 0, (c[0] * taus[0] + c[1] * taus[1]) / mass),
            "sensor_mpet": F.when(
                mass > 0, (c[0] * float(centre[0]) + c[1] * float(centre[1])) / mass - t0
            ),
        }
    )


def residual_summary(df: DataFrame, observed: str, residuals: str) -> DataFrame:
    """Maximum, RMSE and area of residuals in percent of peak or area."""
    size = F.size(observed)
    peak = F.array_max(F.transform(observed, lambda x: F.abs(x)))
    area = total(F.transform(observed, lambda x: F.abs(x)))
    worst = F.array_max(F.transform(residuals, lambda x: F.abs(x)))
    rms = F.sqrt(total(F.transform(residuals, lambda x: x * x)) / size)
    return df.withColumns(
        {
            "max_residual_percent": F.when(peak > 0, 100.0 * worst / peak),
            "rmse_percent": F.when(peak > 0, 100.0 * rms / peak),
            "residual_area_percent": F.when(
                area > 0, 100.0 * total(F.transform(residuals, lambda x: F.abs(x))) / area
            ),
        }
    )


_DECAY = StructType(
    [
        StructField("lifetimes", ArrayType(DoubleType())),
        StructField("amplitudes", ArrayType(DoubleType())),
        StructField("t0", DoubleType()),
        StructField("sigma", DoubleType()),
        StructField("background", DoubleType()),
        StructField("lifetime_se", ArrayType(DoubleType())),
        StructField("cost", DoubleType()),
        StructField("success", BooleanType()),
    ]
)


def fit_decays(
    df: DataFrame, *, times: Sequence[float], counts: str = "counts", n_components: int = 1,
    period: float = 12.5, weighting: str = "poisson",
) -> DataFrame:
    """Bounded decay fit of every curve; adds a ``fit`` struct."""

    @F.pandas_udf(_DECAY)
    def fit(curves: pd.Series) -> pd.DataFrame:
        rows = [
            decay.fit_decay(times, c, n_components=n_components, period=period, weighting=weighting)
            for c in curves
        ]
        return pd.DataFrame(rows, columns=_DECAY.names)

    return df.withColumn("fit", fit(counts))


def fit_irf(
    df: DataFrame, *, times: Sequence[float], waveform: str, irf: str, components: int = 1,
    window: tuple[float, float] | None = None,
) -> DataFrame:
    """IRF-convolved exponential fit of every waveform."""
    names = ["tau", "amplitude", "offset", "shift", "r_square"]
    if components == 2:
        names += ["tau_long", "long_fraction"]
    schema = StructType([StructField(n, DoubleType()) for n in names])

    @F.pandas_udf(schema)
    def fit(w: pd.Series, h: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [decay.fit_irf(times, a, b, components=components, window=window) for a, b in zip(w, h)],
            columns=names,
        )

    return df.withColumn("fit", fit(waveform, irf))


def fit_global(
    aggregates: DataFrame,
    *,
    times: Sequence[float],
    recording: str = "recording",
    counts: str = "counts",
    period: float = 12.5,
    lifetimes: tuple[float, float] = (0.6, 2.5),
    sigma: float = 0.13,
    include_background: bool = True,
    rounds: int = 24,
) -> tuple[DataFrame, dict]:
    """Shared lifetimes and sigma over recordings, t0 per recording.

    Variable projection as a batched pattern search: every round scores a small
    cross of candidates over all recordings (distributed), sums the cost and
    moves or shrinks.  Each recording keeps its best t0 by a one-dimensional
    search inside its row.  Returns per-recording results and the parameters;
    ``converged`` tells whether the step fell below its limit within ``rounds``.
    """
    t = np.asarray(times, dtype=float)
    rows = cut(aggregates.select(recording, F.col(counts).alias("_c")))

    def project(curve, tau1, tau2, sg):
        y = np.asarray(curve, dtype=float)[:, None]

        def cost(t0):
            B = decay.component_basis(t, (tau1, tau2), t0, sg, period, background=include_background)
            x = nnls_small(B, y)
            r = y - B @ x.T
            return float((r * r).sum()), x[0]

        # The rise lies before the maximum by a few sigma at most.
        lo, hi = t[int(np.argmax(y))] - 1.0, t[int(np.argmax(y))] + 0.5
        g = (5**0.5 - 1) / 2
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        fa, fb = cost(a)[0], cost(b)[0]
        for _ in range(18):
            if fa < fb:
                hi, b, fb = b, a, fa
                a = hi - g * (hi - lo)
                fa = cost(a)[0]
            else:
                lo, a, fa = a, b, fb
                b = lo + g * (hi - lo)
                fb = cost(b)[0]
        t0 = 0.5 * (lo + hi)
        c, x = cost(t0)
        return c, t0, x

    result = StructType(
        [StructField("cost", DoubleType()), StructField("t0", DoubleType()),
         StructField("components", ArrayType(DoubleType()))]
    )

    @F.pandas_udf(result)
    def score(curve: pd.Series, a: pd.Series, b: pd.Series, s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [project(c, *np.exp([x, y, z])) for c, x, y, z in zip(curve, a, b, s)],
            columns=["cost", "t0", "components"],
        )

    def candidates(points):
        return F.array(
            *[
                F.struct(F.lit(k).alias("k"), *[F.lit(float(v)).alias(n) for n, v in zip("abs", p)])
                for k, p in enumerate(points)
            ]
        )

    cores = rows.sparkSession.sparkContext.defaultParallelism
    centre = np.log([*sorted(lifetimes), sigma])
    step = np.array([0.25, 0.25, 0.25])
    best, converged = None, False
    for _ in range(rounds):
        points = [centre]
        for j in range(3):
            for sign in (-1, 1):
                q = centre.copy()
                q[j] += sign * step[j]
                points.append(q)
        work = rows.select(recording, "_c", F.explode(candidates(points)).alias("p"))
        # The rows are tiny and the fits are not: spread recordings times
        # candidates over all cores (an explicit number is never coalesced).
        scored = work.repartition(cores, F.col(recording), F.col("p.k")).select(
            "p.k", score("_c", "p.a", "p.b", "p.s").alias("r")
        )
        # Seven numbers per round reach the driver.
        costs = {r["k"]: r["c"] for r in scored.groupBy("k").agg(F.sum("r.cost").alias("c")).collect()}
        k = min(costs, key=lambda i: (costs[i], i))
        best = costs[k]
        if k == 0:
            step = step / 2
            if step.max() < 1e-3:
                converged = True
                break
        else:
            centre = points[k]
    tau1, tau2, sg = map(float, np.exp(centre))
    final = rows.select(
        recording,
        score("_c", F.lit(float(centre[0])), F.lit(float(centre[1])), F.lit(float(centre[2]))).alias("r"),
    ).select(recording, "r.t0", "r.components", "r.cost")
    return final, {"tau_short": min(tau1, tau2), "tau_long": max(tau1, tau2), "sigma": sg, "cost": best,
                   "converged": converged}


def typical_counts(trace: DataFrame, s: Series, bin_sizes: Sequence[int] = (1, 2, 5, 10)) -> DataFrame:
    """k, short and long: medians of the component counts in full groups of ``k`` consecutive samples.

    ``trace``: keys, ``s.t``, short, long.  Groups with a missing value or without photons don't count.
    """
    rows = index_rows(trace.select(*s.keys, s.t, "short", "long"), s)
    whole = rows.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in bin_sizes])))
    sums = whole.groupBy(*s.keys, "k", F.floor(F.col("i") / F.col("k")).alias("_bin")).agg(
        F.count("short").alias("_a"), F.count("long").alias("_b"), F.sum("short").alias("short"), F.sum("long").alias("long"))
    full = sums.where("_a = k and _b = k and short + long > 0 and short + long < double('inf')")
    medians = [percentiles(full, ["k"], c, {c: 0.5}).select("k", F.greatest(c, F.lit(0.0)).alias(c)) for c in ("short", "long")]
    return medians[0].join(medians[1], "k")


def binning_sensitivity(
    components: DataFrame,
    *,
    times: Sequence[float],
    lifetimes: Sequence[float],
    t0: float,
    sigma: float,
    period: float = 12.5,
    n_bootstrap: int = 200,
    seed: int = 0,
) -> DataFrame:
    """Photon-noise precision per bin size from a Poisson bootstrap.

    ``components``: k, short and long counts of a typical group (``typical_counts``).  Draws
    are seeded by their label, so retries repeat them.
    """
    taus = sorted(map(float, lifetimes))
    B = decay.component_basis(times, taus, t0, sigma, period)
    t = np.asarray(times, dtype=float)
    draws = components.select("k", "short", "long").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_bootstrap - 1))))
    draws = draws.withColumn(
        "_seed", F.conv(F.substring(F.md5(label(seed, F.col("k"), F.col("b")).cast("binary")), 1, 12), 16, 10).cast("bigint")
    )
    schema = StructType([StructField("mpet", DoubleType()), StructField("fraction", DoubleType())])

    @F.pandas_udf(schema)
    def resample(s: pd.Series, l: pd.Series, sd: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, seed_ in zip(s, l, sd):
            y = np.random.default_rng(int(seed_)).poisson(np.maximum(B @ np.array([a, b]), 0.0))
            x = nnls_small(B, y[:, None].astype(float))[0]
            n = y.sum()
            out.append(((t * y).sum() / n - t0 if n else np.nan, x[1] / x.sum() if x.sum() else np.nan))
        return pd.DataFrame(out, columns=["mpet", "fraction"])

    x = draws.select("k", resample("short", "long", "_seed").alias("r")).select("k", "r.*")
    q = F.array(F.lit(0.025), F.lit(0.975))
    g = x.groupBy("k").agg(F.percentile("mpet", q).alias("m"), F.percentile("fraction", q).alias("f"))
    return g.select(
        "k",
        ((F.col("m")[1] - F.col("m")[0]) / 2 * 1000.0).alias("mpet_half_width_ps"),
        ((F.col("f")[1] - F.col("f")[0]) / 2).alias("fraction_half_width"),
    )
