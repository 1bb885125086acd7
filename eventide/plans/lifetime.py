"""Calibration of lifetime shapes and its application to sessions."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.core.checks import ContractError
from eventide.core.lineage import cut
from eventide.core.ranks import percentiles
from eventide.operators import lifetime as lt


def window_curve(curve: str, times: Sequence[float], window: tuple[float, float]) -> tuple[F.Column, list[float]]:
    """Array slice of the bins inside a closed window and their times."""
    inside = [k for k, t in enumerate(times) if window[0] <= t <= window[1]]
    if not inside:
        raise ContractError("no lifetime bins fall inside the window")
    return F.slice(curve, inside[0] + 1, len(inside)), [float(times[k]) for k in inside]


def session_aggregates(curves: DataFrame, session: str, counts: str = "counts") -> DataFrame:
    """Area-normalised sum of all curves of a session (map-side combined)."""
    x = curves.select(session, F.posexplode(counts).alias("bin", "c"))
    sums = x.groupBy(session, "bin").agg(F.sum("c").alias("c"))
    packed = lt.pack_bins(sums, [session], "c", "counts")
    area = lt.total("counts")
    return packed.withColumn(
        "counts", lt.let(lambda r: F.transform("counts", lambda c: c / r["a"]), a=area)
    ).filter(F.col("counts")[0].isNotNull())


def calibrate(
    curves: DataFrame,
    session: str,
    times: Sequence[float],
    *,
    spc_range: tuple[float, float] = (0.4, 12.3),
    period: float = 12.5,
    lifetimes: tuple[float, float] = (0.6, 2.5),
    sigma: float = 0.13,
    rounds: int = 200,
) -> tuple[dict, DataFrame]:
    """Shared lifetimes and width over sessions, a t0 and a flag per session."""
    kept, inside = window_curve("counts", times, spc_range)
    windowed = curves.withColumn("counts", kept)
    aggregates = session_aggregates(windowed, session)
    results, p = lt.fit_global(
        aggregates, times=inside, recording=session, period=period, lifetimes=lifetimes, sigma=sigma,
        rounds=rounds,
    )
    results = cut(results)
    width = inside[1] - inside[0] if len(inside) > 1 else 0.0
    limit = max(2 * width, 0.25)
    centre = percentiles(results.withColumn("_all", F.lit(1)), ["_all"], "t0", {"median_t0": 0.5})
    quality = results.join(F.broadcast(centre.select("median_t0"))).withColumn(  # one row
        "t0_offset", F.abs(F.col("t0") - F.col("median_t0")) > limit
    )
    t0 = centre.first()["median_t0"]
    calibration = {
        "schema_version": "2.1", "lifetimes": [p["tau_short"], p["tau_long"]], "t0": t0,
        "irf_sigma": p["sigma"], "lifetime_time": inside, "pulse_interval": period,
        "spc_range": list(spc_range), "success": p["converged"],
        "message": "converged" if p["converged"] else "the search used up its rounds",
    }
    return calibration, quality


def apply_calibration(
    curves: DataFrame, calibration: dict, times: Sequence[float], *, period: float,
    fit_background: bool = True,
) -> DataFrame:
    """Component counts and summaries with the calibrated shape held fixed."""
    if not calibration.get("success"):
        raise ContractError("the calibration did not succeed")
    saved = calibration["pulse_interval"]
    if abs(saved - period) > 1e-3 * max(saved, period):
        raise ContractError("pulse intervals differ by more than 0.1 %")
    kept, inside = window_curve("counts", times, tuple(calibration["spc_range"]))
    stored = calibration["lifetime_time"]
    if len(stored) != len(inside) or max(abs(a - b) for a, b in zip(stored, inside)) > 1e-9:
        raise ContractError("lifetime bins differ from the calibration")
    shape = dict(
        times=inside, lifetimes=calibration["lifetimes"], t0=calibration["t0"],
        sigma=calibration["irf_sigma"], period=period,
    )
    fitted = lt.fit_target(curves.withColumn("counts", kept), fit_background=fit_background, **shape)
    return lt.component_summaries(fitted, **shape)


def window_sensitivity(
    corrected: DataFrame, times: F.Column, windows: dict[str, tuple[float, float]], *, t0: float
) -> DataFrame:
    """How the emission time depends on its window: r, median shift, RMSE (ps)."""
    base = next(iter(windows))
    x = corrected.select(
        *[lt.mpet("corrected", times, window=w, t0=t0).alias(f"m_{n}") for n, w in windows.items()]
    )
    out = None
    for name in windows:
        d = (F.col(f"m_{name}") - F.col(f"m_{base}")) * 1000.0
        y = x.select(F.col(f"m_{base}").alias("a"), F.col(f"m_{name}").alias("b"), d.alias("d")).dropna()
        y = y.withColumn("window", F.lit(name))
        g = y.groupBy("window").agg(
            F.corr("a", "b").alias("r"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse_ps")
        )
        g = g.join(percentiles(y, ["window"], "d", {"median_shift_ps": 0.5}), "window")
        out = g if out is None else out.unionByName(g)
    return out


def save_calibration(calibration: dict, path: str) -> None:
    """Small driver-side JSON; an existing file is never replaced."""
    with open(path, "x", encoding="utf-8") as f:
        json.dump(calibration, f, indent=2, sort_keys=True)
