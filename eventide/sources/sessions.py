"""Canonical session tables and the dataset registry."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.core.checks import ContractError, require_none

# Schema versions of processed data.
PROCESSED_VERSION = "1.0"
LIFETIME_VERSION = "1.3"
REGISTRY_VERSION = "1.0"
CALIBRATION_VERSIONS = ("1.0", "2.0", "2.1")

SCHEMAS = {
    "sessions": "session_id string, mouse string, date string, run int, grp string, cond string, "
    "channel int, meta map<string,string>",
    "signals": "session_id string, signal string, i bigint, t double, v double",
    "events": "session_id string, event string, i bigint, t double",
    "intervals": "session_id string, name string, i bigint, t0 double, t1 double",
    "curves": "session_id string, i bigint, t double, counts array<double>",
}


def load_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Canonical tables of a processed store; filters prune by partition."""
    return {n: spark.read.schema(s).parquet(f"{root}/{n}") for n, s in SCHEMAS.items()}


def require_version(sessions: DataFrame, expected: str, key: str = "schema_version") -> None:
    require_none(
        sessions.filter(~F.col("meta")[key].eqNullSafe(F.lit(expected))),
        f"processed sessions must have version {expected}",
    )


def from_archive(rows: DataFrame) -> dict[str, DataFrame]:
    """Lifetime archives (key, i, value) to canonical tables.

    Keys read ``continuous_<name>_time|values``, ``events_<name>`` and
    ``intervals_<name>_starts|ends``; positions pair values with times.
    """
    key = F.col("key")

    def paired(prefix: str, first: str, second: str, a: str, b: str, label: str) -> DataFrame:
        pattern = f"^{prefix}_(.+)_({first}|{second})$"
        x = rows.filter(key.rlike(pattern)).select(
            F.col("path").alias("session_id"), F.regexp_extract(key, pattern, 1).alias(label), "i",
            F.regexp_extract(key, pattern, 2).alias("_part"), "value",
        )
        return x.groupBy("session_id", label, "i").agg(
            F.max(F.when(F.col("_part") == first, F.col("value"))).alias(a),
            F.max(F.when(F.col("_part") == second, F.col("value"))).alias(b),
        )

    events = rows.filter(key.rlike("^events_.+$")).select(
        F.col("path").alias("session_id"), F.regexp_extract(key, "^events_(.+)$", 1).alias("event"),
        "i", F.col("value").alias("t"),
    )
    return {
        "signals": paired("continuous", "time", "values", "t", "v", "signal"),
        "intervals": paired("intervals", "starts", "ends", "t0", "t1", "name"),
        "events": events,
    }


def pair_intervals(starts: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """Start i with end i; an end that is missing or early becomes NULL."""
    b = ends.select(*keys, "i", F.col("t").alias("t1"))
    x = starts.select(*keys, "i", F.col("t").alias("t0")).join(b, [*keys, "i"], "left")
    return x.withColumn("t1", F.when(F.col("t1") >= F.col("t0"), F.col("t1")))


def overlapping(intervals: DataFrame, window: tuple[float, float]) -> DataFrame:
    """Intervals that touch the window (an open end counts as its start)."""
    end = F.coalesce("t1", "t0")
    return intervals.filter((end >= window[0]) & (F.col("t0") <= window[1]))


# Lifetime signals given in nanoseconds and shown in picoseconds.
PICOSECOND_SIGNALS = (
    "tau", "mpet", "mpet_raw", "mpet_background_corrected", "mpet_corrected",
    "amplitude_weighted_lifetime", "intensity_weighted_lifetime", "sensor_only_fitted_mpet",
    "fitted_mpet", "short_lifetime", "long_lifetime",
)


def display_value(signal: str = "signal", value: str = "v", units: str = "units") -> Column:
    scaled = F.col(signal).isin(*PICOSECOND_SIGNALS) & (F.col(units) == "ns")
    return F.when(scaled, F.col(value) * 1000.0).otherwise(F.col(value))


def safe_relative(path: str) -> str:
    parts = path.replace("\\", "/").split("/")
    if path.startswith(("/", "\\")) or ".." in parts or parts[0].endswith(":") or not path:
        raise ContractError(f"paths must be relative and contained: {path!r}")
    return "/".join(parts)


def load_registry(path: str) -> dict[str, str]:
    """Named datasets of a JSON registry (a small driver-side file)."""
    with open(path, encoding="utf-8") as f:
        payload = json.load(f)
    if payload.get("schema_version") != REGISTRY_VERSION:
        raise ContractError("unsupported registry version")
    return {name: safe_relative(p) for name, p in payload["datasets"].items()}


CALIBRATION_SCHEMA = (
    "schema_version string, lifetimes array<double>, t0 double, irf_sigma double, "
    "lifetime_time array<double>, pulse_interval double, spc_range array<double>, "
    "afterpulse_ratio double, success boolean, message string, fixed_background double"
)


def load_calibrations(spark: SparkSession, path: str) -> DataFrame:
    """Calibration files; failed fits and unknown versions raise."""
    c = spark.read.schema(CALIBRATION_SCHEMA).option("multiLine", True).json(path)
    bad = (
        ~F.col("schema_version").isin(*CALIBRATION_VERSIONS)
        | ~F.coalesce("success", F.lit(False))
        | (F.size("lifetimes") != 2)
        | F.exists("lifetimes", lambda x: x <= 0)
        | (F.coalesce("fixed_background", F.lit(0.0)) != 0)
        | ~F.coalesce(F.col("pulse_interval") > 0, F.lit(False))
    )
    require_none(c.filter(F.coalesce(bad, F.lit(True))), "invalid calibration")
    return c


def compatible_periods(a: Column, b: Column, tolerance: float = 1e-3) -> Column:
    """Pulse intervals that agree within 0.1 %."""
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))
