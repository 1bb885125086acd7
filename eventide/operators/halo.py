"""Event-aligned means of very many onsets (shuffles) without rows per lag.

Time is cut in blocks.  A block gets the onsets that lie in it and every stretch of signal that
their windows may touch, its own and that of its neighbours (the halo), so all windows of a
block can be cut out at once: one sorted search per block evaluates the whole lag grid of all its
onsets as a matrix.  Trials are normalised and averaged right there; one row per series, block
and shuffle goes on.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from eventide.core.numeric import check_window, lag_count
from eventide.core.series import Series, shift
from eventide.functions.hashed import label, uniforms

#: Shuffles of a block that one group may hold, and onsets that a group holds on average.
SHUFFLES, ONSETS = 64, 100_000
#: Onsets of a series in one part up to which all its blocks go to one group.
TOGETHER = 400_000
#: Events and samples of a series up to which its random onsets are drawn in one task; onsets that it looks up at a time.
EVENTS, SAMPLES, HELD = 2_000, 1_000_000, 8192


def windows(t0: np.ndarray, t1: np.ndarray, v0: np.ndarray, v1: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interpolated values at the times ``at`` (NaN where missing), and which times lie outside the signal.

    Stretches [t0, t1) are sorted; the last one of a series has no end.
    """
    if not len(t0):
        return np.full(at.shape, np.nan), np.ones(at.shape, bool)
    k = np.searchsorted(t0, at, side="right") - 1
    outside = k < 0
    k = np.maximum(k, 0)
    since = at - t0[k]
    on = since == 0
    outside |= ~on & ~(at <= t1[k])
    with np.errstate(invalid="ignore", divide="ignore"):
        slope = (v1 - v0) / (t1 - t0)
        first = v0[k]
        value = np.where(on, first, first + since * slope[k])
    return np.where(outside, np.nan, value), outside


def normalised(v: np.ndarray, rel: np.ndarray, mode: str, baseline: tuple[float, float]) -> np.ndarray:
    """Rows less the mean of their baseline ``[b0, b1)``, divided by its deviation for ``zscore``."""
    if mode == "none":
        return v
    base = v[:, (rel >= baseline[0]) & (rel < baseline[1])]
    known = np.isfinite(base)
    n = known.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(known, base, 0.0).sum(axis=1) / n
        v = v - mean[:, None]
        if mode == "zscore":
            squares = np.where(known, base - mean[:, None], 0.0) ** 2
            sd = np.sqrt(squares.sum(axis=1) / (n - 1))
            v = v / np.where(sd > 0, sd, np.nan)[:, None]
    return v


def _windows_of_blocks(
    samples: DataFrame, onsets: DataFrame, s: Series, window: tuple[float, float], dt: float, value: str, shuffle: str,
    carried: list[str], schema: StructType, use: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame],
    together: bool = False,
) -> DataFrame:
    """``use(onsets, values, lags)`` of the complete windows of every bucket of blocks, as rows of ``schema``.

    ``together`` keeps all blocks of a series and part in one bucket, and one part only in each.
    """
    start, end = check_window(window)
    keys = list(s.keys)
    rel = start + np.arange(lag_count(window, dt) + 1) * float(dt)
    width = max(float(s.width or 0.0), end - start)
    stretches = shift(samples.select(*keys, s.t, value), s, ahead={"_t1": s.t, "_v1": value}).select(
        *keys, F.col(s.t).alias("_t0"), "_t1", F.col(value).cast("double").alias("_v0"), F.col("_v1").cast("double").alias("_v1"))
    first, last = F.floor((F.col("_t0") - end) / width), F.floor((F.coalesce("_t1", "_t0") - start) / width)
    stretches = stretches.withColumn("_block", F.explode(F.sequence(first, last)))
    here = onsets.select(*keys, *carried, F.col(shuffle).cast("bigint").alias("_shuffle"), F.col(s.t).alias("_t"),
                         F.floor(F.col(s.t) / width).alias("_block"))
    here = here.withColumn("_part", F.floor(F.col("_shuffle") / SHUFFLES))
    sizes = here.agg(F.count(F.lit(1)).alias("n"), F.min("_part").alias("lo"), F.max("_part").alias("hi")).first()
    low, high = sizes["lo"] or 0, sizes["hi"] or 0
    parts = F.explode(F.sequence(F.lit(low).cast("bigint"), F.lit(high).cast("bigint")))
    buckets = max(1, -(-sizes["n"] // ONSETS))
    place = [*keys, "_block", "_part"]

    def bucketed(df: DataFrame) -> DataFrame:
        if not together:
            return df.withColumn("_bucket", F.pmod(F.xxhash64(*place), F.lit(buckets)))
        own = max(1, -(-buckets // (high - low + 1)))
        return df.withColumn("_bucket", F.col("_part") * own + F.pmod(F.xxhash64(*keys), F.lit(own)))

    names = [f.name for f in schema.fields]

    def look(signal: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        if len(at) == 0 or len(signal) == 0:
            return pd.DataFrame(columns=names)
        both = pd.concat([signal[place], at[place]], ignore_index=True).groupby(place, sort=False, dropna=False).ngroup().to_numpy()
        own, code = both[:len(signal)], both[len(signal):]
        order = np.lexsort((signal["_t0"].to_numpy(), own))
        own = own[order]
        t0, t1, v0, v1 = (signal[c].to_numpy(float)[order] for c in ("_t0", "_t1", "_v0", "_v1"))
        by = np.argsort(code, kind="stable")
        at, code = at.iloc[by].reset_index(drop=True), code[by]
        t, v = at["_t"].to_numpy(float), np.empty((len(at), len(rel)))
        complete = np.zeros(len(at), bool)
        groups, begin = np.unique(code, return_index=True)
        for g, i, j in zip(groups, begin, np.append(begin[1:], len(at))):
            a, b = np.searchsorted(own, [g, g + 1])
            v[i:j], outside = windows(t0[a:b], t1[a:b], v0[a:b], v1[a:b], t[i:j, None] + rel)
            complete[i:j] = ~outside[:, [0, -1]].any(axis=1)
        if not complete.any():
            return pd.DataFrame(columns=names)
        return use(at[complete], v[complete], rel)

    return bucketed(stretches.withColumn("_part", parts)).groupBy("_bucket").cogroup(
        bucketed(here).groupBy("_bucket")).applyInPandas(look, schema)


def _sums(at: pd.DataFrame, by: list[str], v: np.ndarray) -> pd.DataFrame:
    """``by``, _sum and _n: per lag the sum and number of the values of equal ``by``."""
    known = np.isfinite(v)
    which = at.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(which, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(which[order]) > 0])
    out = at.iloc[order[edge]][by].reset_index(drop=True)
    out["_sum"] = list(np.add.reduceat(np.where(known, v, 0.0)[order], edge, axis=0))
    out["_n"] = list(np.add.reduceat(known[order].astype(np.int64), edge, axis=0))
    return out


def _sums_schema(fields: list[StructField]) -> StructType:
    return StructType([*fields, StructField("_shuffle", LongType()),
                       StructField("_sum", ArrayType(DoubleType())), StructField("_n", ArrayType(LongType()))])


def shuffle_means(
    samples: DataFrame, onsets: DataFrame, s: Series, window: tuple[float, float], dt: float, *,
    mode: str = "zscore", baseline: tuple[float, float] = (-5.0, 0.0), value: str = "v", shuffle: str = "shuffle",
) -> DataFrame:
    """keys, shuffle and means: per lag the mean over all complete windows of a series and shuffle.

    ``onsets`` has keys, ``shuffle`` and ``s.t``.  Windows that leave the recording count for
    nothing; lags without a value are NULL.
    """
    if mode not in ("none", "subtract", "zscore"):
        raise ValueError("mode must be 'none', 'subtract' or 'zscore'")
    keys = list(s.keys)

    def use(at: pd.DataFrame, v: np.ndarray, rel: np.ndarray) -> pd.DataFrame:
        return _sums(at, [*keys, "_shuffle"], normalised(v, rel, mode, baseline))

    pieces = _windows_of_blocks(samples, onsets, s, window, dt, value, shuffle, [],
                                _sums_schema([onsets.schema[k] for k in keys]), use)
    # One row per block of a series and shuffle.
    whole = pieces.groupBy(*keys, "_shuffle").agg(F.collect_list("_sum").alias("_s"), F.collect_list("_n").alias("_c"))

    def added(column: str):
        return F.aggregate(F.slice(column, 2, F.greatest(F.size(column) - 1, F.lit(0))), F.col(column)[0],
                           lambda a, b: F.zip_with(a, b, lambda x, y: x + y))

    mean = F.zip_with(added("_s"), added("_c"), lambda x, n: F.when(n > 0, x / n))
    return whole.select(*keys, F.col("_shuffle").cast("int").alias(shuffle), mean.alias("means"))


def group_means(
    samples: DataFrame, onsets: DataFrame, s: Series, window: tuple[float, float], dt: float, group: str, *,
    mode: str = "zscore", baseline: tuple[float, float] = (-5.0, 0.0), value: str = "v", shuffle: str = "shuffle",
) -> DataFrame:
    """group, shuffle, lag_i, v: the mean over the series of a group of their ``shuffle_means``.

    ``group`` is a column of ``onsets``, one value per series.  Series with at most ``TOGETHER``
    onsets in a part are averaged where their windows are cut out, so a task passes on one row
    per group and shuffle; if one has more, rows of every series and shuffle are averaged.
    """
    keys = list(s.keys)
    part = F.floor(F.col(shuffle) / SHUFFLES)
    most = onsets.groupBy(*keys, part).count().agg(F.max("count")).first()[0] or 0
    if most > TOGETHER:
        means = by_lag(shuffle_means(samples, onsets.drop(group), s, window, dt, mode=mode, baseline=baseline,
                                     value=value, shuffle=shuffle))
        named = onsets.select(*keys, group).distinct()
        return means.join(named, keys).groupBy(group, shuffle, "lag_i").agg(F.avg("v").alias("v"))

    def use(at: pd.DataFrame, v: np.ndarray, rel: np.ndarray) -> pd.DataFrame:
        own = _sums(at, [*keys, group, "_shuffle"], normalised(v, rel, mode, baseline))
        n = np.stack(own["_n"])
        with np.errstate(invalid="ignore", divide="ignore"):
            return _sums(own, [group, "_shuffle"], np.stack(own["_sum"]) / n)

    pieces = _windows_of_blocks(samples, onsets, s, window, dt, value, shuffle, [group],
                                _sums_schema([onsets.schema[group]]), use, together=True)
    cells = pieces.select(group, "_shuffle", F.posexplode(F.arrays_zip("_sum", "_n")).alias("lag_i", "_c"))
    summed = cells.groupBy(group, "_shuffle", "lag_i").agg(F.sum("_c._sum").alias("_s"), F.sum("_c._n").alias("_n"))
    return summed.select(group, F.col("_shuffle").cast("int").alias(shuffle), "lag_i",
                         F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).alias("v"))


def _spread(v: np.ndarray, rel: np.ndarray, baseline: tuple[float, float]) -> dict[str, np.ndarray]:
    """Deviation and mean of the baseline of each row, and its extremes; NaN where there is none."""
    out = {}
    base = v[:, (rel >= baseline[0]) & (rel < baseline[1])]
    known = np.isfinite(base)
    n = known.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(known, base, 0.0).sum(axis=1) / n
        squares = (np.where(known, base - mean[:, None], 0.0) ** 2).sum(axis=1)
        level = np.where(known, base, -np.inf).max(axis=1) == np.where(known, base, np.inf).min(axis=1)
        out["sd"] = np.where(n > 1, np.sqrt(np.where(level, 0.0, squares) / (n - 1)), np.nan)
    out["m"], here = mean, np.isfinite(v)
    for name, far, pick in (("hi", -np.inf, np.max), ("lo", np.inf, np.min)):
        edge = pick(np.where(here, v, far), axis=1)
        out[name] = np.where(np.isfinite(edge), edge, np.nan)
    return out


def trial_spread(
    samples: DataFrame, onsets: DataFrame, s: Series, window: tuple[float, float], dt: float, *,
    baseline: tuple[float, float], value: str = "v", shuffle: str = "shuffle",
) -> DataFrame:
    """keys, s.t, sd, m, hi and lo of every complete window: spread and mean of its baseline ``[b0, b1)``, its extremes."""
    keys = list(s.keys)
    numbers = ["sd", "m", "hi", "lo"]
    schema = StructType([*[onsets.schema[k] for k in keys], *[StructField(c, DoubleType()) for c in (s.t, *numbers)]])

    def use(at: pd.DataFrame, v: np.ndarray, rel: np.ndarray) -> pd.DataFrame:
        out = at[keys].reset_index(drop=True)
        out[s.t] = at["_t"].to_numpy(float)
        for name, x in _spread(v, rel, baseline).items():
            out[name] = x
        return out[[f.name for f in schema.fields]]

    found = _windows_of_blocks(samples, onsets, s, window, dt, value, shuffle, [], schema, use)
    return found.select(*keys, s.t, *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in numbers])


def oversized(samples: DataFrame, events: DataFrame, s: Series) -> DataFrame:
    """Keys of the series that have too many events or samples for ``random_spread``."""
    keys = list(s.keys)
    each = samples.select(*keys, F.lit(0).alias("_own")).unionByName(events.select(*keys, F.lit(1).alias("_own")))
    counted = each.groupBy(*keys).agg(F.count_if(F.col("_own") == 1).alias("_e"), F.count_if(F.col("_own") == 0).alias("_s"))
    return counted.filter((F.col("_e") > EVENTS) | (F.col("_s") > SAMPLES)).select(*keys)


def random_spread(
    samples: DataFrame, events: DataFrame, bounds: DataFrame, marks: DataFrame, s: Series, window: tuple[float, float], dt: float, *,
    baseline: tuple[float, float], n_shuffles: int = 500, seed: int = 0, value: str = "v", event_id: str = "event_i",
) -> DataFrame:
    """sd, m, hi, lo (``trial_spread``) and near of the complete windows of random onsets.

    The onsets are those of ``null_onsets`` with no exclusion; they are drawn, looked up and left where the
    signal of their series is, so only events and samples are shuffled.  ``near`` is the distance to the
    nearest time of ``marks``, NULL where a series has none.  A series is held by one task: see ``oversized``.
    """
    start, end = check_window(window)
    keys, names = list(s.keys), ["sd", "m", "hi", "lo", "near"]
    rel = start + np.arange(lag_count(window, dt) + 1) * float(dt)
    stretches = shift(samples.select(*keys, s.t, value), s, ahead={"_t1": s.t, "_v1": value}).select(
        *keys, F.col(s.t).alias("_t0"), "_t1", F.col(value).cast("double").alias("_v0"), F.col("_v1").cast("double").alias("_v1"))
    signal = stretches.withColumn("_mark", F.lit(False)).unionByName(
        marks.select(*keys, F.col(s.t).alias("_t0"), F.lit(True).alias("_mark")), allowMissingColumns=True)
    drawn = events.join(bounds.filter("hi > lo"), keys).select(
        *keys, label(seed, *[F.col(k) for k in keys]).alias("_head"), label("", F.col(event_id), "0").alias("_tail"), "lo", "hi")
    tasks = 4 * samples.sparkSession.sparkContext.defaultParallelism
    buckets = max(tasks, -(-drawn.count() * n_shuffles // ONSETS))

    def look(signal: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        if len(at) == 0 or len(signal) == 0:
            return pd.DataFrame(columns=names)
        both = pd.concat([signal[keys], at[keys]], ignore_index=True).groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        own, code = both[:len(signal)], both[len(signal):]
        lo, hi = at["lo"].to_numpy(float), at["hi"].to_numpy(float)
        t = uniforms([h.encode() for h in at["_head"]], 0, n_shuffles, [x.encode() for x in at["_tail"]])
        t = lo[:, None] + t * (hi - lo)[:, None]
        t0, t1, v0, v1 = (signal[c].to_numpy(float) for c in ("_t0", "_t1", "_v0", "_v1"))
        order = np.lexsort((t1, t0, signal["_mark"].to_numpy(bool), own))
        order = order[~np.isnan(t0[order])]
        own, mark = own[order], signal["_mark"].to_numpy(bool)[order]
        t0, t1, v0, v1 = t0[order], t1[order], v0[order], v1[order]
        found = []
        for g in np.unique(code):
            a, b = np.searchsorted(own, [g, g + 1])
            m = a + np.searchsorted(mark[a:b], True)  # the marks of a series come after its samples
            times = t[code == g].ravel()
            for i in range(0, len(times), HELD):
                some = times[i:i + HELD]
                v, outside = windows(t0[a:m], t1[a:m], v0[a:m], v1[a:m], some[:, None] + rel)
                complete = ~outside[:, [0, -1]].any(axis=1)
                if complete.any():
                    found.append(np.stack([*_spread(v[complete], rel, baseline).values(), nearest(some[complete], t0[m:b])], axis=1))
        return pd.DataFrame(np.concatenate(found) if found else np.empty((0, len(names))), columns=names)

    def bucketed(df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).repartition(tasks, "_bucket")

    out = bucketed(signal).groupBy("_bucket").cogroup(bucketed(drawn).groupBy("_bucket")).applyInPandas(
        look, ", ".join(f"{c} double" for c in names))
    return out.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in names])


def nearest(t: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Distance of each time to the nearest of the sorted marks; NaN if there are none."""
    if not len(marks):
        return np.full(len(t), np.nan)
    edged = np.r_[-np.inf, marks, np.inf]
    after = np.searchsorted(marks, t, side="left") + 1
    before = np.searchsorted(marks, t, side="right")
    return np.minimum(t - edged[before], edged[after] - t)


def by_lag(means: DataFrame) -> DataFrame:
    """``shuffle_means`` with a row per lag: lag_i and v in place of means."""
    kept = [c for c in means.columns if c != "means"]
    return means.select(*kept, F.posexplode("means").alias("lag_i", "v"))
