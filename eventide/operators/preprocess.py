"""Preprocessing of interleaved two-colour photometry and locomotion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from eventide.core.checks import ContractError
from eventide.core.lineage import cut, small_batches
from eventide.core.ranks import percentiles
from eventide.core.series import Series, asof, index_rows, shift


def demultiplex(samples: DataFrame, pulses: DataFrame, s: Series, *, edge: int = 3) -> DataFrame:
    """One measurement per light pulse: median value and mean time.

    Uses the samples ``[rise + edge, fall - edge)``.  ``samples``: keys, i, t,
    v; ``pulses``: keys, rise_i, fall_i.
    """
    by_index = Series(s.keys, "i", None)
    ranges = cut(pulses).select(
        *s.keys,
        (F.col("rise_i") + edge).alias("i"),
        (F.col("fall_i") - edge).alias("_stop"),
        F.col("rise_i").alias("_pulse"),
    )
    found = asof(
        samples.select(*s.keys, "i", s.t, "v"), ranges, by_index,
        back={"_stop": "_stop", "rise_i": "_pulse"},
    )
    x = cut(found.filter(F.col("i") < F.col("_stop")))
    keys = [*s.keys, "rise_i"]
    medians = percentiles(x, keys, "v", {"v": 0.5}).drop("n")
    times = x.groupBy(*keys).agg(F.avg(s.t).alias(s.t))
    return times.join(medians, keys)


def too_short(pulses: DataFrame, edge: int) -> DataFrame:
    """Pulses that leave no sample between their edges (a contract violation)."""
    return pulses.filter(F.col("fall_i") - F.col("rise_i") <= 2 * edge)


def beyond_reference(
    experimental: DataFrame, reference: DataFrame, s: Series, *, tolerance: float = 1.5
) -> DataFrame:
    """Series whose experimental range exceeds the reference by 1.5 median steps."""
    keys = list(s.keys)
    steps = shift(reference.select(*keys, s.t), s, back={"_p": s.t})
    steps = steps.select(*keys, (F.col(s.t) - F.col("_p")).alias("_d"))
    dt = percentiles(steps, keys, "_d", {"_dt": 0.5}).drop("n")
    r = reference.groupBy(*keys).agg(F.min(s.t).alias("_r0"), F.max(s.t).alias("_r1"))
    e = experimental.groupBy(*keys).agg(F.min(s.t).alias("_e0"), F.max(s.t).alias("_e1"))
    limit = tolerance * F.col("_dt")
    return r.join(e, keys).join(dt, keys).filter(
        (F.col("_r0") - F.col("_e0") > limit) | (F.col("_e1") - F.col("_r1") > limit)
    )


def pulse_clock(
    samples: DataFrame,
    pulses: DataFrame,
    s: Series,
    *,
    max_mismatch: float = 0.01,
    invert: bool = True,
) -> DataFrame:
    """Give sample i the time of pulse i.

    When counts differ by at most ``max_mismatch`` the samples are resampled
    linearly over the normalised index; other series raise.  ``samples``:
    keys, i, v; ``pulses``: keys, s.t.
    """
    keys = list(s.keys)
    ordinal = index_rows(pulses.select(*keys, s.t), s, "pulse_i")
    n_samples = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    n_pulses = pulses.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    counts = n_samples.join(n_pulses, keys)
    gap = F.abs(F.col("_n") - F.col("_m")) / F.greatest("_n", "_m")
    bad = counts.filter(gap > max_mismatch).limit(1).collect()
    if bad:
        raise ContractError(f"locomotion / pulse mismatch exceeds the limit: {bad[0].asDict()}")
    by_index = Series(s.keys, "i", None)
    x = shift(samples.select(*keys, "i", "v"), by_index, ahead={"_nv": "v"})
    place = F.when(F.col("_m") > 1, F.col("pulse_i") * ((F.col("_n") - 1) / (F.col("_m") - 1))).otherwise(0.0)
    q = ordinal.join(counts, keys).withColumn("_x", place)
    q = q.withColumn("i", F.least(F.floor("_x"), F.col("_n") - 1).cast("bigint"))
    frac = F.col("_x") - F.col("i")
    v = F.when(F.col("_nv").isNull(), F.col("v")).otherwise(
        F.col("v") + frac * (F.col("_nv") - F.col("v"))
    )
    return q.join(x, [*keys, "i"]).select(
        *keys, "pulse_i", s.t, (-v if invert else v).alias("v")
    )


# ------------------------------------------------------------ robust regression

TUNING = 1.4


def _fit_small(x: np.ndarray, y: np.ndarray, tuning: float, max_iter: int, tol: float):
    """Bisquare fit of one session that fits a task; returns (b0, b1)."""
    X = np.column_stack((np.ones_like(x), x))
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    centred = x - x.mean()
    sxx = float(centred @ centred)
    lev = 1.0 / x.size + (centred**2 / sxx if sxx > 0 else 0.0)
    shrink = np.sqrt(1.0 - np.minimum(lev, 0.9999))
    for _ in range(max_iter):
        r = y - X @ b
        dev = np.sort(np.abs(r - np.median(r)))[2:]
        scale = float(np.median(dev)) / 0.6745
        if scale <= np.finfo(float).eps:
            break
        u = r / shrink / (tuning * scale)
        root = np.where(np.abs(u) < 1, 1 - u**2, 0.0)
        new = np.linalg.lstsq(X * root[:, None], y * root, rcond=None)[0]
        moved, size = np.linalg.norm(new - b), max(np.linalg.norm(b), 1.0)
        b = new
        if moved <= tol * size:
            break
    return float(b[0]), float(b[1])


def robust_fit(
    df: DataFrame,
    keys: list[str],
    *,
    x: str = "x",
    y: str = "y",
    tuning: float = TUNING,
    max_iter: int = 50,
    tolerance: float = 1e-8,
    rows_per_task: int = 2_000_000,
) -> DataFrame:
    """Robust line ``y = b0 + b1 x`` per session (iterated bisquare weights).

    Sessions of at most ``rows_per_task`` rows are fitted in one task each.
    Larger ones take the same iteration as distributed sums and exact ranks.
    """
    data = df.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    sizes = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 3")
    data = data.join(sizes, keys)
    fields = ", ".join(f"`{k}` {data.schema[k].dataType.simpleString()}" for k in keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        b0, b1 = _fit_small(
            pdf["_x"].to_numpy(float), pdf["_y"].to_numpy(float), tuning, max_iter, tolerance
        )
        return pd.DataFrame([[*pdf[keys].iloc[0], b0, b1]], columns=[*keys, "b0", "b1"])

    small = (
        data.filter(F.col("_n") <= rows_per_task)
        .groupBy(*keys)
        .applyInPandas(fit, f"{fields}, b0 double, b1 double")
    )
    if sizes.filter(F.col("_n") > rows_per_task).isEmpty():
        return small
    large = _fit_large(data.filter(F.col("_n") > rows_per_task), keys, tuning, max_iter, tolerance)
    return small.unionByName(large)


_CHUNK, _RANKED, _COARSE, _FINE = 250_000, 50_000, 46, 26


def _coded(v: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles ``v``."""
    i = (v + 0.0).view(np.int64)
    return i ^ ((i >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def _decoded(i: np.ndarray) -> np.ndarray:
    i = np.asarray(i, np.int64)
    return (i ^ ((i >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(float)


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and the sums of their counts."""
    found, where = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(where, np.concatenate(counts), len(found)).astype(np.int64)


def _chunks(data: DataFrame) -> DataFrame:
    """``_id, x, y``: rows of numbered sessions as arrays of bounded length, cut where the rows lie."""

    def pack(batches):
        held: dict[int, list] = {}
        size: dict[int, int] = {}

        def sent(k):
            x, y = (np.concatenate(c) for c in zip(*held.pop(k)))
            del size[k]
            return pd.DataFrame({"_id": [k], "x": [x.tobytes()], "y": [y.tobytes()]})

        for pdf in batches:
            for k, part in pdf.groupby("_id"):
                held.setdefault(int(k), []).append((part["_x"].to_numpy(float), part["_y"].to_numpy(float)))
                size[int(k)] = size.get(int(k), 0) + len(part)
            crowded = sum(size.values()) > 8 * _CHUNK
            for k in [k for k, n in size.items() if crowded or n >= _CHUNK]:
                yield sent(k)
        for k in list(held):
            yield sent(k)

    return cut(data.mapInPandas(pack, "_id int, x binary, y binary"))


def _ranked(chunks: DataFrame, values, positions: dict[int, float], near: dict[int, tuple]) -> dict[int, float]:
    """Values at fractional positions of every session's sorted ``values(id, x, y)``, linear between ranks.

    Values are counted by their leading bits, then only those that share the bits of the position are
    counted by more, so a session sends no more than bounded histograms.  ``near``: a narrow range where the
    value is looked for first, in one pass; if it isn't there, the search starts over.
    """
    low, high = -(1 << 63), (1 << 63) - 1
    # Codes from, to; bits left out.
    wanted = {k: (*map(int, _coded(np.array(near[k]))), 0) if k in near else (low, high, _COARSE) for k in positions}
    out: dict[int, float] = {}
    while wanted:
        asked = dict(wanted)

        def tally(batches):
            held: dict[int, tuple] = {}
            under: dict[int, int] = {}
            for pdf in batches:
                for k, x, y in zip(pdf["_id"], pdf["x"], pdf["y"]):
                    if k not in asked:
                        continue
                    first, last, shift_ = asked[k]
                    code = _coded(values(k, np.frombuffer(x), np.frombuffer(y)))
                    under[k] = under.get(k, 0) + int(np.count_nonzero(code < first))
                    code = code[(code >= first) & (code <= last)] >> shift_
                    new = np.unique(code, return_counts=True)
                    held[k] = _summed(*([a, b] for a, b in zip(held[k], new))) if k in held else new
            for k, (codes, counts) in held.items():
                yield pd.DataFrame({"_id": [k], "under": [under[k]], "codes": [codes.tobytes()],
                                    "counts": [counts.astype(np.int64).tobytes()]})

        def narrow(pdf: pd.DataFrame) -> pd.DataFrame:
            k = int(pdf["_id"].iloc[0])
            below, shift_ = int(pdf["under"].sum()), asked[k][2]
            codes, counts = _summed([np.frombuffer(c, np.int64) for c in pdf["codes"]], [np.frombuffer(c, np.int64) for c in pdf["counts"]])
            upto = below + np.cumsum(counts)
            if not below <= np.floor(positions[k]) <= np.ceil(positions[k]) < below + counts.sum():
                return pd.DataFrame({"_id": [k], "first": [low], "last": [high], "inside": [-1]})
            at = [int(np.searchsorted(upto, r, side="right")) for r in (np.floor(positions[k]), np.ceil(positions[k]))]
            first, last = (int(codes[i]) for i in at)
            inside = int(upto[at[1]] - upto[at[0]] + counts[at[0]])
            return pd.DataFrame({"_id": [k], "first": [first << shift_], "last": [(last << shift_) + (1 << shift_) - 1],
                                 "inside": [inside]})

        parts = chunks.where(F.col("_id").isin(list(asked))).mapInPandas(tally, "_id int, under long, codes binary, counts binary")
        found = parts.groupBy("_id").applyInPandas(narrow, "_id int, first long, last long, inside long").collect()
        wanted = {}
        for r in found:
            shift_ = asked[r["_id"]][2]
            if r["inside"] < 0:
                wanted[r["_id"]] = (low, high, _COARSE)
            elif shift_ == 0:
                a, b = _decoded(np.array([r["first"], r["last"]]))
                p = positions[r["_id"]]
                out[r["_id"]] = float(a + (b - a) * (p - np.floor(p)))
            else:
                fine = 0 if r["inside"] <= _RANKED or shift_ == _FINE else _FINE
                wanted[r["_id"]] = (r["first"], r["last"], fine)
    return out


def _fit_large(
    data: DataFrame, keys: list[str], tuning: float, max_iter: int, tolerance: float
) -> DataFrame:
    """The same iteration over sessions of any size; the driver holds the lines, one per large session."""
    spark, x, y = data.sparkSession, F.col("_x"), F.col("_y")
    data = data.where(x.isNotNull() & y.isNotNull()).drop("_n")
    first = data.groupBy(*keys).agg(
        F.regr_intercept(y, x).alias("b0"), F.regr_slope(y, x).alias("b1"), F.avg(x).alias("_mx"),
        (F.var_pop(x) * F.count(x)).alias("_sxx"), F.count(x).alias("_n"),
    ).collect()
    named = StructType([StructField("_id", IntegerType()), *[data.schema[k] for k in keys]])
    numbered = spark.createDataFrame([(i, *[r[k] for k in keys]) for i, r in enumerate(first)], named)
    same = F.lit(True)
    for k in keys:
        same = same & data[k].eqNullSafe(numbered[k])
    chunks = _chunks(data.join(F.broadcast(numbered), same).select("_id", "_x", "_y"))
    lines = {i: (r["b0"], r["b1"]) if r["b1"] is not None else (r["b0"] or 0.0, 0.0) for i, r in enumerate(first)}
    open_ = {i for i in lines if first[i]["_n"] >= 3}
    seen: list[tuple[dict, dict]] = []

    def near(which: int) -> dict[int, tuple]:
        """Twice the last move around the last value, where that is a small part of the scale."""
        if len(seen) < 2:
            return {}
        (old, new), spread = (s[which] for s in seen[-2:]), seen[-1][1]
        move = {i: 2 * abs(new[i] - old[i]) + 1e-9 * spread[i] for i in new}
        return {i: (new[i] - m, new[i] + m) for i, m in move.items() if 0 < m < 0.002 * spread[i]}

    with small_batches(spark, 32 << 20):
        for _ in range(max_iter):
            if not open_:
                break
            b = {i: lines[i] for i in open_}
            med = _ranked(chunks, lambda k, u, v: v - (b[k][0] + b[k][1] * u), {i: 0.5 * (first[i]["_n"] - 1) for i in b}, near(0))
            # The two smallest deviations are left out of the scale.
            mad = _ranked(chunks, lambda k, u, v: np.abs(v - (b[k][0] + b[k][1] * u) - med[k]),
                          {i: 2 + 0.5 * (first[i]["_n"] - 3) for i in b}, near(1))
            seen = [*seen[-1:], (med, mad)]
            scale = {i: m / 0.6745 for i, m in mad.items()}
            open_ = {i for i in b if scale[i] > np.finfo(float).eps}
            if not open_:
                break
            shape = {i: (*b[i], scale[i], first[i]["_mx"], first[i]["_sxx"], first[i]["_n"]) for i in open_}

            def weigh(batches):
                for pdf in batches:
                    out = []
                    for k, u, v in zip(pdf["_id"], pdf["x"], pdf["y"]):
                        if k not in shape:
                            continue
                        b0, b1, s, mx, sxx, n = shape[k]
                        u, v = np.frombuffer(u), np.frombuffer(v)
                        c = u - mx
                        lev = 1.0 / n + (c * c / sxx if sxx > 0 else 0.0)
                        q = (v - (b0 + b1 * u)) / np.sqrt(1 - np.minimum(lev, 0.9999)) / (tuning * s)
                        w = np.where(np.abs(q) < 1, (1 - q * q) ** 2, 0.0)
                        out.append((k, w.sum(), w @ c, w @ v, (w * c) @ c, (w * c) @ v))
                    yield pd.DataFrame(out, columns=["_id", *_WEIGHED])

            # A few numbers per chunk, added up by session.
            sums = chunks.where(F.col("_id").isin(list(shape))).mapInPandas(
                weigh, "_id int, " + ", ".join(f"{c} double" for c in _WEIGHED)
            ).toPandas().groupby("_id").sum().reset_index()
            for r in sums.to_dict("records"):
                i, (b0, b1) = r["_id"], b[r["_id"]]
                sw, swx, swy, swxx, swxy = (r[c] for c in _WEIGHED)
                det = sw * swxx - swx * swx
                n1 = (sw * swxy - swx * swy) / det if det != 0 else b1
                n0 = (swy - n1 * swx) / sw - n1 * first[i]["_mx"] if sw > 0 else b0
                lines[i] = (n0, n1)
                if np.hypot(n0 - b0, n1 - b1) <= tolerance * max(np.hypot(b0, b1), 1.0):
                    open_.discard(i)
    fields = StructType([*[data.schema[k] for k in keys], StructField("b0", DoubleType()), StructField("b1", DoubleType())])
    return spark.createDataFrame([(*[r[k] for k in keys], *(map(float, lines[i]) if r["_n"] >= 3 else (None, None))) for i, r in enumerate(first)], fields)


_WEIGHED = ("sw", "swx", "swy", "swxx", "swxy")


def delta_f_over_f(df: DataFrame, fits: DataFrame, keys: list[str], *, x: str = "x", y: str = "y") -> DataFrame:
    """Fitted reference and ``(y - fit) / fit``."""
    z = df.join(fits, keys).withColumn("fitted", F.col("b0") + F.col("b1") * F.col(x))
    return z.withColumn("dff", (F.col(y) - F.col("fitted")) / F.when(F.col("fitted") != 0, F.col("fitted"))).drop(
        "b0", "b1"
    )


def fit_quality(fitted: DataFrame, keys: list[str], *, y: str = "y") -> DataFrame:
    """Correlation of signal and fit, root mean square error."""
    d = F.col(y) - F.col("fitted")
    return fitted.groupBy(*keys).agg(
        F.corr(y, "fitted").alias("r"), F.sqrt(F.avg(d * d)).alias("rmse")
    )


def fractional(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """``(v - median) / median`` of every series."""
    med = percentiles(df, keys, value, {"_med": 0.5}).drop("n")
    return df.join(med, keys).withColumn(
        value, (F.col(value) - F.col("_med")) / F.col("_med")
    ).drop("_med")
