"""Nested cross-validation from statistics, for any number of held-out units.

Inner folds of an outer unit leave out a second unit, so what has to be fitted is one model
per *pair* of units: the total less the statistics of both.  Units are dealt to blocks of about
``PER_BLOCK``; two blocks meet in a tile, which fits the pairs between them and returns sums of
scores per outer unit.  No task holds more than two blocks, whatever the number of units is, and
pairs never leave their tile.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from eventide.core.lineage import cut

PER_BLOCK = 16
STATS = ("xtx", "xty", "sx", "yty", "sy", "n")

#: Statistics of one unit or of several: matrix, vectors and numbers by the names in ``STATS``.
Moments = dict


def moments(row: dict, prefix: str = "") -> Moments:
    p = len(row[f"{prefix}xty"])
    out = {c: np.asarray(row[f"{prefix}{c}"], float) for c in ("xty", "sx")}
    out["xtx"] = np.reshape(np.asarray(row[f"{prefix}xtx"], float), (p, p))
    return out | {c: float(row[f"{prefix}{c}"]) for c in ("yty", "sy", "n")}


def less(a: Moments, b: Moments) -> Moments:
    return {c: a[c] - b[c] for c in STATS}


def _fields(df: DataFrame, names: Sequence[str]) -> list[StructField]:
    return [StructField(k, df.schema[k].dataType) for k in names]


def inner_scores(
    stats: DataFrame, total: DataFrame, keys: list[str], unit: str,
    score: Callable[[Moments, Moments, Moments], tuple[np.ndarray, np.ndarray]], *, per_block: int = PER_BLOCK,
) -> DataFrame:
    """keys, unit, means and counts: per choice the mean of the finite inner scores of every outer unit and their number.

    ``stats`` has one row per keys and unit, ``total`` their sums per keys.  ``score(total, a, b)``
    gives the scores of all choices on b with a held out by the outer loop, and on a with b held out.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    plain = stats.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(unit).alias("_unit"), *STATS)
    blocks = cut(plain.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / per_block).cast("int").alias("_blocks")))

    def by(a: DataFrame, b: DataFrame) -> DataFrame:
        same = F.lit(True)
        for n in names:
            same = same & a[n].eqNullSafe(b[n])
        return a.join(b, same, "inner").select(*[a[n] for n in names], *[
            c for c in (*[a[x] for x in a.columns if x not in names], *[b[x] for x in b.columns if x not in names])])

    own = F.pmod(F.xxhash64("_unit"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    dealt = by(plain, blocks).select(*names, "_unit", *STATS, own.alias("_own"), other).select(
        *names, "_unit", *STATS, "_own", F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high"))
    tiles = by(total.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *STATS), blocks).select(
        *names, *STATS, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_low"), "_blocks").select(
        *names, *STATS, "_low", F.explode(F.sequence("_low", F.col("_blocks") - 1)).alias("_high"))
    group = [*names, "_low", "_high"]
    schema = StructType([*_fields(plain, names), *_fields(plain, ["_unit"]), StructField("_sum", ArrayType(DoubleType())),
                         StructField("_seen", ArrayType(IntegerType()))])

    def fit(rows: pd.DataFrame, whole: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(columns=[f.name for f in schema.fields])
        if len(rows) == 0 or len(whole) == 0:
            return out
        rows = rows.sort_values("_unit")
        all_ = moments(whole.iloc[0])
        held = [moments(r) for r in rows.to_dict("records")]
        side = rows["_own"].to_numpy() == rows["_low"].iloc[0]
        alone = rows["_low"].iloc[0] == rows["_high"].iloc[0]
        sums: dict[int, list] = {}
        for i in range(len(held)):
            for j in range(i + 1, len(held)):
                if not alone and side[i] == side[j]:
                    continue
                for outer, got in zip((i, j), score(all_, held[i], held[j])):
                    got = np.asarray(got, float)
                    fine = np.isfinite(got)
                    if outer not in sums:
                        sums[outer] = [np.zeros(len(got)), np.zeros(len(got), int)]
                    sums[outer][0] += np.where(fine, got, 0.0)
                    sums[outer][1] += fine
        head = rows.iloc[sorted(sums)][[*names, "_unit"]].reset_index(drop=True)
        head["_sum"] = [sums[i][0].tolist() for i in sorted(sums)]
        head["_seen"] = [sums[i][1].tolist() for i in sorted(sums)]
        return head if len(head) else out

    parts = dealt.groupBy(*group).cogroup(tiles.groupBy(*group)).applyInPandas(fit, schema)
    cells = parts.select(*names, "_unit", F.posexplode(F.arrays_zip("_sum", "_seen")).alias("_c", "_v"))
    summed = cells.groupBy(*names, "_unit", "_c").agg(F.sum("_v._sum").alias("_s"), F.sum("_v._seen").alias("_n"))
    mean = F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).otherwise(F.lit(float("nan")))
    packed = summed.groupBy(*names, "_unit").agg(F.sort_array(F.collect_list(F.struct("_c", mean.alias("m"), "_n"))).alias("_m"))
    return packed.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.col("_unit").alias(unit),
                         F.transform("_m", lambda x: x["m"]).alias("means"), F.transform("_m", lambda x: x["_n"]).alias("counts"))


def outer_scores(
    stats: DataFrame, total: DataFrame, means: DataFrame, keys: list[str], unit: str,
    score: Callable[[Moments, Moments, np.ndarray | None], list[tuple]], fields: list[StructField],
) -> DataFrame:
    """keys, unit and ``fields``: ``score(total, held, means)`` of every unit; means is None without inner folds."""
    a, t = stats.alias("a"), total.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                                          *[F.col(c).alias(f"_t_{c}") for c in STATS])
    m = means.select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(keys)], F.col(unit).alias("_mu"), "means")
    on_total, on_means = F.lit(True), F.col(f"a.{unit}").eqNullSafe(F.col("_mu"))
    for i, k in enumerate(keys):
        on_total = on_total & F.col(f"a.{k}").eqNullSafe(F.col(f"_k{i}"))
        on_means = on_means & F.col(f"a.{k}").eqNullSafe(F.col(f"_m{i}"))
    joined = a.join(t, on_total).join(m, on_means, "left").select(
        *[F.col(f"a.{c}").alias(c) for c in (*keys, unit, *STATS)], *[f"_t_{c}" for c in STATS], "means")
    schema = StructType([*_fields(stats, [*keys, unit]), *fields])
    names = [f.name for f in schema.fields]

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                found = None if r["means"] is None else np.asarray(r["means"], float)
                for row in score(moments(r, "_t_"), moments(r), found):
                    out.append((*[r[c] for c in (*keys, unit)], *row))
            yield pd.DataFrame(out, columns=names)

    return joined.mapInPandas(run, schema)
