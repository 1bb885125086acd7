"""Nested comparison of candidate models that share one table of cross moments.

The rows are reduced once to statistics over the union of all candidates' columns; every
candidate (a kernel duration, a set of drift terms) is then solved from its own sub-block, so ten
durations cost one scan.  Penalties are chosen inside every held-out unit; one-standard-error
rules pick the simplest candidate that isn't worse than the best.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from eventide.core.lineage import cut
from eventide.operators import basis as bs
from eventide.operators import nested
from eventide.operators.glm import _rms, _score, add_up


def duration_design(
    spark: SparkSession, rows: DataFrame, events: DataFrame, durations: Sequence[float], count: int,
    keys: list[str], dt: float, *, index: str = "i",
) -> tuple[DataFrame, dict[float, list[str]]]:
    """``rows`` with the columns of a raised-cosine kernel of every duration, and their names.

    All durations are one convolution: their bases lie side by side in one weight table.
    """
    weights = None
    for k, d in enumerate(durations):
        one = bs.raised_cosine(spark, (0.0, float(d)), count, dt).withColumn("col", F.col("col") + k * count)
        weights = one if weights is None else weights.unionByName(one)
    lengths = rows.groupBy(*keys).agg((F.max(index) + 1).alias("n"))
    reach = (0, round(max(durations) / dt))
    entries = bs.apply_basis(events, bs.signed_lags(weights, dt), keys, lengths, reach, index=index)
    columns = list(range(count * len(durations)))
    table = bs.wide_design(entries, rows.withColumn("one", F.lit(1.0)), keys, columns, index=index, prefix="kernel_")
    return table, {d: [f"kernel_{k * count + c}" for c in range(count)] for k, d in enumerate(durations)}


def compare(
    stats: DataFrame, features: Sequence[str], candidates: Sequence[Sequence[str]], unit: str,
    alphas: Sequence[float], *, unpenalised: Sequence[str] = ("one",),
) -> DataFrame:
    """unit, candidate (its number), alpha, inner_mean, inner_se and r2 of every candidate and held-out unit.

    ``stats``: ``glm.gram`` of ``features`` per ``unit``.  Columns are scaled over the training rows of
    each fit.  The first best penalty wins; inner_se is the standard error of its inner scores.
    """
    features, grid = list(features), [float(a) for a in alphas]
    blocks = [np.array([features.index(c) for c in cs]) for cs in candidates]
    free = np.array([0.0 if c in unpenalised else 1.0 for c in features])
    stats = cut(stats)
    total = cut(add_up(stats, []))

    def path(train: nested.Moments, ix: np.ndarray) -> np.ndarray:
        g, c = train["xtx"][np.ix_(ix, ix)], train["xty"][ix]
        scale = _rms(g, train["n"])
        systems = g / np.outer(scale, scale) + np.array(grid)[:, None, None] * np.diag(free[ix])
        right = np.broadcast_to(c / scale, (len(grid), len(ix)))[..., None]
        try:
            return np.linalg.solve(systems, right)[..., 0] / scale
        except np.linalg.LinAlgError:
            return np.stack([np.linalg.lstsq(s, c / scale, rcond=None)[0] for s in systems]) / scale

    def scores(b: np.ndarray, held: nested.Moments, ix: np.ndarray) -> list[float]:
        g, c = held["xtx"][np.ix_(ix, ix)], held["xty"][ix]
        return [_score(v, g, c, held["yty"], held["sy"], held["n"]) for v in b]

    def inner(whole, a, b):
        train = nested.less(nested.less(whole, a), b)
        paths = [(path(train, ix), ix) for ix in blocks]
        found = [np.concatenate([scores(p, held, ix) for p, ix in paths]) for held in (b, a)]
        return [np.concatenate([f, f * f]) for f in found]  # squares for the standard error

    def outer(whole, held, means):
        train, out, k = nested.less(whole, held), [], len(grid)
        for i, ix in enumerate(blocks):
            b = path(train, ix)
            own = np.full(k, np.nan) if means is None else means[i * k:(i + 1) * k]
            best = int(np.nanargmax(own)) if np.isfinite(own).any() else 0
            r2 = scores(b[best:best + 1], held, ix)[0]
            out.append((i, i * k + best, grid[best], None if np.isnan(r2) else r2))
        return out

    inside = cut(nested.inner_scores(stats, total, [], unit, inner))
    fields = [StructField("candidate", IntegerType()), StructField("_at", IntegerType())]
    fields += [StructField(c, DoubleType()) for c in ("alpha", "r2")]
    judged = nested.outer_scores(stats, total, inside, [], unit, outer, fields)
    known = inside.select(F.col(unit).alias("_u"), "means", "counts")
    n, m = F.col("counts")[F.col("_at")], F.col("means")[F.col("_at")]
    square = F.col("means")[F.col("_at") + len(blocks) * len(grid)]
    se = F.when(n > 1, F.sqrt(F.greatest((square - m * m) * n / (n - 1), F.lit(0.0)) / n))
    return judged.join(known, judged[unit].eqNullSafe(F.col("_u")), "left").select(
        unit, "candidate", "alpha", F.when(~F.isnan(m), m).alias("inner_mean"), se.alias("inner_se"), "r2")


def summary(scores: DataFrame, unit: str) -> DataFrame:
    """candidate, mean_r2, se_r2, loss, loss_se and recommended: candidates against the best, unit by unit.

    The first candidate (the simplest) whose mean loss against the best is within its standard error is
    the recommended one.  The table has one row per candidate and unit, parameters of the analysis.
    """
    means = scores.groupBy("candidate").agg(
        F.avg("r2").alias("mean_r2"), (F.stddev_samp("r2") / F.sqrt(F.count("r2"))).alias("se_r2"))
    best = means.orderBy(F.col("mean_r2").desc_nulls_last(), "candidate").limit(1).select("candidate")
    top = scores.join(F.broadcast(best), "candidate").select(F.col(unit).alias("_u"), F.col("r2").alias("_top"))
    lost = scores.join(top, scores[unit].eqNullSafe(F.col("_u"))).withColumn("_d", F.col("_top") - F.col("r2"))
    loss = lost.groupBy("candidate").agg(
        F.avg("_d").alias("loss"), (F.stddev_samp("_d") / F.sqrt(F.count("_d"))).alias("loss_se"))
    x = means.join(loss, "candidate").withColumn("_fits", F.col("loss") <= F.col("loss_se"))
    first = F.min(F.when(F.col("_fits"), F.col("candidate"))).over(Window.partitionBy(F.lit(0)))
    return x.withColumn("recommended", F.col("candidate") == first).drop("_fits")


def one_standard_error(scores: DataFrame, unit: str) -> DataFrame:
    """Per unit the first candidate whose inner mean is within a standard error of the best one: the fully nested choice."""
    best = scores.where("inner_mean is not null").groupBy(unit).agg(
        F.max(F.struct("inner_mean", (-F.col("candidate")).alias("_c"), "inner_se")).alias("_b")).select(
        F.col(unit).alias("_u"), (F.col("_b.inner_mean") - F.coalesce("_b.inner_se", F.lit(0.0))).alias("_least"))
    fair = scores.join(best, scores[unit].eqNullSafe(F.col("_u"))).where("inner_mean >= _least")
    picked = fair.groupBy(unit).agg(F.min(F.struct("candidate", "alpha", "r2")).alias("p"))
    return picked.select(unit, "p.candidate", "p.alpha", "p.r2")


#: Drift terms of the ladder, from none to quadratic time.
DRIFT = {"intercept": ["one"], "linear": ["one", "drift1"], "quadratic": ["one", "drift1", "drift2"]}


def drift_ladder(
    stats: DataFrame, features: Sequence[str], kernel: Sequence[str], unit: str, alphas: Sequence[float],
) -> DataFrame:
    """step, unit, alpha, r2 and gain (over the step before) of the intercept, with linear and with quadratic time."""
    steps = list(DRIFT)
    x = compare(stats, features, [[*DRIFT[s], *kernel] for s in steps], unit, alphas, unpenalised=("one",))
    before = F.lag("r2").over(Window.partitionBy(unit).orderBy("candidate"))
    return x.withColumn("gain", F.col("r2") - before).select(
        F.array(*map(F.lit, steps))[F.col("candidate")].alias("step"), unit, "alpha", "r2", "gain")
