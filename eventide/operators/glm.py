"""Ridge regression from sufficient statistics.

The rows are read once to form ``X'X``, ``X'y``, ``y'y`` per group (partial
sums, no row leaves its task); folds, penalties and held-out scores are then
algebra on p x p tables.  The size of those tables is set by the number of
design columns and never by the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField

from eventide.core.lineage import cut
from eventide.operators import nested

_SUMS = ("xtx", "xty", "sx")
_SCALARS = ("yty", "sy", "n")


#: Groups whose sums a task holds before it sends them on.
_HELD_GROUPS = 4096
#: Designs of up to this many columns are sums of products in SQL; their plan grows with the square.
_NARROW = 8


def gram(df: DataFrame, keys: list[str], features: Sequence[str], response: str) -> DataFrame:
    """Sufficient statistics per group: arrays ``xtx, xty, sx``; ``yty, sy, n``.

    Rows with a missing feature or response count for nothing.  A task adds up its
    rows before anything is shuffled.
    """
    used = [*features, response]
    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in used])
    if len(features) <= _NARROW:
        present = [F.col(c).isNotNull() & ~F.isnan(c) for c in used]
        return _narrow_gram(rows.where(reduce(and_, present)), keys, list(features), response)
    kinds = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
                      + [f"{c} array<double>" for c in _SUMS] + [f"{c} double" for c in _SCALARS])
    many = len(keys)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def sent(types: list[pa.DataType]) -> pa.RecordBatch:
            m = list(held.values())
            columns = [pa.array([key[i] for key in held], kind) for i, kind in enumerate(types)]
            columns += [pa.array(c, pa.list_(pa.float64())) for c in (
                [g[:-2, :-2].ravel() for g in m], [g[:-2, -2] for g in m], [g[:-2, -1] for g in m])]
            columns += [pa.array([float(g[i]) for g in m], pa.float64()) for i in ((-2, -2), (-2, -1), (-1, -1))]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*keys, *_SUMS, *_SCALARS])

        types = []
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(many)]
            # A missing value is NaN here.
            z = np.column_stack([*(batch.column(many + i).to_numpy(zero_copy_only=False) for i in range(len(used))),
                                 np.ones(batch.num_rows)])
            at = np.flatnonzero(~np.isnan(z).any(axis=1))
            if not len(at):
                continue
            group = np.zeros(batch.num_rows, np.int64)
            for i in range(many):
                code = batch.column(i).dictionary_encode(null_encoding="encode")
                group = np.unique(group * len(code.dictionary) + code.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            at = at[np.argsort(group[at], kind="stable")]
            first = np.flatnonzero(np.r_[True, np.diff(group[at]) != 0])
            z = z[at]
            for i, j in zip(first, [*first[1:], len(at)]):
                key = (batch.column(k)[int(at[i])].as_py() for k in range(many))
                key = tuple(None if k != k else k for k in key)
                held[key] = held.get(key, 0.0) + z[i:j].T @ z[i:j]
            if len(held) >= _HELD_GROUPS:
                yield sent(types)
        if held:
            yield sent(types)

    return add_up(rows.mapInArrow(partial, kinds), keys)


def _narrow_gram(rows: DataFrame, keys: list[str], features: list[str], response: str) -> DataFrame:
    p = len(features)
    columns = [f"_z{i}" for i in range(p)]
    z = rows.select(*keys, *[F.col(c).alias(n) for c, n in zip(features, columns)], F.col(response).alias("_y"))
    sums = {f"_xx{i}_{j}": F.sum(F.col(columns[i]) * F.col(columns[j])) for i in range(p) for j in range(i, p)}
    sums |= {f"_xy{i}": F.sum(F.col(c) * F.col("_y")) for i, c in enumerate(columns)}
    sums |= {f"_x{i}": F.sum(c) for i, c in enumerate(columns)}
    sums |= {"yty": F.sum(F.col("_y") * F.col("_y")), "sy": F.sum("_y"), "n": F.count(F.lit(1)).cast("double")}
    summed = z.groupBy(*keys).agg(*[v.alias(c) for c, v in sums.items()]).where("n > 0")
    return summed.select(
        *keys,
        F.array(*[f"_xx{min(i, j)}_{max(i, j)}" for i in range(p) for j in range(p)]).alias("xtx"),
        F.array(*[f"_xy{i}" for i in range(p)]).alias("xty"), F.array(*[f"_x{i}" for i in range(p)]).alias("sx"),
        "yty", "sy", "n")


def add_up(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Element-wise sum of statistics over rows with equal ``keys``."""
    def entries(c: str) -> Column:
        return F.transform(c, lambda v, i: F.struct(F.lit(c).alias("f"), i.alias("p"), v.alias("v")))

    scalars = F.array(
        *[F.struct(F.lit(c).alias("f"), F.lit(0).alias("p"), F.col(c).alias("v")) for c in _SCALARS]
    )
    cells = stats.select(
        *keys, F.explode(F.concat(*[entries(c) for c in _SUMS], scalars)).alias("e")
    )
    summed = cells.groupBy(*keys, "e.f", "e.p").agg(F.sum("e.v").alias("v"))
    # One group holds p * p + 2 p + 3 cells, a parameter of the design.
    packed = summed.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("f", "p", "v"))).alias("_e")
    )

    def take(c: str) -> Column:
        return F.transform(F.filter("_e", lambda e: e["f"] == c), lambda e: e["v"])

    return packed.select(
        *keys, *[take(c).alias(c) for c in _SUMS], *[take(c)[0].alias(c) for c in _SCALARS]
    )


def _solve(xtx: np.ndarray, xty: np.ndarray, alpha: float, pen: np.ndarray) -> np.ndarray:
    system = xtx + alpha * np.diag(pen)
    try:
        return np.linalg.solve(system, xty)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(system, xty, rcond=None)[0]


def _rms(xtx: np.ndarray, n: float) -> np.ndarray:
    """Root mean square of every column, 1 for empty ones."""
    scale = np.sqrt(np.maximum(np.diag(xtx), 0.0) / n)
    scale[~(scale > 0)] = 1.0
    return scale


def _score(b, xtx, xty, yty, sy, n) -> float:
    """Held-out R2 without the rows."""
    sse = yty - 2 * b @ xty + b @ xtx @ b
    sst = yty - sy * sy / n
    return float(1 - sse / sst) if sst > 0 else np.nan


def ridge(stats: DataFrame, keys: list[str], alpha: float, penalize: Sequence[float] | None = None) -> DataFrame:
    """Coefficients ``b`` per group."""
    pen = None if penalize is None else list(map(float, penalize))

    @F.pandas_udf(ArrayType(DoubleType()))
    def fit(xtx: pd.Series, xty: pd.Series) -> pd.Series:
        out = []
        for g, c in zip(xtx, xty):
            p = len(c)
            w = np.ones(p) if pen is None else np.array(pen)
            out.append(_solve(np.reshape(g, (p, p)), np.array(c), alpha, w))
        return pd.Series(out)

    return stats.select(*keys, fit("xtx", "xty").alias("b"), "n")


def ridge_path(stats: DataFrame, keys: list[str], alphas: Sequence[float]) -> DataFrame:
    """Coefficients per group and penalty, sharing the statistics."""
    grid = F.explode(F.array(*[F.lit(float(a)) for a in alphas]))

    @F.pandas_udf(ArrayType(DoubleType()))
    def fit(xtx: pd.Series, xty: pd.Series, alpha: pd.Series) -> pd.Series:
        return pd.Series(
            [
                _solve(np.reshape(g, (len(c), len(c))), np.array(c), a, np.ones(len(c)))
                for g, c, a in zip(xtx, xty, alpha)
            ]
        )

    x = stats.withColumn("alpha", grid)
    return x.select(*keys, "alpha", fit("xtx", "xty", "alpha").alias("b"))


def grouped_ridge_cv(
    stats: DataFrame,
    group: str,
    alphas: Sequence[float],
    *,
    penalize: Sequence[float] | None = None,
    scale_on: str = "all",
) -> tuple[DataFrame, DataFrame]:
    """Leave-one-group-out choice of the penalty.

    Columns are divided by their root mean square, taken over all rows
    (``scale_on='all'``) or over each training fold (``'train'``).  Returns the
    fold scores (group, alpha, r2) and one row ``alpha, mean_r2, b``.  The
    first best penalty wins.
    """
    stats = cut(stats)
    total = add_up(stats, [])
    pen = None if penalize is None else list(map(float, penalize))
    grid = [float(a) for a in alphas]
    score_type = ArrayType(DoubleType())
    on_train = scale_on == "train"

    @F.pandas_udf(score_type)
    def scores(
        xtx: pd.Series, xty: pd.Series, yty: pd.Series, sy: pd.Series, n: pd.Series,
        txtx: pd.Series, txty: pd.Series, tn: pd.Series,
    ) -> pd.Series:
        out = []
        for g, c, yy, s, k, G, C, N in zip(xtx, xty, yty, sy, n, txtx, txty, tn):
            p = len(c)
            g, G = np.reshape(g, (p, p)), np.reshape(G, (p, p))
            c, C = np.array(c), np.array(C)
            base, rows = (G - g, N - k) if on_train else (G, N)
            scale = _rms(base, rows)
            d = np.outer(scale, scale)
            w = np.ones(p) if pen is None else np.array(pen)
            row = []
            for a in grid:
                b = _solve((G - g) / d, (C - c) / scale, a, w)
                row.append(_score(b, g / d, c / scale, yy, s, k))
            out.append(row)
        return pd.Series(out)

    # ``total`` is one row of p * p numbers.
    joined = stats.join(
        F.broadcast(total.select(
            F.col("xtx").alias("_t"), F.col("xty").alias("_u"), F.col("n").alias("_n")
        ))
    )
    folds = joined.select(
        group, scores("xtx", "xty", "yty", "sy", "n", "_t", "_u", "_n").alias("_r")
    ).select(group, F.posexplode("_r").alias("alpha_i", "r2"))
    choices = F.array(*[F.lit(a) for a in grid])
    folds = cut(
        folds.select(
            group, "alpha_i", F.element_at(choices, F.col("alpha_i") + 1).alias("alpha"),
            F.when(~F.isnan("r2"), F.col("r2")).alias("r2"),
        )
    )
    means = folds.groupBy("alpha_i", "alpha").agg(F.avg("r2").alias("mean_r2"))
    # One row per penalty: ordering them is bounded by the parameter grid.
    best = means.filter(F.col("mean_r2").isNotNull()).orderBy(
        F.col("mean_r2").desc(), "alpha_i"
    ).limit(1)

    @F.pandas_udf(score_type)
    def refit(xtx: pd.Series, xty: pd.Series, n: pd.Series, alpha: pd.Series) -> pd.Series:
        out = []
        for g, c, k, a in zip(xtx, xty, n, alpha):
            p = len(c)
            g = np.reshape(g, (p, p))
            scale = _rms(g, k)
            w = np.ones(p) if pen is None else np.array(pen)
            out.append(_solve(g / np.outer(scale, scale), np.array(c) / scale, a, w) / scale)
        return pd.Series(out)

    final = total.join(F.broadcast(best)).select(
        "alpha", "mean_r2", refit("xtx", "xty", "n", "alpha").alias("b"), "n"
    )
    return folds, final


def nested_ridge_cv(
    stats: DataFrame,
    keys: list[str],
    block: str,
    alphas: Sequence[float],
    *,
    penalize: Sequence[float] | None = None,
    scale_inner: bool = False,
) -> DataFrame:
    """Nested block cross-validation per model (``keys``), for any number of blocks.

    The outer loop holds out a block, the inner one chooses the penalty on the
    remaining blocks; the first best penalty wins.  Columns are scaled over the outer
    training rows, or with ``scale_inner`` anew over the training rows of every inner fold.
    Output: keys, block, alpha, r2 (per fold), pooled_r2.
    """
    pen = None if penalize is None else np.array(penalize, float)
    grid = [float(a) for a in alphas]
    stats = cut(stats)
    total = cut(add_up(stats, keys))

    def path(train: nested.Moments, scale: np.ndarray) -> np.ndarray:
        """Coefficients of all penalties, of columns divided by ``scale``."""
        w = np.ones(len(scale)) if pen is None else pen
        g, c = train["xtx"] / np.outer(scale, scale), train["xty"] / scale
        systems = g + np.array(grid)[:, None, None] * np.diag(w)
        try:
            return np.linalg.solve(systems, np.broadcast_to(c, (len(grid), len(c)))[..., None])[..., 0]
        except np.linalg.LinAlgError:
            return np.stack([_solve(g, c, a, w) for a in grid])

    def held_scores(b: np.ndarray, scale: np.ndarray, held: nested.Moments) -> np.ndarray:
        b = b / scale
        sse = held["yty"] - 2 * b @ held["xty"] + np.einsum("ai,ij,aj->a", b, held["xtx"], b)
        sst = held["yty"] - held["sy"] ** 2 / held["n"]
        return 1 - sse / sst if sst > 0 else np.full(len(b), np.nan)

    def inner(whole, a, b):
        train = nested.less(nested.less(whole, a), b)
        out, both = [], None
        for outer, held in ((a, b), (b, a)):
            if scale_inner:
                scale = _rms(train["xtx"], train["n"])
                both = path(train, scale) if both is None else both
                out.append(held_scores(both, scale, held))
            else:
                rest = nested.less(whole, outer)
                scale = _rms(rest["xtx"], rest["n"])
                out.append(held_scores(path(train, scale), scale, held))
        return out

    def outer(whole, held, means):
        best = 0 if means is None or not np.isfinite(means).any() else int(np.nanargmax(means))
        train = nested.less(whole, held)
        scale = _rms(train["xtx"], train["n"])
        b = path(train, scale)[best] / scale
        sse = held["yty"] - 2 * b @ held["xty"] + b @ held["xtx"] @ b
        r2 = _score(b, held["xtx"], held["xty"], held["yty"], held["sy"], held["n"])
        return [(grid[best], None if np.isnan(r2) else r2, float(sse))]

    means = nested.inner_scores(stats, total, keys, block, inner)
    fields = [StructField(c, DoubleType()) for c in ("alpha", "r2", "_sse")]
    scored = cut(nested.outer_scores(stats, total, means, keys, block, outer, fields))
    names = [f"_k{i}" for i in range(len(keys))]

    def renamed(df: DataFrame, *columns: Column) -> DataFrame:
        return df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *columns)

    def same() -> Column:
        return reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)], F.lit(True))

    sse = renamed(scored.groupBy(*keys).agg(F.sum("_sse").alias("_sse")), F.col("_sse"))
    sst = F.col("yty") - F.col("sy") * F.col("sy") / F.col("n")
    pooled = renamed(total.join(sse, same()).select(*keys, "yty", "sy", "n", "_sse"), F.when(sst > 0, 1 - F.col("_sse") / sst).alias("pooled_r2"))
    return scored.drop("_sse").join(pooled, same()).select(*keys, block, "alpha", "r2", "pooled_r2")


def held_out_sessions(
    stats: DataFrame, group: str, alphas: Sequence[float], *, penalize: Sequence[float] | None = None,
) -> DataFrame:
    """Leave-one-session-out scores with the penalty chosen inside: group, alpha, r2."""
    found = nested_ridge_cv(stats, [], group, alphas, penalize=penalize, scale_inner=True)
    return found.select(group, "alpha", "r2")


@F.pandas_udf(DoubleType())
def held_out_r2(
    b: pd.Series, xtx: pd.Series, xty: pd.Series, yty: pd.Series, sy: pd.Series, n: pd.Series
) -> pd.Series:
    return pd.Series(
        [
            _score(np.array(v), np.reshape(g, (len(c), len(c))), np.array(c), yy, s, k)
            for v, g, c, yy, s, k in zip(b, xtx, xty, yty, sy, n)
        ],
        dtype="float64",
    )


def r2_by_group(df: DataFrame, keys: list[str], y: str, prediction: str) -> DataFrame:
    """mse and R2 = 1 - SSE / SST, NULL when the response is constant."""
    e = F.col(y) - F.col(prediction)
    g = df.groupBy(*keys).agg(
        F.avg(e * e).alias("mse"),
        F.sum(e * e).alias("_sse"),
        (F.var_pop(y) * F.count(y)).alias("_sst"),
        F.count(F.lit(1)).alias("n"),
    )
    return g.select(
        *keys, "mse", F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")).alias("r2"), "n"
    )


def two_stage(
    df: DataFrame, first: Sequence[str], second: Sequence[str], response: str, *,
    first_rows: Column, alpha: float = 0.0,
) -> DataFrame:
    """Fit the first terms on their own rows, freeze them, fit the residual.

    Returns one row ``b_first, b_second``; both are p numbers.
    """
    stage1 = ridge(gram(df.filter(first_rows), [], first, response), [], alpha)
    with_b = df.join(F.broadcast(stage1.select(F.col("b").alias("_b"))))
    fitted = sum(
        (F.col(c) * F.col("_b")[i] for i, c in enumerate(first)), F.lit(0.0)
    )
    rest = with_b.withColumn("_res", F.col(response) - fitted)
    stage2 = ridge(gram(rest, [], second, "_res"), [], alpha)
    return stage1.select(F.col("b").alias("b_first")).join(
        F.broadcast(stage2.select(F.col("b").alias("b_second")))
    )


def fixed_effects(
    sessions: DataFrame, value: str, factors: Sequence[str], *, max_levels: int = 2000
) -> DataFrame:
    """Dummy-coded least squares of session medians on factors.

    Only level sums enter the solver: the rows are reduced to one row per
    factor combination, whose number is bounded by ``max_levels``.
    Output: term, partial_r2, aliased, rank, r2.
    """
    cells = sessions.groupBy(*factors).agg(
        F.count(value).cast("double").alias("n"),
        F.sum(value).alias("s"),
        F.sum(F.col(value) * F.col(value)).alias("ss"),
    )
    if cells.count() > max_levels:
        raise ValueError("too many factor combinations for a dense fixed-effects fit")
    names = list(factors)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = {f: pd.get_dummies(pdf[f].astype(str), drop_first=True).to_numpy(float) for f in names}
        n, s, ss = (pdf[c].to_numpy(float) for c in ("n", "s", "ss"))

        def rss(terms):
            X = np.column_stack([np.ones(len(pdf)), *[blocks[t] for t in terms]])
            G, c = (X * n[:, None]).T @ X, X.T @ s
            b = np.linalg.lstsq(G, c, rcond=None)[0]
            return float(ss.sum() - 2 * b @ c + b @ G @ b), int(np.linalg.matrix_rank(X))

        full, rank = rss(names)
        sst = float(ss.sum() - s.sum() ** 2 / n.sum())
        out = []
        for t in names:
            red, r = rss([u for u in names if u != t])
            out.append([t, (red - full) / red if r < rank and red > 0 else np.nan, r >= rank, rank, 1 - full / sst])
        return pd.DataFrame(out, columns=["term", "partial_r2", "aliased", "rank", "r2"])

    one = cells.groupBy(F.lit(1).alias("_all"))
    return one.applyInPandas(fit, "term string, partial_r2 double, aliased boolean, rank int, r2 double")
