"""Forecast models on lag-feature tables.

Ridge models need only sufficient statistics per fold; logistic and Poisson
models take Newton steps whose gradient and Hessian are distributed sums.
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
from pyspark.sql.types import DoubleType, StringType, StructField

from eventide.core.lineage import cut
from eventide.core.series import Series
from eventide.operators import nested
from eventide.operators.basis import lag_columns
from eventide.operators.folds import forward_folds
from eventide.operators.glm import add_up, gram

PREDICTORS = ("photometry", "locomotion", "licking", "cue", "solenoid")
TARGET_COLUMN = {
    "photometry": "photometry", "locomotion": "locomotion",
    "lick_binary": "licking", "lick_count": "licking",
}
MODELS = ("constant", "history_only", "cross_modal", "combined")


def uniform_grid(bounds: DataFrame, keys: list[str], dt: float, *, piece: int = 10_000) -> DataFrame:
    """Grid samples ``i, t`` from ``t0`` on, ``n`` per series.

    A series is first cut in pieces that are spread over the cluster, then each
    piece is filled, so no task ever builds a whole long series.
    """
    pieces = bounds.withColumn(
        "_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / piece)))
    ).repartition(*keys, "_piece")
    last = F.least(F.col("n") - 1, (F.col("_piece") + 1) * piece - 1)
    x = pieces.withColumn("i", F.explode(F.sequence(F.col("_piece") * piece, last)))
    return x.select(*keys, "i", (F.col("t0") + F.col("i") * dt).alias("t"))


def lag_samples(dt: float, history: float, lag_step: float) -> list[int]:
    lags = np.arange(0.0, history + 0.5 * lag_step, lag_step)
    return sorted({int(v) for v in np.rint(lags / dt)})


def feature_table(
    signals: DataFrame,
    s: Series,
    *,
    target: str = "photometry",
    horizon: float = 1.0,
    history: float = 5.0,
    lag_step: float = 0.5,
    target_window: float = 1.0,
    dt: float = 0.1,
    predictors: Sequence[str] = PREDICTORS,
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Past-only features, target ``y`` and the feature names by predictor.

    ``signals``: keys, ``s.t`` (row index), t and the predictor columns.  With
    a zero horizon the target's own present sample is left out.
    """
    if target not in TARGET_COLUMN:
        raise ValueError(f"unknown target: {target}")
    lags = lag_samples(dt, history, lag_step)
    h = int(np.ceil(horizon / dt))
    window = max(1, int(np.ceil(target_window / dt)))
    own = TARGET_COLUMN[target]
    wanted = {p: [k for k in lags if k > 0 or h > 0 or p != own] for p in predictors}
    if target in ("lick_binary", "lick_count"):
        x = lag_columns(signals, s, wanted, sums={"y": (own, h, h + window - 1)})
        if target == "lick_binary":
            x = x.withColumn("y", F.when(F.col("y").isNotNull(), (F.col("y") > 0).cast("double")))
    else:
        x = lag_columns(signals, s, wanted, leads={"y": (own, h)})
    names = {p: [f"{p}_lag{k}" for k in ks] for p, ks in wanted.items()}
    flat = [c for cs in names.values() for c in cs]
    return x.select(*s.keys, s.t, "t", *flat, "y").dropna(subset=[*flat, "y"]), names


def model_columns(names: dict[str, list[str]], target: str) -> dict[str, list[str]]:
    own = TARGET_COLUMN[target]
    history = names[own]
    cross = [c for p, cs in names.items() if p != own for c in cs]
    return {"history_only": history, "cross_modal": cross, "combined": history + cross}


class Moments:
    """Sufficient statistics of one fold, restricted to some columns."""

    def __init__(self, row, cols):
        p = len(row["xty"])
        ix = np.asarray(cols, dtype=int)
        self.G = np.reshape(row["xtx"], (p, p))[np.ix_(ix, ix)]
        self.c, self.s = np.asarray(row["xty"])[ix], np.asarray(row["sx"])[ix]
        self.yy, self.sy, self.n = float(row["yty"]), float(row["sy"]), float(row["n"])

    def path(self, alphas: Sequence[float]) -> list[tuple[np.ndarray, float]]:
        """Standardised ridge with a free intercept, back on raw scale.

        One eigendecomposition serves every penalty.
        """
        m, my = self.s / self.n, self.sy / self.n
        C = self.G - self.n * np.outer(m, m)
        sd = np.sqrt(np.maximum(np.diag(C), 0.0) / self.n)
        sd[~(sd > 1e-12)] = 1.0
        w, V = np.linalg.eigh(C / np.outer(sd, sd))
        rhs = V.T @ ((self.c - self.n * m * my) / sd)
        out = []
        for a in alphas:
            d = np.maximum(w, 0.0) + a
            inverse = np.where(d > 1e-10 * max(d.max(initial=0.0), 1e-300), 1.0 / np.maximum(d, 1e-300), 0.0)
            b = V @ (rhs * inverse) / sd
            out.append((b, my - float(b @ m)))
        return out

    def ridge(self, alpha: float) -> tuple[np.ndarray, float]:
        return self.path([alpha])[0]

    def r2(self, b: np.ndarray, b0: float) -> tuple[float, float]:
        sse = (
            self.yy - 2 * (b @ self.c + b0 * self.sy) + b @ self.G @ b
            + 2 * b0 * float(b @ self.s) + self.n * b0 * b0
        )
        sst = self.yy - self.sy**2 / self.n
        return (1 - sse / sst if sst > 0 else np.nan), sse / self.n


def _paths(g: np.ndarray, cols: list[int], alphas: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """``Moments.path`` of a stack of sums of products (features, response, ones): per sum and penalty."""
    ix = np.asarray(cols, dtype=int)
    G, c, s = g[:, ix[:, None], ix], g[:, ix, -2], g[:, ix, -1]
    n, sy = np.rint(g[:, -1, -1]), g[:, -2, -1]
    m, my = s / n[:, None], sy / n
    C = G - n[:, None, None] * m[:, :, None] * m[:, None, :]
    sd = np.sqrt(np.maximum(np.einsum("kii->ki", C), 0.0) / n[:, None])
    sd[~(sd > 1e-12)] = 1.0
    w, V = np.linalg.eigh(C / (sd[:, :, None] * sd[:, None, :]))
    rhs = np.einsum("kij,ki->kj", V, (c - n[:, None] * m * my[:, None]) / sd)
    d = np.maximum(w, 0.0)[:, None, :] + np.asarray(alphas)[:, None]
    most = np.maximum(d.max(axis=2, initial=0.0, keepdims=True), 1e-300)
    inverse = np.where(d > 1e-10 * most, 1.0 / np.maximum(d, 1e-300), 0.0)
    b = np.einsum("kij,kaj->kai", V, rhs[:, None, :] * inverse) / sd[:, None, :]
    return b, my[:, None] - np.einsum("kai,ki->ka", b, m)


def _r2s(g: np.ndarray, cols: list[int], b: np.ndarray, b0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``Moments.r2`` of a stack: R2 and mean squared error per sum and penalty."""
    ix = np.asarray(cols, dtype=int)
    G, c, s = g[:, ix[:, None], ix], g[:, ix, -2], g[:, ix, -1]
    n, sy, yy = np.rint(g[:, -1, -1]), g[:, -2, -1], g[:, -2, -2]
    sse = (yy[:, None] - 2 * (np.einsum("kai,ki->ka", b, c) + b0 * sy[:, None])
           + np.einsum("kai,kij,kaj->ka", b, G, b, optimize=True)
           + 2 * b0 * np.einsum("kai,ki->ka", b, s) + n[:, None] * b0 * b0)
    sst = (yy - sy ** 2 / n)[:, None]
    return np.where(sst > 0, 1 - sse / np.where(sst > 0, sst, 1.0), np.nan), sse / n[:, None]


#: Rows behind the statistics that a task fits from at a time, on average.
FITTED_ROWS = 30_000


def forward_ridge(
    table: DataFrame,
    keys: list[str],
    columns: dict[str, list[str]],
    *,
    index: str = "i",
    n_folds: int = 5,
    n_inner: int = 3,
    gap: float = 0.0,
    initial_train_fraction: float = 0.5,
    alphas: Sequence[float] = (1e-3, 1e-2, 1e-1, 1.0, 10.0),
) -> DataFrame:
    """Nested expanding-window ridge per session.

    Rows are visited once: rows that the same folds train on and test on are a cell, and leave
    their task as at most as many rows as the statistics have columns.  A session's fits then see
    one sum of products per cell.  Output: keys, fold, model, alpha, r2, mse, n_test.
    """
    features = columns["combined"]
    rows = cut(table)
    cuts = _forward_cuts(rows.select(*keys, index, "t"), keys, index, gap, n_folds, n_inner, initial_train_fraction)
    used = [*features, "y"]
    present = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in used]
    roles = F.transform("_cuts", lambda c: F.concat(c["number"].cast("string"), _role(index, c)))
    cells = rows.where(reduce(and_, present)).join(cuts, keys).select(
        *keys, F.array_join(roles, " ").alias("_cell"), F.array(*[F.col(c).cast("double") for c in used]).alias("_z")
    ).where("_cell <> ''")
    where = {m: [features.index(c) for c in cs] for m, cs in columns.items()}
    grid, width = sorted({float(a) for a in alphas}, reverse=True), len(used) + 1
    kinds = ", ".join(f"`{k}` {table.schema[k].dataType.simpleString()}" for k in keys)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            by = pa.table([*(batch.column(k) for k in range(len(keys) + 1)), pa.array(np.arange(batch.num_rows))],
                          names=[*keys, "_cell", "_at"]).sort_by([(c, "ascending") for c in (*keys, "_cell")])
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for c in (*keys, "_cell"):
                code = by.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            z = batch.column(len(keys) + 1).flatten().to_numpy().reshape(-1, width - 1)
            z = np.column_stack((z, np.ones(len(z))))[by.column("_at").to_numpy()]
            first = np.flatnonzero(new)
            blocks = [z[i:j] if j - i <= width else np.linalg.qr(z[i:j], mode="r") for i, j in zip(first, [*first[1:], len(z)])]
            heads = by.select([*keys, "_cell"]).take(pa.array(first)).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [*(heads.column(k).combine_chunks() for k in range(len(keys) + 1)), pa.array([b.tobytes() for b in blocks], pa.binary())],
                names=[*keys, "_cell", "_rows"])

    def fit(blocks: pa.Table) -> pa.Table:
        series = blocks.select(keys).combine_chunks()
        number = {k: i for i, k in enumerate(dict.fromkeys(zip(*(c.to_pylist() for c in series.columns))))}
        at = [number[k] for k in zip(*(c.to_pylist() for c in series.columns))]
        # By series, fold, inner fold (the fold itself first) and role (train, test).
        g = np.zeros((len(number), n_folds, n_inner + 1, 2, width, width))
        for i, name, data in zip(at, blocks.column("_cell").to_pylist(), blocks.column("_rows").to_pylist()):
            z = np.frombuffer(data).reshape(-1, width)
            own = z.T @ z
            for role in name.split(" "):
                g[(i, *divmod(int(role[:-1]), n_inner + 1), "ab".index(role[-1]))] += own
        n = np.rint(g[..., -1, -1])
        known = (n[:, :, 0] > 0).all(axis=2)
        who, fold = np.nonzero(known)
        tr, te, n_test = g[known, 0, 0], g[known, 0, 1], n[known, 0, 1]
        pairs = (n[known, 1:, 0] >= 2) & (n[known, 1:, 1] > 0)
        tests, trains = g[known, 1:, 1][pairs], g[known, 1:, 0][pairs]
        none = np.zeros((len(who), 1, 0))
        found = [("constant", np.full(len(who), np.nan), *_r2s(te, [], none, (tr[:, -2, -1] / np.rint(tr[:, -1, -1]))[:, None]))]
        for model, cols in where.items():
            scores = np.full((*pairs.shape, len(grid)), np.nan)
            scores[pairs] = _r2s(tests, cols, *_paths(trains, cols, grid))[0]
            # The best mean inner score; of equal ones the larger penalty, which is also that of no scores.
            seen = np.isfinite(scores).any(axis=1)
            count = np.maximum(1, (~np.isnan(scores)).sum(axis=1))
            best = np.argmax(np.where(seen, np.nansum(scores, axis=1) / count, -np.inf), axis=1)
            b, b0 = _paths(tr, cols, grid)
            every = np.arange(len(who))
            found.append((model, np.array(grid)[best], *_r2s(te, cols, b[every, best][:, None], b0[every, best][:, None])))
        first = list(number)
        out = []
        for model, alpha, r2, mse in found:
            heads = [pa.array([first[i][k] for i in who], blocks.schema.field(c).type) for k, c in enumerate(keys)]
            chosen = pa.nulls(len(who), pa.float64()) if model == "constant" else pa.array(alpha)
            out.append(pa.table([*heads, pa.array(fold, pa.int32()), pa.array([model] * len(who), pa.string()), chosen,
                                 pa.array(r2[:, 0], from_pandas=True), pa.array(mse[:, 0], from_pandas=True), pa.array(n_test.astype(np.int64))],
                                names=[*keys, "fold", "model", "alpha", "r2", "mse", "n_test"]))
        return pa.concat_tables(out)

    parts = cells.mapInArrow(partial, f"{kinds}, _cell string, _rows binary")
    groups = -(-rows.count() // FITTED_ROWS) or 1
    return parts.groupBy(F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("_group")).applyInArrow(
        fit, f"{kinds}, fold int, model string, alpha double, r2 double, mse double, n_test long"
    )


def _role(index: str, c: Column) -> Column:
    """What a row is to a fold: a to train on, b to test on, empty for neither."""
    i, t = F.col(index), F.col("t")
    test = (i >= c["test_start"]) & (i < c["test_stop"])
    within = c["outer_start"].isNull() | ((t < c["outer_cutoff"]) & ~((i >= c["outer_start"]) & (i < c["outer_stop"])))
    return F.when(within & test, "b").when(within & (t < c["cutoff"]), "a")


def _forward_cuts(
    at: DataFrame, keys: list[str], index: str, gap: float, n_folds: int, n_inner: int, initial_train_fraction: float
) -> DataFrame:
    """Per session ``_cuts``, the ranges of all outer folds and of their inner folds, with a number each.

    ``at``: keys, index and t.  Inner folds divide the training rows of their outer one.
    """
    borders = ("test_start", "test_stop", "cutoff")
    how = {"initial_train_fraction": initial_train_fraction}
    sizes = at.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    folds = forward_folds(sizes, keys, n_folds=n_folds, **how).withColumn(index, F.col("test_start"))
    outer = cut(at.join(folds.drop("n"), [*keys, index]).select(
        *keys, F.col("fold").alias("outer"), "test_start", "test_stop", (F.col("t") - gap).alias("cutoff")))
    around = outer.select(*keys, "outer", *[F.col(b).alias(f"outer_{b.removeprefix('test_')}") for b in borders])
    i = F.col(index)
    trains = (F.col("t") < F.col("outer_cutoff")) & ~((i >= F.col("outer_start")) & (i < F.col("outer_stop")))
    train = at.join(around, keys).where(trains).groupBy(*keys, "outer").agg(F.count(F.lit(1)).alias("n"))
    inner = forward_folds(train, [*keys, "outer"], n_folds=n_inner, **how).withColumn(index, F.col("test_start"))
    inner = at.join(inner.drop("n"), [*keys, index]).join(around, [*keys, "outer"]).where(trains).select(
        *keys, (F.col("outer") * (n_inner + 1) + F.col("fold") + 1).alias("number"), "test_start", "test_stop",
        (F.col("t") - gap).alias("cutoff"), "outer_start", "outer_stop", "outer_cutoff")
    whole = outer.select(*keys, (F.col("outer") * (n_inner + 1)).alias("number"), *borders)
    cuts = whole.unionByName(inner, allowMissingColumns=True)
    # One entry per fold and inner fold.
    return cuts.groupBy(*keys).agg(F.collect_list(F.struct(
        "number", *borders, "outer_start", "outer_stop", "outer_cutoff")).alias("_cuts"))


def session_ridge(
    table: DataFrame,
    session: str,
    columns: dict[str, list[str]],
    *,
    alphas: Sequence[float] = (1e-3, 1e-2, 1e-1, 1.0, 10.0),
) -> DataFrame:
    """Leave-one-session-out ridge for any number of sessions; inner sessions weigh the same.

    Ties between penalties take the larger one.  Output: session, model, alpha, r2, mse.
    """
    features = columns["combined"]
    stats = cut(gram(table, [session], features, "y"))
    total = cut(add_up(stats, []))
    where = {m: [features.index(c) for c in cs] for m, cs in columns.items()}
    grid = sorted({float(a) for a in alphas}, reverse=True)

    def inner(whole, a, b):
        train = nested.less(nested.less(whole, a), b)
        paths = [(cols, Moments(train, cols).path(grid)) for cols in where.values()]
        return [np.concatenate([[held.r2(*fit)[0] for fit in path] for held, path in ((Moments(h, cols), path) for cols, path in paths)])
                for h in (b, a)]

    def outer(whole, held, means):
        train = nested.less(whole, held)
        out = [("constant", None, *Moments(held, []).r2(np.zeros(0), train["sy"] / train["n"]))]
        for k, (model, cols) in enumerate(where.items()):
            own = None if means is None else means[k * len(grid):(k + 1) * len(grid)]
            best = 0 if own is None or not np.isfinite(own).any() else int(np.nanargmax(own))
            fit = Moments(train, cols).ridge(grid[best])
            out.append((model, grid[best], *Moments(held, cols).r2(*fit)))
        return out

    means = nested.inner_scores(stats, total, [], session, inner)
    fields = [StructField("model", StringType())] + [StructField(c, DoubleType()) for c in ("alpha", "r2", "mse")]
    return nested.outer_scores(stats, total, means, [], session, outer, fields)


def fit_penalised(
    df: DataFrame,
    features: Sequence[str],
    y: str,
    family: str,
    alpha: float,
    *,
    max_iter: int = 50,
    tolerance: float = 1e-8,
) -> dict[str, float] | None:
    """L2 logistic or Poisson regression on standardised columns.

    Minimises the summed loss plus ``alpha / 2 |w|^2`` (logistic) or
    ``n alpha / 2 |w|^2`` (Poisson) with a free intercept; coefficients come
    back on the raw scale under the feature names and ``intercept``.  Each
    Newton step is one pass of partial sums; p * p numbers reach the driver.
    A training set with a single class has no model (None).
    """
    if family not in ("logistic", "poisson"):
        raise ValueError("family must be 'logistic' or 'poisson'")
    features = list(features)
    p = len(features)
    first = df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.min(y).alias("lo"), F.max(y).alias("hi"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)],
    ).first()
    if family == "logistic" and first["lo"] == first["hi"]:
        return None
    m = np.array([first[f"m{i}"] for i in range(p)])
    sd = np.array([first[f"s{i}"] or 0.0 for i in range(p)])
    sd[sd <= 0] = 1.0
    n = first["n"]
    penalty = np.r_[0.0, np.full(p, alpha if family == "logistic" else alpha * n)]
    mean = min(max(float(first["my"]), 1e-6), 1 - 1e-6 if family == "logistic" else np.inf)
    b = np.r_[np.log(mean / (1 - mean)) if family == "logistic" else np.log(mean), np.zeros(p)]
    rows = df.select(*features, F.col(y).alias("_y"))

    def sums(b):
        def partial(batches):
            H, g, loss = np.zeros((p + 1, p + 1)), np.zeros(p + 1), 0.0
            for pdf in batches:
                X = np.column_stack((np.ones(len(pdf)), (pdf[features].to_numpy(float) - m) / sd))
                t = pdf["_y"].to_numpy(float)
                eta = np.clip(X @ b, -500, 500)
                if family == "logistic":
                    mu = 1 / (1 + np.exp(-eta))
                    w = mu * (1 - mu)
                    loss += float(np.sum(np.logaddexp(0.0, eta) - t * eta))
                else:
                    mu = np.exp(np.minimum(eta, 50))
                    w = mu
                    loss += float(np.sum(mu - t * eta))
                H += (X * w[:, None]).T @ X
                g += X.T @ (mu - t)
            yield pd.DataFrame({"h": [H.ravel()], "g": [g], "loss": [loss]})

        got = rows.mapInPandas(partial, "h array<double>, g array<double>, loss double")
        cells = got.select("loss", F.posexplode(F.concat("g", "h")).alias("k", "v"))
        parts = cells.groupBy("k").agg(F.sum("v").alias("v"), F.sum("loss").alias("loss")).collect()
        flat = np.array([r["v"] for r in sorted(parts, key=lambda r: r["k"])])
        loss = parts[0]["loss"] + 0.5 * float(penalty @ (b * b))
        return flat[p + 1:].reshape(p + 1, p + 1), flat[: p + 1], loss

    H, g, loss = sums(b)
    for _ in range(max_iter):
        step = np.linalg.lstsq(H + np.diag(penalty), g + penalty * b, rcond=None)[0]
        if float(np.abs(step).max()) <= tolerance * max(1.0, float(np.abs(b).max())):
            break
        size = 1.0
        while True:
            trial = b - size * step
            Ht, gt, lt = sums(trial)
            if lt <= loss + 1e-12 * abs(loss) or size < 1e-4:
                b, H, g, loss = trial, Ht, gt, lt
                break
            size /= 2
    raw = b[1:] / sd
    out = {c: float(v) for c, v in zip(features, raw)}
    out["intercept"] = float(b[0] - raw @ m)
    return out


def predict(df: DataFrame, coefficients: dict[str, float], family: str, out: str = "prediction") -> DataFrame:
    eta = F.lit(coefficients["intercept"])
    for c, v in coefficients.items():
        if c != "intercept":
            eta = eta + F.col(c) * F.lit(v)
    value = {"logistic": 1 / (1 + F.exp(-eta)), "poisson": F.exp(eta), "gaussian": eta}[family]
    return df.withColumn(out, value)


def summarise(rows: DataFrame, keys: list[str], mouse: list[str], metric: str = "r2") -> DataFrame:
    """Session scores to equal-weight mice, then mean and SEM per key."""
    per_mouse = rows.groupBy(*mouse, *keys).agg(F.avg(metric).alias("_v"))
    return per_mouse.groupBy(*keys).agg(
        F.avg("_v").alias("mean"),
        (F.stddev_samp("_v") / F.sqrt(F.count("_v"))).alias("sem"),
        F.count("_v").alias("n_mice"),
    )
