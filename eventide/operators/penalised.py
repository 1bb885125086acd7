"""Penalised regressions of many training sets at once, and their nested cross-validation.

Rows lie in *cells* (a session, or the stretch between two fold borders).  A *problem* is a set
of cells to train on, and carries one fit per design and penalty.  All fits of all problems
advance together: one pass over the rows evaluates loss, gradient and Hessian of every fit at
its trial point, and each problem then takes its damped Newton step.  Gaussian fits end after
one step, logistic and Poisson ones after a few, whatever the number of folds and penalties is.

Rows are packed once into chunks of bounded size, one binary row each, which a pass reads as matrices
and joins with the trial points of bounded blocks of problems; where these are few, no row is moved.
A task adds up its chunks; sums travel as one binary row per task and problem and are added in two steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, StructField, StructType

from eventide.core.lineage import cut
from eventide.core.ranks import distribution
from eventide.operators import scores
from eventide.operators.folds import forward_folds

CHUNK, PROBLEMS, PARTS = 20_000, 32, 16
#: Rows evaluated at a time, and problems whose sums a task holds.
SLICE, HELD = 2048, 256
FAMILY = {"photometry": "gaussian", "locomotion": "gaussian", "lick_binary": "logistic", "lick_count": "poisson"}
PRIMARY = {"gaussian": "r2", "logistic": "average_precision", "poisson": "negative_poisson_deviance"}
CLIP = 1e-7


@dataclass(frozen=True)
class Fits:
    """What every problem fits: one design (positions of features) and penalty each."""

    features: tuple[str, ...]
    family: str
    designs: tuple[tuple[int, ...], ...]

    def mask(self) -> np.ndarray:
        """Which of intercept and features a fit uses."""
        out = np.zeros((len(self.designs), len(self.features) + 1), bool)
        out[:, 0] = True
        for row, cols in zip(out, self.designs):
            row[np.array(cols, int) + 1] = True
        return out


def link(eta: np.ndarray, family: str) -> np.ndarray:
    if family == "logistic":
        return 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
    return np.exp(np.minimum(eta, 50)) if family == "poisson" else eta


def evaluated(x: np.ndarray, y: np.ndarray, b: np.ndarray, family: str, active: np.ndarray) -> np.ndarray:
    """Per fit (row of ``b``) loss, gradient and Hessian over the rows, flattened below each other; zeros where not active."""
    f, p = b.shape
    out = np.zeros((f, 1 + p + p * p))
    on = np.flatnonzero(active)
    i, j = np.triu_indices(p)
    loss, gradient, hessian = np.zeros(len(on)), np.zeros((len(on), p)), np.zeros((len(on), len(i)))
    for at in range(0, len(x), SLICE):
        part, own = x[at:at + SLICE], y[at:at + SLICE, None]
        eta = part @ b[on].T
        if family == "gaussian":
            mu, weight = eta, np.ones_like(eta)
            loss += (0.5 * (own - eta) ** 2).sum(axis=0)
        elif family == "logistic":
            eta = np.clip(eta, -500, 500)
            small = np.exp(-np.abs(eta))
            mu = np.where(eta >= 0, 1.0, small) / (1 + small)
            loss += (np.maximum(eta, 0) + np.log1p(small) - own * eta).sum(axis=0)
            weight = mu * (1 - mu)
        else:
            mu = weight = link(eta, family)
            loss += (mu - own * eta).sum(axis=0)
        gradient += (mu - own).T @ part
        hessian += weight.T @ (part[:, i] * part[:, j])
    whole = np.zeros((len(on), p, p))
    whole[:, i, j] = whole[:, j, i] = hessian
    out[on] = np.column_stack([loss, gradient, whole.reshape(len(on), -1)])
    return out


class Newton:
    """State of one problem's fits, in columns standardised on its own training rows."""

    def __init__(self, fits: Fits, state: dict):
        self.fits = fits
        self.shift = np.asarray(state["shift"], float)  # mean and spread of the training rows
        self.scale = np.asarray(state["scale"], float)
        self.n, self.alphas = float(state["n"]), np.asarray(state["alphas"], float)
        f, p = len(fits.designs), len(fits.features) + 1
        self.b, self.step = (np.array(state[c], float).reshape(f, p) for c in ("b", "step"))
        self.size, self.loss = (np.array(state[c], float) for c in ("size", "loss"))
        self.active = np.array(state["active"], bool)

    def trial(self) -> np.ndarray:
        return self.b - self.size[:, None] * self.step

    def raw(self, b: np.ndarray) -> np.ndarray:
        """Coefficients of rows as they are."""
        out = b.copy()
        out[:, 1:] = b[:, 1:] / self.scale
        out[:, 0] = b[:, 0] - out[:, 1:] @ self.shift
        return out

    def advance(self, sums: np.ndarray, tolerance: float) -> None:
        """Take or shorten the step by what the pass found at the trial points."""
        f, p = self.b.shape
        turn = np.zeros((p, p))  # standardised columns out of raw ones
        turn[0, 0] = 1.0
        turn[0, 1:] = -self.shift / self.scale
        turn[np.arange(1, p), np.arange(1, p)] = 1 / self.scale
        mask = self.fits.mask()
        strength = self.alphas * (self.n if self.fits.family == "poisson" else 1.0)
        at = self.trial()
        for i in np.flatnonzero(self.active):
            pen = np.r_[0.0, np.full(p - 1, strength[i])]
            loss = sums[i, 0] + 0.5 * float(pen @ at[i] ** 2)
            if loss > self.loss[i] + 1e-12 * abs(self.loss[i]) and self.size[i] >= 1e-4:
                self.size[i] /= 2
                continue
            self.b[i], self.loss[i], self.size[i] = at[i], loss, 1.0
            m = mask[i]
            g = (turn.T @ sums[i, 1:p + 1] + pen * self.b[i])[m]
            h = (turn.T @ np.reshape(sums[i, p + 1:], (p, p)) @ turn + np.diag(pen))[np.ix_(m, m)]
            self.step[i] = 0.0
            self.step[i, m] = np.linalg.lstsq(h, g, rcond=None)[0]
            if np.abs(self.step[i]).max() <= tolerance * max(1.0, np.abs(self.b[i]).max()):
                self.active[i] = False


def _names(keys: list[str]) -> list[str]:
    return [f"_k{i}" for i in range(len(keys))]


def _numbers(*names: str) -> list[StructField]:
    return [StructField(c, ArrayType(DoubleType())) for c in names]


_STATE = ("shift", "scale", "alphas", "b", "step", "size", "loss", "at")


def fit(
    rows: DataFrame, keys: list[str], uses: DataFrame, problems: DataFrame, fits: Fits, *,
    max_iter: int = 100, tolerance: float = 1e-8, chunk: int = CHUNK,
) -> DataFrame:
    """Coefficients of every problem: keys, problem, n, fitted (array<boolean>) and coef.

    ``rows``: keys, cell, features, y.  ``uses``: keys, cell, problem.  ``problems``: keys, problem and
    alphas (one per fit).  coef has, per fit, the intercept and one number per feature (0 where the
    design hasn't it), below each other, for rows as they are.  A logistic training set of one class
    has no fit.
    """
    names, p, f = _names(keys), len(fits.features), len(fits.designs)
    x = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "cell",
                    F.array(*[F.col(c).cast("double") for c in fits.features]).alias("x"), F.col("y").cast("double").alias("y"))
    used = uses.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "cell", "problem")
    asked = problems.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "problem", "alphas")

    # Means and spreads of every training set from those of its cells.
    own = x.groupBy(*names, "cell").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("my"), F.min("y").alias("lo"), F.max("y").alias("hi"),
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(p)], *[F.var_pop(F.col("x")[i]).alias(f"v{i}") for i in range(p)])
    own = cut(own)
    weight = F.sum("n")
    sets = used.join(own, [*names, "cell"]).groupBy(*names, "problem").agg(
        weight.alias("n"), (F.sum(F.col("n") * F.col("my")) / weight).alias("my"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.array(*[F.sum(F.col("n") * F.col(f"m{i}")) / weight for i in range(p)]).alias("shift"),
        F.array(*[F.sum(F.col("n") * (F.col(f"v{i}") + F.col(f"m{i}") * F.col(f"m{i}"))) / weight for i in range(p)]).alias("second"),
        F.array(*[F.sum(F.col("n") * F.col(f"v{i}")) / weight for i in range(p)]).alias("within"))
    spread = F.transform(F.arrays_zip("shift", "second", "within"), lambda z: F.sqrt(F.greatest(
        z["second"] - z["shift"] * z["shift"], z["within"])))
    spread = F.transform(spread, lambda s: F.when(s > 1e-12, s).otherwise(1.0))
    mean = {"gaussian": F.col("my"), "poisson": F.ln(F.greatest("my", F.lit(1e-6)))}
    share = F.least(F.greatest("my", F.lit(1e-6)), F.lit(1 - 1e-6))
    mean["logistic"] = F.ln(share / (1 - share))
    start = F.flatten(F.array_repeat(F.concat(F.array(mean[fits.family]), F.array_repeat(F.lit(0.0), p)), f))
    zero = F.lit(0.0)
    good = F.col("lo") < F.col("hi") if fits.family == "logistic" else F.lit(True)
    state = cut(asked.join(sets, [*names, "problem"]).select(
        *names, "problem", F.col("n").cast("double").alias("n"), good.alias("good"), "shift", spread.alias("scale"),
        F.col("alphas").cast("array<double>").alias("alphas"), start.alias("b"), F.array_repeat(zero, f * (p + 1)).alias("step"),
        F.array_repeat(F.lit(1.0), f).alias("size"), F.array_repeat(F.lit(float("inf")), f).alias("loss"), start.alias("at"),
        F.array_repeat(good, f).alias("active")))

    # Chunks of rows, each packed into one row, meet blocks of problems.
    chunks = own.select(*names, "cell", F.greatest(F.lit(1), F.ceil(F.col("n") / chunk)).cast("int").alias("chunks"))
    dealt = x.join(chunks, [*names, "cell"]).select(
        *names, "cell", F.pmod(F.xxhash64("x", "y", F.monotonically_increasing_id()), F.col("chunks")).cast("int").alias("chunk"),
        *[F.col("x")[i].alias(f"x{i}") for i in range(p)], "y")
    place = [dealt.schema[c] for c in (*names, "cell")]

    def pack(some: pa.Table) -> pa.Table:
        matrix = np.column_stack([np.ones(len(some)), *[some.column(f"x{i}").to_numpy() for i in range(p)]])
        first = some.select([c.name for c in place]).slice(0, 1)
        return first.append_column("x", pa.array([matrix.tobytes()])).append_column("y", pa.array([some.column("y").to_numpy().tobytes()]))

    packed = cut(dealt.groupBy(*names, "cell", "chunk").applyInArrow(
        pack, StructType([*place, StructField("x", BinaryType()), StructField("y", BinaryType())])))
    many = used.groupBy(*names, "cell").agg(F.ceil(F.count(F.lit(1)) / PROBLEMS).cast("int").alias("blocks"))
    places = cut(used.join(many, [*names, "cell"]).select(
        *names, "cell", "problem", F.pmod(F.xxhash64("problem"), F.col("blocks")).cast("int").alias("block")))
    fields = [places.schema[c] for c in (*names, "problem")]
    parts = StructType([*fields, StructField("part", IntegerType()), StructField("sums", BinaryType())])
    whole = StructType([*fields, StructField("n", DoubleType()), StructField("good", BooleanType()), *_numbers(*_STATE),
                        StructField("active", ArrayType(BooleanType()))])
    id_ = [*names, "problem"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        part = TaskContext.get().partitionId() % PARTS

        def out(kinds: list[pa.DataType]) -> pa.RecordBatch:
            keys_ = list(zip(*held))
            columns = [pa.array(c, k) for c, k in zip(keys_, kinds)]
            columns += [pa.array([part] * len(held), pa.int32()), pa.array([s.tobytes() for s in held.values()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=[c.name for c in parts.fields])

        for batch in batches:
            kinds = [batch.schema.field(n).type for n in names] + [batch.schema.field("who").type.value_type.field("problem").type]
            for at in range(batch.num_rows):
                (r,) = batch.slice(at, 1).to_pylist()
                matrix, y = np.frombuffer(r["x"]).reshape(-1, p + 1), np.frombuffer(r["y"])
                points = np.array([w["at"] for w in r["who"]], float).reshape(-1, p + 1)
                sums = evaluated(matrix, y, points, fits.family, np.array([w["active"] for w in r["who"]], bool).ravel())
                for w, own_sums in zip(r["who"], sums.reshape(len(r["who"]), -1)):
                    key = (*[r[n] for n in names], w["problem"])
                    held[key] = held[key] + own_sums if key in held else own_sums
                if len(held) >= HELD:
                    yield out(kinds)
                    held.clear()
        if held:
            yield out(kinds)

    def added(some: pd.DataFrame) -> np.ndarray:
        return sum((np.frombuffer(s) for s in some["sums"]), np.zeros(f * (1 + (p + 1) + (p + 1) ** 2)))

    def fold(some: pd.DataFrame) -> pd.DataFrame:
        out = some.iloc[:1].copy()
        out["sums"] = [added(some).tobytes()]
        return out

    def move(some: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        if len(at) == 0 or len(some) == 0:
            return at
        r = at.iloc[0].to_dict()
        newton = Newton(fits, r)
        newton.advance(added(some).reshape(f, -1), tolerance)
        r |= {"b": newton.b.ravel(), "step": newton.step.ravel(), "size": newton.size, "loss": newton.loss, "active": newton.active,
              "at": newton.raw(newton.trial()).ravel()}
        return pd.DataFrame([[r[c.name] if not isinstance(r[c.name], np.ndarray) else r[c.name].tolist() for c in whole.fields]],
                            columns=[c.name for c in whole.fields])

    for _ in range(max_iter):
        open_ = state.where("good and array_contains(active, true)")
        if open_.isEmpty():
            break
        here = places.join(open_, id_).groupBy(*names, "cell", "block").agg(
            F.collect_list(F.struct("problem", "at", "active")).alias("who"))  # about PROBLEMS
        partial = packed.join(here, [*names, "cell"]).select(*names, "x", "y", "who").mapInArrow(look, parts)
        summed = partial.groupBy(*id_, "part").applyInPandas(fold, parts)
        moved = summed.groupBy(*id_).cogroup(open_.groupBy(*id_)).applyInPandas(move, whole)
        state = cut(moved.select(*state.columns).unionByName(state.where("not (good and array_contains(active, true))")))

    def finished(batches):
        for pdf in batches:
            pdf["coef"] = [(n := Newton(fits, r)).raw(n.b).ravel().tolist() for r in pdf.to_dict("records")]
            yield pdf[[*id_, "n", "good", "coef"]]

    done = state.mapInPandas(finished, StructType([*fields, StructField("n", DoubleType()), StructField("good", BooleanType()), *_numbers("coef")]))
    return done.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "problem", F.col("n").cast("bigint").alias("n"),
                       F.col("good").alias("fitted"), "coef")


def predictions(rows: DataFrame, keys: list[str], tests: DataFrame, fitted: DataFrame, fits: Fits) -> DataFrame:
    """keys, the columns of ``tests``, choice (number of the fit), y and prediction of every tested row.

    ``tests``: keys, cell, problem and what else should come along.
    """
    p = len(fits.features) + 1
    at = tests.join(fitted.where("fitted").select(*keys, "problem", "coef"), [*keys, "problem"])
    x = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(fits.features)]
    asked = rows.select(*keys, "cell", *x, F.col("y").cast("double").alias("y")).join(at, [*keys, "cell"])
    if "choice" in tests.columns:
        picked = asked.withColumn("_b", F.slice("coef", F.col("choice") * p + 1, p))
    else:
        picked = asked.select(*asked.columns, F.posexplode(F.transform(
            F.sequence(F.lit(0), F.lit(len(fits.designs) - 1)), lambda k: F.slice("coef", k * p + 1, p))).alias("choice", "_b"))
    eta = F.col("_b")[0]
    for i in range(p - 1):
        eta = eta + F.col(f"_x{i}") * F.col("_b")[i + 1]
    value: Column = {"logistic": 1 / (1 + F.exp(-eta)), "poisson": F.exp(F.least(eta, F.lit(50.0))), "gaussian": eta}[fits.family]
    others = [c for c in tests.columns if c not in (*keys, "cell", "problem", "choice")]
    return picked.select(*keys, "cell", "problem", *others, "choice", "y", value.alias("prediction"))


def scored(df: DataFrame, keys: list[str], family: str) -> DataFrame:
    """Held-out metrics of a target; ``score`` is the one that penalties are chosen by."""
    measure = {"gaussian": scores.continuous, "logistic": scores.binary, "poisson": scores.poisson}[family]
    return measure(df, keys, "y", "prediction").withColumn("score", F.col(PRIMARY[family]))


def _precisions(rows: DataFrame, tests: DataFrame, fitted: DataFrame, fits: Fits) -> DataFrame:
    """outer, cell, choice and score (average precision) of every fit on the cells that ``tests`` names.

    Fits of one feature order rows as the feature does, or the other way round, whatever penalty and
    training set are, so their precisions come from one ranking of a cell by the feature.  Fits of
    several features, and those that the bounds of predictions touch, are ranked by their predictions.
    """
    p = len(fits.features) + 1
    feature = F.array(*[F.lit(d[0] if len(d) == 1 else -1) for d in fits.designs])
    each = tests.join(fitted.where("fitted").select("problem", "coef"), "problem").select(
        "problem", "cell", "outer", "coef", F.explode(F.sequence(F.lit(0), F.lit(len(fits.designs) - 1))).alias("choice"))
    each = each.select("problem", "cell", "outer", "choice", feature[F.col("choice")].alias("feature"),
                       F.col("coef")[F.col("choice") * p].alias("_b0"),
                       F.when(feature[F.col("choice")] >= 0, F.col("coef")[F.col("choice") * p + 1 + feature[F.col("choice")]]).alias("_b1"))
    single = sorted({d[0] for d in fits.designs if len(d) == 1})
    if not single:
        return scored(predictions(rows, [], tests, fitted, fits), ["outer", "cell", "choice"], fits.family)
    long = rows.select("cell", F.col("y").cast("double").alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("feature"), F.col(fits.features[i]).cast("double").alias("_x")) for i in single])).alias("_f")
        ).select("cell", "_y", "_f.feature", "_f._x")
    d = distribution(long, ["cell", "feature"], "_x", weights={"pos": F.col("_y")})
    down = F.sum(F.col("pos") * (F.col("n_pos") - F.col("below_pos")) / (F.col("n") - F.col("below")))
    up = F.sum(F.col("pos") * (F.col("below_pos") + F.col("pos")) / (F.col("below") + F.col("cnt")))
    ranked = d.groupBy("cell", "feature").agg(down.alias("_down"), up.alias("_up"), F.max("n_pos").alias("_n1"), F.max("n").alias("_n"),
                                              F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    farthest = F.greatest(*[F.abs(F.col("_b0") + F.col("_b1") * F.col(c)) for c in ("_lo", "_hi")])
    met = cut(each.join(ranked, ["cell", "feature"], "left").withColumn("_easy", F.coalesce(
        farthest < float(np.log((1 - CLIP) / CLIP)) - 1e-6, F.lit(False))))
    share = F.when(F.col("_b1") > 0, F.col("_down")).when(F.col("_b1") < 0, F.col("_up")).otherwise(
        F.col("_n1") * F.col("_n1") / F.col("_n")) / F.col("_n1")
    easy = met.where("_easy").select("outer", "cell", "choice", F.when(
        (F.col("_n1") > 0) & (F.col("_n1") < F.col("_n")), share).alias("score"))
    rest = met.where("not _easy").select("problem", "cell", "outer", "choice")
    if rest.isEmpty():
        return easy
    return easy.unionByName(scored(predictions(rows, [], rest, fitted, fits), ["outer", "cell", "choice"], fits.family).select(
        "outer", "cell", "choice", "score"))


def _features(columns: dict[str, list[str]]) -> list[str]:
    return list(dict.fromkeys(c for cs in columns.values() for c in cs))


def _grid(columns: dict[str, list[str]], target: str, alphas: Sequence[float]) -> tuple[Fits, list[str], list[float]]:
    grid = sorted({float(a) for a in alphas})
    if not grid or grid[0] < 0:
        raise ValueError("penalties must not be negative")
    features = _features(columns)
    where = {m: tuple(features.index(c) for c in cs) for m, cs in columns.items()}
    return Fits(tuple(features), FAMILY[target], tuple(w for w in where.values() for _ in grid)), list(where), grid


def _chosen(scores_: DataFrame, keys: list[str], models: list[str], grid: list[float]) -> DataFrame:
    """keys, model, choice and alpha: the best score, of equal ones (to twelve digits) the larger penalty."""
    k = F.col("choice")
    named = scores_.where(F.col("score").isNotNull() & ~F.isnan("score")).select(
        *keys, F.floor(k / len(grid)).cast("int").alias("_m"), F.round("score", 12).alias("score"), "choice")
    best = named.groupBy(*keys, "_m").agg(F.max(F.struct("score", "choice")).alias("b"))
    labels, values = F.array(*map(F.lit, models)), F.array(*map(F.lit, grid))
    choice = F.col("b.choice")
    return best.select(*keys, labels[F.col("_m")].alias("model"), choice.alias("choice"), values[choice % len(grid)].alias("alpha"))


@dataclass(frozen=True)
class Forecast:
    """selected: keys, fold, model, alpha.  metrics: keys, model and the target's metrics.  coefficients: keys, model,
    alpha, feature and coefficient (of rows as they are) of the final fit at the median of the selected penalties."""

    selected: DataFrame
    metrics: DataFrame
    final: Callable[[], DataFrame]

    @cached_property
    def coefficients(self) -> DataFrame:
        """The final fit takes passes of its own, so it runs only if asked for."""
        return self.final()


def _final(rows, keys, cells, selected, columns, target, alphas) -> DataFrame:
    """Fits of every model to all ``cells`` (keys, cell, problem) at the median penalty of ``selected`` (per keys)."""
    _, models, _ = _grid(columns, target, alphas)
    features = _features(columns)
    one = Fits(tuple(features), FAMILY[target], tuple(tuple(features.index(c) for c in columns[m]) for m in models))
    middle = selected.groupBy(*keys, "model").agg(F.percentile("alpha", F.lit(0.5)).alias("alpha"))
    wide = middle.groupBy(*keys).pivot("model", models).agg(F.first("alpha")) if keys else middle.groupBy().pivot("model", models).agg(F.first("alpha"))
    alpha = F.array(*[F.coalesce(F.col(f"`{m}`"), F.lit(1.0)) for m in models])
    known = F.array(*[F.col(f"`{m}`").isNotNull() for m in models])
    problems = cells.select(*keys, "problem").distinct()
    problems = problems.join(wide, keys) if keys else problems.join(F.broadcast(wide))  # one row
    problems = cut(problems.select(*keys, "problem", alpha.alias("alphas"), known.alias("known")))
    done = fit(rows, keys, cells, problems.drop("known"), one).where("fitted").join(problems, [*keys, "problem"])
    p = len(features) + 1
    each = done.select(*keys, "problem", "alphas", "known", F.posexplode("coef").alias("_at", "coefficient"))
    term, number = F.array(F.lit("intercept"), *map(F.lit, features)), F.floor(F.col("_at") / p).cast("int")
    uses = F.array(*[F.array(F.lit("intercept"), *map(F.lit, columns[m])) for m in models])
    return each.select(*keys, "problem", F.array(*map(F.lit, models))[number].alias("model"), F.col("alphas")[number].alias("alpha"),
                       term[(F.col("_at") % p).cast("int")].alias("feature"), "coefficient",
                       (F.col("known")[number] & F.array_contains(uses[number], term[(F.col("_at") % p).cast("int")])).alias("_own")
                       ).where("_own").drop("_own")


def _constant(rows: DataFrame, keys: list[str], tests: DataFrame, uses: DataFrame, family: str) -> DataFrame:
    """keys, the columns of ``tests``, y and prediction: the mean of the training rows."""
    sums = rows.groupBy(*keys, "cell").agg(F.sum("y").alias("_s"), F.count(F.lit(1)).alias("_n"))
    mean = uses.join(sums, [*keys, "cell"]).groupBy(*keys, "problem").agg((F.sum("_s") / F.sum("_n")).alias("_m"))
    m = F.col("_m")
    value = {"gaussian": m, "poisson": F.greatest(m, F.lit(CLIP)), "logistic": F.least(F.greatest(m, F.lit(CLIP)), F.lit(1 - CLIP))}[family]
    return rows.select(*keys, "cell", F.col("y").cast("double").alias("y")).join(tests, [*keys, "cell"]).join(
        mean, [*keys, "problem"]).select(*keys, *[c for c in tests.columns if c not in keys], "y", value.alias("prediction"))


def session_models(
    table: DataFrame, session: str, columns: dict[str, list[str]], target: str, *,
    alphas: Sequence[float] = (1e-3, 1e-2, 1e-1, 1.0, 10.0),
) -> Forecast:
    """Nested leave-one-session-out models of any target; inner sessions weigh the same.

    Of two sessions left out together, either may be the outer one, so one training set serves both.
    ``metrics`` are per held-out session; ``coefficients`` per session, fitted to it alone.
    """
    fits, models, grid = _grid(columns, target, alphas)
    rows = cut(table.select(F.col(session).alias("cell"), *fits.features, "y"))
    cells = cut(rows.select("cell").distinct())
    a, b = cells.select(F.col("cell").alias("o")), cells.select(F.col("cell").alias("h"))
    # One problem a pair of sessions and one a session: as many as there are models to fit.
    left_out = cut(a.join(b, F.col("o") <= F.col("h")).select("o", "h", F.xxhash64("o", "h").alias("problem")))
    uses = cut(cells.join(left_out, (F.col("cell") != F.col("o")) & (F.col("cell") != F.col("h"))).select("cell", "problem"))
    alpha = F.array(*[F.lit(v) for _ in models for v in grid])
    fitted = cut(fit(rows, [], uses, left_out.select("problem", alpha.alias("alphas")), fits))
    pairs = left_out.where("o <> h")
    tests = pairs.select("problem", F.col("h").alias("cell"), F.col("o").alias("outer")).unionByName(
        pairs.select("problem", F.col("o").alias("cell"), F.col("h").alias("outer")))
    if fits.family == "logistic":
        inner = _precisions(rows, tests, fitted, fits)
    else:
        inner = scored(predictions(rows, [], tests, fitted, fits), ["outer", "cell", "choice"], fits.family)
    inner = inner.where(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("outer", "choice").agg(F.avg("score").alias("score"))
    chosen = cut(_chosen(inner, ["outer"], models, grid))
    alone = left_out.where("o = h").select("problem", F.col("o").alias("cell"))
    held = alone.join(chosen, F.col("cell") == F.col("outer")).select("problem", "cell", "model", "choice")
    found = predictions(rows, [], held, fitted, fits).select("cell", "model", "y", "prediction")
    base = _constant(rows, [], alone, uses, fits.family).select("cell", F.lit("constant").alias("model"), "y", "prediction")
    metrics = scored(found.unionByName(base), ["cell", "model"], fits.family).drop("score").withColumnRenamed("cell", session)
    selected = chosen.select(F.col("outer").alias(session), "model", "alpha")
    own = cells.select("cell", F.xxhash64("cell").alias("problem"))
    return Forecast(selected, metrics, lambda: _final(rows, [], own, selected, columns, target, alphas).join(own, "problem").select(
        F.col("cell").alias(session), "model", "alpha", "feature", "coefficient"))


def _borders(rows: DataFrame, sizes: DataFrame, keys: list[str], index: str, gap: float, **how) -> DataFrame:
    """Forward folds with the end of their training rows: keys, fold, stop (training positions below it), test_start, test_stop."""
    folds = forward_folds(sizes, keys, **how)
    by = [k for k in keys if k in rows.columns]
    starts = rows.join(folds.select(*keys, "fold", "test_start", "test_stop"), by)
    first = starts.where(F.col(index) == F.col("test_start")).select(*keys, "fold", "test_start", "test_stop", (F.col("t") - gap).alias("_cutoff"))
    return rows.join(first, by).where(F.col("t") < F.col("_cutoff")).groupBy(*keys, "fold", "test_start", "test_stop").agg(
        F.count(F.lit(1)).alias("stop"))


def forward_models(
    table: DataFrame, keys: list[str], columns: dict[str, list[str]], target: str, *, gap: float,
    index: str = "i", n_folds: int = 5, n_inner: int = 3, initial_train_fraction: float = 0.5,
    alphas: Sequence[float] = (1e-3, 1e-2, 1e-1, 1.0, 10.0),
) -> Forecast:
    """Nested expanding-window models of any target, per series (``keys``).

    ``table``: keys, position ``index`` (0, 1, ... by time), t, features, y.  Training rows end ``gap`` before
    the first test row.  A penalty is scored once over the predictions of all inner folds; metrics are taken
    once over those of all outer folds.
    """
    fits, models, grid = _grid(columns, target, alphas)
    rows = cut(table.select(*keys, F.col(index).cast("bigint").alias("_i"), "t", *fits.features, "y"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    how = {"initial_train_fraction": initial_train_fraction}
    outer = cut(_borders(rows, sizes, keys, "_i", gap, n_folds=n_folds, **how).withColumnRenamed("fold", "outer"))
    inner = cut(_borders(rows, outer.select(*keys, "outer", F.col("stop").alias("n")), [*keys, "outer"], "_i", gap, n_folds=n_inner, **how))
    cuts = cut(outer.select(*keys, "outer", F.lit(-1).alias("inner"), "stop", "test_start", "test_stop").unionByName(
        inner.select(*keys, "outer", F.col("fold").alias("inner"), "stop", "test_start", "test_stop")).withColumn(
        "problem", F.xxhash64("outer", "inner")))
    # Rows between two borders are a cell: the number of borders up to the row.
    borders = cuts.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(
        F.array("stop", "test_start", "test_stop"))))).alias("_borders"))
    placed = cut(rows.join(borders, keys).withColumn("cell", F.size(F.filter("_borders", lambda b: b <= F.col("_i")))).drop("_borders"))
    cells = placed.groupBy(*keys, "cell").agg(F.min("_i").alias("_first"))
    met = cells.join(cuts, keys)
    uses = cut(met.where(F.col("_first") < F.col("stop")).select(*keys, "cell", "problem"))
    tests = cut(met.where((F.col("_first") >= F.col("test_start")) & (F.col("_first") < F.col("test_stop"))).select(
        *keys, "cell", "problem", "outer", "inner"))
    alpha = F.array(*[F.lit(v) for _ in models for v in grid])
    fitted = cut(fit(placed, keys, uses, cuts.select(*keys, "problem", alpha.alias("alphas")), fits))
    scores_ = scored(predictions(placed, keys, tests.where("inner >= 0"), fitted, fits), [*keys, "outer", "choice"], fits.family)
    chosen = cut(_chosen(scores_, [*keys, "outer"], models, grid))
    held = tests.where("inner < 0").join(chosen, [*keys, "outer"]).select(*keys, "cell", "problem", "outer", "model", "choice")
    found = predictions(placed, keys, held, fitted, fits).select(*keys, "model", "y", "prediction")
    base = _constant(placed, keys, tests.where("inner < 0"), uses, fits.family).select(
        *keys, F.lit("constant").alias("model"), "y", "prediction")
    metrics = scored(found.unionByName(base), [*keys, "model"], fits.family).drop("score")
    selected = chosen.select(*keys, F.col("outer").alias("fold"), "model", "alpha")
    whole = cells.select(*keys, "cell", F.lit(0).cast("bigint").alias("problem"))
    return Forecast(selected, metrics, lambda: _final(placed, keys, whole, selected, columns, target, alphas).drop("problem"))
