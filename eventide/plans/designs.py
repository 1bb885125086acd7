"""Named regression designs and their reductions.

A design is a wide table (one row per sample) plus a map from term to columns.
Everything after ``gram`` works on p x p statistics, so model ladders, sweeps
and drift ablations reread no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.core.lineage import cut
from eventide.core.series import Series, running
from eventide.operators import basis as bs
from eventide.operators.glm import grouped_ridge_cv


@dataclass(frozen=True)
class Term:
    """One predictor: a window in seconds and a number of basis columns."""

    name: str
    window: tuple[float, float]
    count: int


# Windows and basis sizes of the published models.
FIGURE5 = (Term("lick", (-5.0, 8.0), 12), Term("cue", (0.0, 8.0), 8), Term("ensure", (0.0, 7.0), 8))
BOUTS = tuple(
    Term(n, (-5.0, 8.0), 8) for n in ("bout_onset", "bout_size", "bout_occupancy", "bout_rate")
)
TASTANT = (Term("lick", (-5.0, 8.0), 12), *BOUTS, Term("delivery", (0.0, 10.0), 12))


@dataclass
class Design:
    table: DataFrame
    columns: dict[str, list[str]]
    unpenalised: tuple[str, ...] = ("one",)

    def features(self, terms: Sequence[str] | None = None) -> list[str]:
        names = list(self.columns) if terms is None else list(terms)
        unknown = [n for n in names if n not in self.columns]
        if unknown:
            raise ValueError(f"unknown model terms: {unknown}")
        return [c for n in names for c in self.columns[n]]

    def penalties(self, features: Sequence[str]) -> list[float]:
        return [0.0 if c in self.unpenalised else 1.0 for c in features]


def build(
    spark: SparkSession,
    rows: DataFrame,
    events: dict[str, DataFrame],
    terms: Sequence[Term],
    keys: list[str],
    dt: float,
    *,
    index: str = "i",
) -> Design:
    """Lagged design; convolution restarts at every series (trial) of ``keys``.

    ``rows``: keys, index, response; ``events``: per term keys, index, ``v``.
    """
    lengths = rows.groupBy(*keys).agg((F.max(index) + 1).alias("n"))
    table = rows.withColumn("one", F.lit(1.0))
    columns = {"intercept": ["one"]}
    for t in terms:
        weights = bs.signed_lags(bs.zero_split(spark, t.window, t.count, dt), dt)
        reach = (round(t.window[0] / dt), round(t.window[1] / dt))
        entries = bs.apply_basis(events[t.name], weights, keys, lengths, reach, index=index)
        prefix = f"{t.name}_"
        table = bs.wide_design(entries, table, keys, list(range(t.count)), index=index, prefix=prefix)
        columns[t.name] = [f"{prefix}{c}" for c in range(t.count)]
    return Design(table, columns)


def adaptive(
    spark: SparkSession,
    rows: DataFrame,
    licks: DataFrame,
    deliveries: DataFrame,
    keys: list[str],
    dt: float,
    *,
    lick_seconds: float = 10.0,
    delivery_seconds: float = 45.0,
    pre_seconds: float = 5.0,
    lick_count: int = 8,
    delivery_count: int = 14,
    adaptation: bool = False,
    width: float = 100_000.0,
) -> Design:
    """Quadratic drift, licks and deliveries, on request with adaptation terms."""
    terms = [Term("lick", (-pre_seconds, lick_seconds), lick_count)]
    shape = ((-pre_seconds, delivery_seconds), delivery_count)
    terms.append(Term("ensure", *shape))
    events = {"lick": licks, "ensure": deliveries}
    if adaptation:
        s = Series(tuple(keys), "i", width)
        hits = deliveries.filter("v > 0")
        ranked = running(hits, s, {"_k": "1L"})
        totals = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        ranked = ranked.join(totals, keys)
        progress = F.when(
            (F.col("_k") > 1) & (F.col("_n") > 2), (F.col("_k") - 2) / (F.col("_n") - 2)
        ).otherwise(0.0)
        ranked = cut(ranked.withColumn("_p", progress))
        for name, v in {
            "first_ensure": F.when(F.col("_k") == 1, F.col("v")).otherwise(0.0),
            "ensure_linear": F.col("v") * F.col("_p"),
            "ensure_quadratic": F.col("v") * F.col("_p") * F.col("_p"),
        }.items():
            terms.append(Term(name, *shape))
            events[name] = ranked.withColumn("v", v).select(*keys, "i", "v")
    d = build(spark, rows, events, terms, keys, dt)
    span = rows.groupBy(*keys).agg(F.greatest(F.max("i"), F.lit(1)).alias("_span"))
    z = F.col("i") / F.col("_span")
    table = d.table.join(span, keys).withColumns({"drift1": z, "drift2": z * z}).drop("_span")
    columns = {"drift": ["one", "drift1", "drift2"]}
    columns.update({k: v for k, v in d.columns.items() if k != "intercept"})
    return Design(table, columns)


def paired(design: Design, condition: str, first: str, behaviour: Sequence[str], delivery: str) -> Design:
    """Two conditions with interactions coded -1/2 and +1/2."""
    sign = F.when(F.col(condition) == first, -0.5).otherwise(0.5)
    groups = {
        "behavior": [c for n in behaviour for c in design.columns[n]],
        "delivery": design.columns[delivery],
    }
    made = {"condition_code": sign}
    columns: dict[str, list[str]] = {"intercept": ["one"], "condition": ["condition_code"]}
    for name, cols in groups.items():
        columns[name] = cols
        columns[f"{name}_interaction"] = [f"{c}_x" for c in cols]
        made.update({f"{c}_x": F.col(c) * sign for c in cols})
    return Design(design.table.withColumns(made), columns, ("one", "condition_code"))


def condition_kernels(coefficients: DataFrame, basis: DataFrame, keys: list[str]) -> DataFrame:
    """Kernels of both conditions from base and interaction coefficients.

    ``coefficients``: keys, col, base, interaction.
    """
    x = coefficients.join(F.broadcast(basis), "col")
    b, d, w = F.col("base"), F.col("interaction"), F.col("w")
    return x.groupBy(*keys, "lag_i", "lag_t").agg(
        F.sum(w * (b - 0.5 * d)).alias("first"), F.sum(w * (b + 0.5 * d)).alias("second"),
        F.sum(w * d).alias("difference"),
    )


def progress_kernels(
    coefficients: DataFrame, basis: DataFrame, levels: Sequence[float] = (0.0, 0.5, 1.0)
) -> DataFrame:
    """Delivery kernels at progress levels (coefficients: col, base, linear, quadratic)."""
    level = F.explode(F.array(*[F.lit(float(v)) for v in levels]))
    x = coefficients.join(F.broadcast(basis), "col").withColumn("progress", level)
    p = F.col("progress")
    b = F.col("base") + p * F.col("linear") + p * p * F.col("quadratic")
    return x.groupBy("progress", "lag_i", "lag_t").agg(F.sum(F.col("w") * b).alias("k"))


def restrict(stats: DataFrame, features: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """Statistics of a subset of columns, taken from the full statistics."""
    p, pick = len(features), [list(features).index(c) for c in wanted]

    def take(c: str, cells: list[int]) -> Column:
        return F.array(*[F.col(c)[k] for k in cells]).alias(c)

    rest = [c for c in stats.columns if c not in ("xtx", "xty", "sx")]
    return stats.select(
        *rest, take("xtx", [i * p + j for i in pick for j in pick]), take("xty", pick), take("sx", pick)
    )


def term_ladder(
    stats: DataFrame,
    design: Design,
    ladder: dict[str, Sequence[str]],
    group: str,
    alphas: Sequence[float],
) -> DataFrame:
    """Leave-one-group-out scores of nested models: model, group, alpha, r2.

    Serves term nesting, drift ablation and (with one design per duration)
    kernel-length sweeps; increments are differences between models.
    """
    features = design.features()
    stats = cut(stats)
    out = None
    for model, terms in ladder.items():
        wanted = design.features(terms)
        folds, final = grouped_ridge_cv(
            restrict(stats, features, wanted), group, alphas, penalize=design.penalties(wanted)
        )
        best = folds.join(F.broadcast(final.select("alpha")), "alpha")  # one row
        part = best.select(F.lit(model).alias("model"), group, "alpha", "r2")
        out = part if out is None else out.unionByName(part)
    return out
