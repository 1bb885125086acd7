"""Registered queries: bases, designs, regression, forecasts, lifetimes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from eventide.core.series import Series, index_rows
from eventide.functions import decay
from eventide.operators import basis as bs
from eventide.operators import events as ev
from eventide.operators import folds as fo
from eventide.operators import forecast as fc
from eventide.operators import glm
from eventide.operators import lifetime as lt
from eventide.operators import penalised as pn
from eventide.operators import perievent as pe
from eventide.operators import scores as sc
from eventide.operators import transfer as tr
from eventide.workload import tables as tb
from eventide.workload.event_queries import DT, grid_bounds, r6
from eventide.workload.registry import EV, query

PI = "pi()"
BASIS_SQL = f"""lg AS (SELECT CAST(l AS INTEGER) AS lag_i, l * 21600.0::DOUBLE AS lag_t, CAST(c AS INTEGER) AS col,
        (l * 21600.0 - c * 57600.0::DOUBLE) / 57600.0::DOUBLE AS d
        FROM (SELECT unnest(range(0, 9)) AS l), (SELECT unnest(range(0, 4)) AS c)),
    basis AS (SELECT lag_i, lag_t, col, CASE WHEN abs(d) <= 1 THEN 0.5 * (1 + cos({PI} * d)) ELSE 0.0 END AS w
      FROM lg)"""


def small_basis(spark):
    return bs.raised_cosine(spark, (0.0, 2 * tb.DAY), 4, DT)


COUNTS_SQL = f"""{EV}, b AS (SELECT mouse, min(t) AS t0,
        CAST(floor((max(t) - min(t)) / 21600.0) AS BIGINT) + 1 AS n_bins FROM ev GROUP BY mouse),
    cnt AS (SELECT e.mouse, CAST(floor((e.t - (t0 - 10800.0)) / 21600.0) AS BIGINT) AS i, count(*) AS v
    FROM ev e JOIN b USING (mouse) WHERE kind = 'click' AND e.t <= t0 + (n_bins - 0.5) * 21600.0
    GROUP BY ALL)"""


def click_counts(spark, path):
    s = tb.series(spark, path)
    x = ev.event_counts_on_grid(
        tb.train(spark, path, "click"), s, grid_bounds(spark, path), DT, out="v"
    )
    return x.withColumnRenamed("bin", "i")


def entries(spark, path):
    lengths = grid_bounds(spark, path).select("mouse", F.col("n_bins").alias("n"))
    weights = bs.signed_lags(small_basis(spark), DT)
    return bs.apply_basis(click_counts(spark, path), weights, ["mouse"], lengths, (0, 8))


@query(
    "lag_convolution",
    f"""WITH {COUNTS_SQL}, {BASIS_SQL}
    SELECT c.mouse, c.i + s.lag_i AS i, s.col, round(sum(c.v * s.w), 6) AS x FROM cnt c JOIN b USING (mouse)
    JOIN basis s ON s.w <> 0 WHERE c.i + s.lag_i < b.n_bins GROUP BY ALL""",
)
def lag_convolution(spark, path):
    return entries(spark, path).select("mouse", "i", "col", r6("x"))


@query(
    "raised_cosine",
    f"""WITH {COUNTS_SQL}, {BASIS_SQL}, k AS (SELECT (mouse % 4)::INTEGER AS col, avg(v) AS b FROM cnt GROUP BY 1)
    SELECT lag_i, lag_t, round(sum(w * b), 6) AS k FROM basis JOIN k USING (col) GROUP BY ALL""",
)
def raised_cosine(spark, path):
    coefficients = click_counts(spark, path).groupBy(
        F.pmod("mouse", F.lit(4)).cast("int").alias("col")
    ).agg(F.avg("v").alias("b"))
    x = bs.reconstruct_kernel(small_basis(spark), coefficients, [])
    return x.select("lag_i", "lag_t", r6("k"))


@query(
    "zero_split_basis",
    f"""WITH {COUNTS_SQL}, lg AS (SELECT CAST(l AS INTEGER) AS lag_i, -86400.0::DOUBLE + l * 21600.0::DOUBLE AS lag_t,
        CAST(c AS INTEGER) AS col FROM (SELECT unnest(range(0, 13)) AS l), (SELECT unnest(range(0, 6)) AS c)),
    d AS (SELECT *, CASE WHEN col < 2 THEN (lag_t - (-86400.0 + col * 86400.0)) / 86400.0
        ELSE (ln(1 + greatest(lag_t, 0)) - (col - 1) * (ln(172801.0) / 4)) / (ln(172801.0) / 4) END AS d FROM lg),
    basis AS (SELECT lag_i, lag_t, col, CASE WHEN (col < 2 AND lag_t < 0 OR col >= 2 AND lag_t > 0) AND abs(d) <= 1
        THEN 0.5 * (1 + cos({PI} * d)) ELSE 0.0 END AS w FROM d),
    k AS (SELECT (mouse % 6)::INTEGER AS col, avg(v) AS b FROM cnt GROUP BY 1)
    SELECT lag_i, lag_t, round(sum(w * b), 6) AS k FROM basis JOIN k USING (col) GROUP BY ALL""",
)
def zero_split_basis(spark, path):
    basis = bs.zero_split(spark, (-tb.DAY, 2 * tb.DAY), 6, DT)
    coefficients = click_counts(spark, path).groupBy(
        F.pmod("mouse", F.lit(6)).cast("int").alias("col")
    ).agg(F.avg("v").alias("b"))
    x = bs.reconstruct_kernel(basis, coefficients, [])
    return x.select("lag_i", "lag_t", r6("k"))


@query(
    "kernel_prediction",
    f"""WITH {COUNTS_SQL}, kr AS (SELECT unnest(range(0, 5)) AS lag_i),
    p AS (SELECT c.mouse, c.i + lag_i AS i, sum(v * exp(-lag_i / 2.0::DOUBLE)) AS p FROM cnt c, kr GROUP BY ALL),
    g AS (SELECT mouse, unnest(range(0, n_bins)) AS i FROM b)
    SELECT g.mouse, g.i, round(coalesce(p, 0) + 0.25, 6) AS prediction FROM g LEFT JOIN p USING (mouse, i)""",
)
def kernel_prediction(spark, path):
    bounds = grid_bounds(spark, path).withColumnRenamed("n_bins", "n")
    rows = fc.uniform_grid(bounds, ["mouse"], DT).select("mouse", "i")
    kernel = spark.range(5).select(
        F.col("id").cast("int").alias("lag_i"), F.exp(-F.col("id") / 2.0).alias("k")
    )
    x = bs.predict_from_kernel(
        click_counts(spark, path), kernel, ["mouse"], rows, (0, 4), intercept=0.25
    )
    return x.select("mouse", "i", r6("prediction"))


# ---------------------------------------------------------------- ridge

FEATURES = ["one", "l_quantity", "l_discount", "l_tax"]


def price_rows(spark, path, *more):
    return tb.read(spark, path, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.pmod("l_suppkey", F.lit(5)).cast("int").alias("block"),
        F.lit(1.0).alias("one"), "l_quantity", "l_discount", "l_tax",
        (F.col("l_extendedprice") / 1000.0).alias("y"), *more,
    )


@query(
    "ridge_xtx",
    "SELECT flag, p, round(v, 3) AS v FROM (SELECT l_returnflag AS flag, unnest(range(0, 16)) AS p, unnest(["
    + ", ".join(f"sum({a} * {b})" for a in ("1.0::DOUBLE", "l_quantity", "l_discount", "l_tax")
                for b in ("1.0::DOUBLE", "l_quantity", "l_discount", "l_tax"))
    + "]) AS v FROM lineitem GROUP BY 1)",
)
def ridge_xtx(spark, path):
    g = glm.gram(price_rows(spark, path), ["flag"], FEATURES, "y")
    x = g.select("flag", F.posexplode("xtx").alias("p", "v"))
    return x.select("flag", F.col("p").cast("bigint").alias("p"), F.round("v", 3).alias("v"))


_WIDE = [f"x{i}" for i in range(24)]


def _gappy(df):
    """24 columns; every eleventh row lacks one of them, every thirteenth the response."""
    k = F.col("l_orderkey") + F.col("l_linenumber")
    wide = [
        F.when((k % 11 == 0) & F.lit(i == 5), None).otherwise((F.pmod(k * (i + 1), F.lit(17)) / 16.0)).alias(c)
        for i, c in enumerate(_WIDE)
    ]
    return df.select(
        F.col("l_returnflag").alias("flag"), *wide,
        F.when(k % 13 != 0, F.col("l_quantity").cast("double")).alias("y"),
    )


@query(
    "gram_missing",
    f"""WITH r AS (SELECT l_returnflag AS flag, l_orderkey + l_linenumber AS k, l_quantity::DOUBLE AS y FROM lineitem),
    x AS (SELECT flag, y, [{", ".join(f"((k * {i + 1}) % 17) / 16.0::DOUBLE" for i in range(24))}] AS x
          FROM r WHERE k % 11 <> 0 AND k % 13 <> 0)
    SELECT flag, count(*)::DOUBLE AS n, round(sum(y), 3) AS sy, round(sum(y * y), 3) AS yty,
      round(sum(x[6] * x[24]), 3) AS x5x23, round(sum(x[6] * y), 3) AS x5y, round(sum(x[2]), 3) AS s1
    FROM x GROUP BY flag""",
)
def gram_missing(spark, path):
    g = glm.gram(_gappy(tb.read(spark, path, "lineitem")), ["flag"], _WIDE, "y")
    return g.select(
        "flag", "n", F.round("sy", 3).alias("sy"), F.round("yty", 3).alias("yty"),
        F.round(F.col("xtx")[5 * 24 + 23], 3).alias("x5x23"), F.round(F.col("xty")[5], 3).alias("x5y"),
        F.round(F.col("sx")[1], 3).alias("s1"),
    )


@query(
    "ridge_path",
    """SELECT l_returnflag AS flag, alpha, round(sum(l_quantity * l_extendedprice / 1000.0)
      / (sum(l_quantity * l_quantity) + alpha), 6) AS b
    FROM lineitem, (SELECT unnest([0.0::DOUBLE, 1000.0, 1000000.0]) AS alpha) GROUP BY 1, 2, alpha""",
)
def ridge_path(spark, path):
    g = glm.gram(price_rows(spark, path), ["flag"], ["l_quantity"], "y")
    x = glm.ridge_path(g, ["flag"], [0.0, 1000.0, 1e6])
    return x.select("flag", "alpha", F.round(F.col("b")[0], 6).alias("b"))


@query(
    "grouped_ridge_cv",
    """WITH g AS (SELECT CAST(l_suppkey % 5 AS INTEGER) AS block, sum(l_quantity * l_quantity) AS xx,
      sum(l_quantity * l_extendedprice / 1000) AS xy, sum(pow(l_extendedprice / 1000, 2)) AS yy,
      sum(l_extendedprice / 1000) AS sy, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1),
    t AS (SELECT sum(xx) AS txx, sum(xy) AS txy, sum(n) AS tn FROM g),
    b AS (SELECT g.*, alpha, (txy - xy) / (txx - xx + alpha * txx / tn) AS b
      FROM g, t, (SELECT unnest([0.1::DOUBLE, 10.0, 1000.0]) AS alpha))
    SELECT block, alpha, round(1 - (yy - 2 * b * xy + b * b * xx) / (yy - sy * sy / n), 6) AS r2 FROM b""",
)
def grouped_ridge_cv(spark, path):
    g = glm.gram(price_rows(spark, path), ["block"], ["l_quantity"], "y")
    folds, _ = glm.grouped_ridge_cv(g, "block", [0.1, 10.0, 1000.0])
    return folds.select("block", "alpha", r6("r2"))


@query("ridge_refit")
def ridge_refit(spark, path):
    g = glm.gram(price_rows(spark, path), ["block"], FEATURES, "y")
    _, final = glm.grouped_ridge_cv(g, "block", [0.01, 1.0, 100.0], penalize=[0, 1, 1, 1])
    return final.select("alpha", r6("mean_r2"), F.posexplode("b").alias("term", "b")).withColumn("b", r6("b"))


@query("nested_ridge_cv")
def nested_ridge_cv(spark, path):
    g = glm.gram(price_rows(spark, path), ["flag", "block"], FEATURES, "y")
    x = glm.nested_ridge_cv(g, ["flag"], "block", list(np.logspace(-3, 5, 9)), penalize=[0, 1, 1, 1])
    return x.select("flag", "block", "alpha", r6("r2"), r6("pooled_r2"))


@query("held_out_sessions")
def held_out_sessions(spark, path):
    g = glm.gram(price_rows(spark, path), ["flag"], FEATURES, "y")
    x = glm.held_out_sessions(g, "flag", list(np.logspace(-4, 4, 5)), penalize=[0, 1, 1, 1])
    return x.select("flag", "alpha", r6("r2"))


LINE_ALPHAS = tuple(10.0 ** k for k in range(-2, 6))


def _line(a: str) -> str:
    """Intercept (not penalised) and slope of a ridge line on statistics, the column divided by its root mean square."""
    s, r = "sqrt(sxx / n)", "alpha"
    det = f"(n * (n + {r}) - pow(sx / {s}, 2))"
    return (f"((n + {r}) * sy - sx / {s} * (sxy / {s})) / {det} AS {a}0, "
            f"(n * (sxy / {s}) - sx / {s} * sy) / {det} / {s} AS {a}1")


_LINE_R2 = "1 - (syy - 2 * (b0 * sy + b1 * sxy) + b0 * b0 * n + 2 * b0 * b1 * sx + b1 * b1 * sxx) / (syy - sy * sy / n)"
_LINE_SUMS = ("n", "sx", "sxx", "sy", "sxy", "syy")


def _less(*units: str) -> str:
    return ", ".join(f"t.{c} - {' - '.join(f'{u}.{c}' for u in units)} AS {c}" for c in _LINE_SUMS)


@query(
    "nested_line_cv",
    f"""WITH s AS (SELECT l_suppkey AS session, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy,
        sum(y * y) AS syy FROM (SELECT l_suppkey % 200 AS l_suppkey, l_quantity::DOUBLE AS x, l_extendedprice / 1000 AS y FROM lineitem) GROUP BY 1),
    t AS (SELECT {', '.join(f'sum({c}) AS {c}' for c in _LINE_SUMS)} FROM s),
    g AS (SELECT unnest([{', '.join(f'{a}::DOUBLE' for a in LINE_ALPHAS)}]) AS alpha),
    p AS (SELECT o.session AS o, h.session AS h, {_less('o', 'h')} FROM s o JOIN s h ON o.session <> h.session, t),
    f AS (SELECT o, h, alpha, {_line('b')} FROM p, g),
    i AS (SELECT o, alpha, avg({_LINE_R2}) AS score FROM f JOIN s ON s.session = f.h GROUP BY ALL),
    a AS (SELECT o, arg_max(alpha, (score, -alpha)) AS alpha FROM i GROUP BY o),
    w AS (SELECT session, alpha, {_line('b')} FROM (SELECT o.session, alpha, {_less('o')} FROM s o JOIN a ON a.o = o.session, t))
    SELECT CAST(session AS BIGINT) AS session, alpha, round({_LINE_R2}, 6) AS r2 FROM w JOIN s USING (session)""",
)
def nested_line_cv(spark, path):
    """Leave-one-session-out over every supplier group: one tiled job whatever their number is."""
    rows = price_rows(spark, path, F.pmod("l_suppkey", F.lit(200)).cast("bigint").alias("session"))
    g = glm.gram(rows, ["session"], ["one", "l_quantity"], "y")
    return glm.held_out_sessions(g, "session", LINE_ALPHAS, penalize=[0, 1]).select("session", "alpha", r6("r2"))


@query(
    "r2_by_group",
    """WITH p AS (SELECT l_returnflag AS flag, l_extendedprice / 1000 AS y, 1.5 * l_quantity AS p FROM lineitem)
    SELECT flag, round(avg(pow(y - p, 2)), 6) AS mse,
      round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 6) AS r2, count(*) AS n FROM p GROUP BY flag""",
)
def r2_by_group(spark, path):
    x = price_rows(spark, path).withColumn("p", 1.5 * F.col("l_quantity"))
    return glm.r2_by_group(x, ["flag"], "y", "p").select("flag", r6("mse"), r6("r2"), "n")


@query("two_stage_fit")
def two_stage_fit(spark, path):
    x = glm.two_stage(
        price_rows(spark, path), ["one", "l_quantity"], ["l_discount", "l_tax"], "y",
        first_rows=F.col("l_discount") <= 0.05,
    )
    return x.select(
        F.posexplode(F.concat("b_first", "b_second")).alias("term", "b")
    ).withColumn("b", r6("b"))


@query("fixed_effects")
def fixed_effects(spark, path):
    rows = tb.read(spark, path, "lineitem").select(
        "l_returnflag", "l_linestatus", F.pmod("l_suppkey", F.lit(7)).alias("mouse"), "l_extendedprice"
    )
    x = glm.fixed_effects(rows, "l_extendedprice", ["mouse", "l_returnflag", "l_linestatus"])
    return x.select("term", r6("partial_r2"), "aliased", "rank", r6("r2"))


@query(
    "blocked_folds",
    f"""WITH {EV}, s AS (SELECT mouse, count(*) AS n FROM ev GROUP BY mouse),
    f AS (SELECT mouse, n, f::INTEGER AS fold, f * (n // 4) + least(f, n % 4) AS a,
      f * (n // 4) + least(f, n % 4) + n // 4 + CASE WHEN f < n % 4 THEN 1 ELSE 0 END AS z
      FROM s, (SELECT unnest(range(0, 4)) AS f))
    SELECT mouse, fold, CAST(a AS BIGINT) AS test_start, CAST(z AS BIGINT) AS test_stop,
      CAST(greatest(0, a - 2) AS BIGINT) AS train_before, CAST(least(n, z + 2) AS BIGINT) AS train_after, n FROM f""",
)
def blocked_folds(spark, path):
    sizes = tb.samples(spark, path).groupBy("mouse").agg(F.count(F.lit(1)).alias("n"))
    x = fo.blocked_folds(sizes, ["mouse"], 4, gap=2)
    return x.withColumns({c: F.col(c).cast("bigint") for c in ("train_before", "train_after")})


@query(
    "forward_folds",
    f"""WITH {EV}, x AS (SELECT mouse, t, row_number() OVER (PARTITION BY mouse ORDER BY t) - 1 AS i,
        count(*) OVER (PARTITION BY mouse) AS n FROM ev),
    s AS (SELECT DISTINCT mouse, n, CAST(ceil(n * 0.5) AS BIGINT) AS f0 FROM x),
    f AS (SELECT mouse, f::INTEGER AS fold, f0 + f * ((n - f0) // 3) + least(f, (n - f0) % 3) AS a,
      f0 + f * ((n - f0) // 3) + least(f, (n - f0) % 3) + (n - f0) // 3
        + CASE WHEN f < (n - f0) % 3 THEN 1 ELSE 0 END AS z FROM s, (SELECT unnest(range(0, 3)) AS f)),
    c AS (SELECT f.*, x.t - 86400.0 AS cutoff FROM f JOIN x ON x.mouse = f.mouse AND x.i = f.a)
    SELECT c.mouse, c.fold, count(*) FILTER (x.t < cutoff AND NOT (x.i >= a AND x.i < z)) AS n_train,
      count(*) FILTER (x.i >= a AND x.i < z) AS n_test FROM c JOIN x ON x.mouse = c.mouse GROUP BY ALL""",
)
def forward_folds(spark, path):
    rows = index_rows(tb.samples(spark, path), tb.series(spark, path))
    sizes = tb.samples(spark, path).groupBy("mouse").agg(F.count(F.lit(1)).alias("n"))
    x = fo.assign_forward(rows, fo.forward_folds(sizes, ["mouse"], n_folds=3), ["mouse"], gap=tb.DAY)
    return x.groupBy("mouse", "fold").agg(
        F.sum((F.col("role") == "train").cast("bigint")).alias("n_train"),
        F.sum((F.col("role") == "test").cast("bigint")).alias("n_test"),
    )


# ---------------------------------------------------------------- forecasting


def forecast_signals(spark, path):
    """Value on a 6 h grid plus event counts of the same grid."""
    s = tb.series(spark, path)
    bounds = grid_bounds(spark, path)
    grid = fc.uniform_grid(bounds.withColumnRenamed("n_bins", "n"), ["mouse"], DT)
    x = pe.interpolate(grid, tb.samples(spark, path), s, out="photometry", clamp=True)
    kinds = {"licking": "click", "cue": "view", "solenoid": "purchase"}
    e = tb.raw_events(spark, path).filter(F.col("kind").isin(*kinds.values())).join(bounds, "mouse")
    inside = e.filter(F.col("t") <= F.col("t0") + (F.col("n_bins") - 0.5) * DT)
    counts = inside.groupBy("mouse", ev.grid_bin(F.col("t"), F.col("t0"), DT).alias("i")).agg(
        *[F.sum((F.col("kind") == k).cast("double")).alias(c) for c, k in kinds.items()]
    )
    # The grid is exploded from few rows, so that adaptive execution takes it for small: never broadcast it.
    x = x.join(counts.hint("merge"), ["mouse", "i"], "left").fillna(0.0, list(kinds))
    return x.withColumns({"cue": (F.col("cue") > 0).cast("double"), "solenoid": (F.col("solenoid") > 0).cast("double")})


SIGNALS_SQL = f"""{EV}, b AS (SELECT mouse, min(t) AS t0,
        CAST(floor((max(t) - min(t)) / 21600.0) AS BIGINT) + 1 AS n_bins FROM ev GROUP BY mouse),
    g AS (SELECT mouse, i, t0 + i * 21600.0 AS t FROM (SELECT mouse, t0, unnest(range(0, n_bins)) AS i FROM b)),
    smp AS (SELECT mouse, t, v, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM ev
            WINDOW w AS (PARTITION BY mouse ORDER BY t)),
    p AS (SELECT g.mouse, g.i, g.t, CASE WHEN s.t1 IS NULL THEN s.v
            ELSE s.v + (g.t - s.t) * ((s.v1 - s.v) / (s.t1 - s.t)) END AS photometry
          FROM g ASOF JOIN smp s ON g.mouse = s.mouse AND g.t >= s.t),
    c AS (SELECT e.mouse, CAST(floor((e.t - (t0 - 10800.0)) / 21600.0) AS BIGINT) AS i,
        count(*) FILTER (kind = 'click') AS licking, count(*) FILTER (kind = 'view') AS cue,
        count(*) FILTER (kind = 'purchase') AS solenoid FROM ev e JOIN b USING (mouse)
        WHERE e.t <= t0 + (n_bins - 0.5) * 21600.0 GROUP BY ALL),
    sig AS (SELECT p.mouse, p.i, p.t, photometry, coalesce(licking, 0)::DOUBLE AS licking,
        CASE WHEN cue > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cue,
        CASE WHEN solenoid > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS solenoid
        FROM p LEFT JOIN c USING (mouse, i))"""


@query(
    "forecast_signals",
    f"""WITH {SIGNALS_SQL} SELECT mouse, i, round(photometry, 6) AS photometry, licking, cue, solenoid FROM sig""",
)
def forecast_signals_query(spark, path):
    x = forecast_signals(spark, path)
    return x.select("mouse", "i", r6("photometry"), "licking", "cue", "solenoid")


PREDICTORS = ("photometry", "licking", "cue", "solenoid")
INDEX = Series(("mouse",), "i", 4096.0)


@query(
    "lag_features",
    f"""WITH {SIGNALS_SQL}, f AS (SELECT mouse, i, photometry AS photometry_lag0, lag(photometry, 2) OVER w AS photometry_lag2,
        lag(photometry, 4) OVER w AS photometry_lag4, licking AS licking_lag0, lag(licking, 2) OVER w AS licking_lag2,
        lag(licking, 4) OVER w AS licking_lag4, CASE WHEN lead(licking, 3) OVER w IS NOT NULL THEN
          lead(licking, 2) OVER w + lead(licking, 3) OVER w END AS y
        FROM sig WINDOW w AS (PARTITION BY mouse ORDER BY i))
    SELECT mouse, i, round(photometry_lag0, 6) AS photometry_lag0, round(photometry_lag2, 6) AS photometry_lag2,
      round(photometry_lag4, 6) AS photometry_lag4, licking_lag0, licking_lag2, licking_lag4, y
    FROM f WHERE y IS NOT NULL AND photometry_lag4 IS NOT NULL""",
)
def lag_features(spark, path):
    x, _ = fc.feature_table(
        forecast_signals(spark, path), INDEX, target="lick_count", horizon=2 * DT, history=4 * DT,
        lag_step=2 * DT, target_window=2 * DT, dt=DT, predictors=("photometry", "licking"),
    )
    return x.select(
        "mouse", "i", *[r6(f"photometry_lag{k}") for k in (0, 2, 4)],
        *[f"licking_lag{k}" for k in (0, 2, 4)], "y",
    )


@query("forecast_forward")
def forecast_forward(spark, path):
    x, names = fc.feature_table(
        forecast_signals(spark, path), INDEX, horizon=DT, history=3 * DT, lag_step=DT, dt=DT,
        predictors=PREDICTORS,
    )
    x = x.withColumn("i", F.col("i") - 3)
    out = fc.forward_ridge(
        x, ["mouse"], fc.model_columns(names, "photometry"), n_folds=3, n_inner=2, gap=4 * DT
    )
    return out.select("mouse", "fold", "model", "alpha", r6("r2"), r6("mse"), "n_test")


@query("forecast_sessions")
def forecast_sessions(spark, path):
    x, names = fc.feature_table(
        forecast_signals(spark, path), INDEX, horizon=DT, history=3 * DT, lag_step=DT, dt=DT,
        predictors=PREDICTORS,
    )
    x = x.withColumn("session", F.pmod("mouse", F.lit(4)).cast("int"))
    out = fc.session_ridge(x, "session", fc.model_columns(names, "photometry"))
    return out.select("session", "model", "alpha", r6("r2"), r6("mse"))


LICK_MODELS = {"history_only": ["licking_lag0"], "cross_modal": ["photometry_lag0"]}
LICK_ALPHAS = (0.001, 0.1, 10.0)
NEWTON_STEPS = 12


def lick_models(spark, path, target):
    """Nested leave-one-session-out models of the next bin's licks from licks or signal of this one."""
    x, _ = fc.feature_table(
        forecast_signals(spark, path), INDEX, target=target, horizon=DT, history=0.0, lag_step=DT,
        target_window=DT, dt=DT, predictors=("licking", "photometry"),
    )
    x = x.withColumn("session", F.pmod("mouse", F.lit(4)).cast("int"))
    return pn.session_models(x, "session", LICK_MODELS, target, alphas=LICK_ALPHAS)


def _lick_sql(target, penalty, mean, mu, weight, y, score, metrics):
    """Newton steps of every training set, model and penalty; the best inner score; metrics of the outer session."""
    alphas = ", ".join(f"{a}::DOUBLE" for a in LICK_ALPHAS)
    return f"""WITH RECURSIVE {SIGNALS_SQL}, x AS (
      SELECT session, unnest(['history_only', 'cross_modal']) AS model, unnest([licking, photometry]) AS x, {y} AS y
      FROM (SELECT mouse % 4 AS session, licking, photometry, lead(licking) OVER (PARTITION BY mouse ORDER BY i) AS nxt FROM sig)
      WHERE nxt IS NOT NULL
    ), ss AS (SELECT DISTINCT session FROM x), sets AS (SELECT a.session AS o, b.session AS h FROM ss a JOIN ss b ON a.session <= b.session
    ), st AS (
      SELECT o, h, model, count(*)::DOUBLE AS n, avg(x) AS m, stddev_pop(x) AS sd, avg(y) AS my
      FROM sets JOIN x ON session <> o AND session <> h GROUP BY ALL
    ), f AS (
      SELECT 0 AS it, o, h, model, unnest([{alphas}]) AS alpha, n, m, sd, {mean}::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM st
      UNION ALL
      SELECT it + 1, o, h, model, alpha, n, m, sd, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01),
        b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
      FROM (SELECT it, o, h, model, alpha, n, m, sd, b0, b1, sum(mu - y) AS g0, sum((mu - y) * z) + {penalty} * b1 AS g1, sum(w) AS h00,
              sum(w * z) AS h01, sum(w * z * z) + {penalty} AS h11
            FROM (SELECT f.*, x.y, (x.x - m) / sd AS z, {mu.format('b0 + b1 * ((x.x - m) / sd)')} AS mu, {weight} AS w
                  FROM f JOIN x ON x.model = f.model AND x.session <> o AND x.session <> h WHERE it < {NEWTON_STEPS})
            GROUP BY it, o, h, model, alpha, n, m, sd, b0, b1)
    ), q AS (
      SELECT f.o, f.h, x.session, f.model, alpha, y, {mu.format('b0 + b1 * ((x.x - m) / sd)')} AS p
      FROM f JOIN x ON x.model = f.model AND x.session IN (o, h) WHERE it = {NEWTON_STEPS}
    ), sc AS (
      SELECT CASE WHEN session = o THEN h ELSE o END AS outer_, session, model, alpha, {score} AS score
      FROM (SELECT *, sum(y) OVER w AS tp, count(*) OVER w AS above FROM q WHERE o <> h
            WINDOW w AS (PARTITION BY o, h, session, model, alpha ORDER BY p DESC)) GROUP BY ALL
    ), best AS (
      SELECT outer_, model, max(struct_pack(s := s, a := alpha)).a AS alpha
      FROM (SELECT outer_, model, alpha, round(avg(score), 12) AS s FROM sc GROUP BY ALL) GROUP BY ALL
    ), held AS (
      SELECT q.session, q.model, q.y, q.p FROM q JOIN best b ON q.o = b.outer_ AND q.model = b.model AND q.alpha = b.alpha WHERE q.o = q.h
      UNION ALL
      SELECT x.session, 'constant', x.y, t.my FROM x JOIN st t ON t.o = x.session AND t.h = x.session AND t.model = x.model
      WHERE x.model = 'history_only'
    )
    SELECT session::INTEGER AS session, model, {metrics}, count(*) AS n
    FROM (SELECT *, sum(y) OVER w AS tp, count(*) OVER w AS above FROM held WINDOW w AS (PARTITION BY session, model ORDER BY p DESC))
    GROUP BY session, model"""


@query("forecast_lick_binary", _lick_sql(
    "lick_binary", "alpha", "ln(my / (1 - my))", "(1 / (1 + exp(-({})))::DOUBLE)", "mu * (1 - mu)",
    "CASE WHEN nxt > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "sum(y * tp / above) / sum(y)",
    """round(sum(y * tp / above) / sum(y), 6) AS average_precision, round(avg(y), 6) AS positive_prevalence,
      round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss"""))
def forecast_lick_binary(spark, path):
    x = lick_models(spark, path, "lick_binary").metrics
    return x.select("session", "model", r6("average_precision"), r6("positive_prevalence"), r6("log_loss"), "n")


@query("forecast_lick_count", _lick_sql(
    "lick_count", "(alpha * n)", "ln(my)", "exp({})", "mu", "nxt::DOUBLE",
    "-2 * avg(CASE WHEN y > 0 THEN y * ln(y / p) ELSE 0 END - y + p)",
    """round(2 * avg(CASE WHEN y > 0 THEN y * ln(y / p) ELSE 0 END - y + p), 6) AS poisson_deviance,
      round(avg(abs(y - p)), 6) AS mae"""))
def forecast_lick_count(spark, path):
    x = lick_models(spark, path, "lick_count").metrics
    return x.select("session", "model", r6("poisson_deviance"), r6("mae"), "n")


@query("forecast_lick_kernels")
def forecast_lick_kernels(spark, path):
    x = lick_models(spark, path, "lick_count").coefficients
    return x.select("session", "model", "alpha", "feature", r6("coefficient"))


@query("forecast_logistic")
def forecast_logistic(spark, path):
    rows = tb.read(spark, path, "lineitem").select(
        "l_quantity", "l_discount", "l_tax", (F.col("l_returnflag") == "A").cast("double").alias("y")
    )
    fit = fc.fit_penalised(rows, ["l_quantity", "l_discount", "l_tax"], "y", "logistic", 1.0)
    scored = fc.predict(rows, fit, "logistic").withColumn("_all", F.lit(1))
    x = sc.binary(scored, ["_all"], "y", "prediction").drop("_all")
    return x.select(*[F.round(c, 4).alias(c) for c in x.columns])


@query("forecast_poisson")
def forecast_poisson(spark, path):
    rows = tb.read(spark, path, "lineitem").select(
        "l_discount", "l_tax", (F.col("l_extendedprice") / 10000.0).alias("price"),
        F.col("l_quantity").alias("y"),
    )
    fit = fc.fit_penalised(rows, ["l_discount", "l_tax", "price"], "y", "poisson", 1e-3)
    scored = fc.predict(rows, fit, "poisson").withColumn("_all", F.lit(1))
    x = sc.poisson(scored, ["_all"], "y", "prediction").drop("_all")
    return x.select(*[F.round(c, 4).alias(c) for c in x.columns])


@query(
    "auc_ap_logloss",
    """WITH d AS (SELECT lang, quality::DOUBLE AS y, greatest(least(n_chars / 20000.0::DOUBLE, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE) AS p
      FROM labels JOIN documents USING (doc_id)),
    r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0::DOUBLE AS rk,
      sum(y) OVER (PARTITION BY lang ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS tp,
      count(*) OVER (PARTITION BY lang ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS top FROM d),
    g AS (SELECT lang, avg(y) AS prev, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS ll, count(*) AS n,
      sum(y) AS n1, sum(y * tp / top) AS ap, sum(y * rk) AS rk FROM r GROUP BY lang)
    SELECT lang, round(prev, 6) AS positive_prevalence, round(ll, 6) AS log_loss, n,
      CASE WHEN n1 > 0 AND n1 < n THEN round(ap / n1, 6) END AS average_precision,
      CASE WHEN n1 > 0 AND n1 < n THEN round((rk - n1 * (n1 + 1) / 2) / (n1 * (n - n1)), 6) END AS roc_auc,
      CASE WHEN n1 > 0 AND n1 < n THEN round(ap / n1 - prev, 6) + 0.0 END AS ap_gain FROM g""",
)
def auc_ap_logloss(spark, path):
    d = tb.read(spark, path, "labels").join(
        tb.read(spark, path, "documents").select("doc_id", "lang", "n_chars"), "doc_id"
    )
    x = sc.binary(d.withColumn("p", F.col("n_chars") / 20000.0), ["lang"], "quality", "p")
    return x.select("lang", r6("positive_prevalence"), r6("log_loss"), "n", r6("average_precision"), r6("roc_auc"), r6("ap_gain"))


@query(
    "poisson_deviance",
    """WITH d AS (SELECT l_returnflag AS flag, l_quantity AS y, greatest(l_extendedprice / 1500, 1e-7::DOUBLE) AS mu FROM lineitem)
    SELECT flag, round(avg(2 * (CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END - y + mu)), 6) AS poisson_deviance,
      round(avg(abs(y - mu)), 6) AS mae, count(*) AS n,
      round(-avg(2 * (CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END - y + mu)), 6) AS negative_poisson_deviance
    FROM d GROUP BY flag""",
)
def poisson_deviance(spark, path):
    x = tb.read(spark, path, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("y"),
        (F.col("l_extendedprice") / 1500).alias("mu"),
    )
    x = sc.poisson(x, ["flag"], "y", "mu")
    return x.select("flag", r6("poisson_deviance"), r6("mae"), "n", r6("negative_poisson_deviance"))


@query(
    "continuous_scores",
    """WITH d AS (SELECT l_returnflag AS flag, l_extendedprice / 1000 AS y, 1.5 * l_quantity AS p FROM lineitem)
    SELECT flag, round(1 - avg(pow(y - p, 2)) / var_pop(y), 6) AS r2, round(avg(pow(y - p, 2)), 6) AS mse,
      round(avg(abs(y - p)), 6) AS mae, count(*) AS n FROM d GROUP BY flag""",
)
def continuous_scores(spark, path):
    x = price_rows(spark, path).withColumn("p", 1.5 * F.col("l_quantity"))
    return sc.continuous(x, ["flag"], "y", "p").select("flag", r6("r2"), r6("mse"), r6("mae"), "n")


# ---------------------------------------------------------------- lifetimes

BIN = 0.2
TIMES = [k * BIN for k in range(64)]


def curves(spark, path):
    """Embeddings as decay curves: absolute values as photon counts."""
    e = tb.read(spark, path, "embeddings")
    counts = F.transform("embedding", lambda x: F.abs(x.cast("double")) * 1000.0)
    return e.select("vec_id", "label", counts.alias("counts"))


CUR = """cur AS (SELECT vec_id, label, i - 1 AS bin, abs(embedding[i]::DOUBLE) * 1000.0 AS c
      FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings))"""
CORR_SQL = f"""{CUR}, tot AS (SELECT vec_id, sum(c) AS s FROM cur GROUP BY 1),
    cor AS (SELECT vec_id, label, bin, c - 2.0 / (1 - 64 * 2.0 * 10 * 1e-6) * (1 - s * 10 * 1e-6)
      - ((s * 10) - 64 * 2.0 / (1 - 64 * 2.0 * 10 * 1e-6) * (1 - s * 10 * 1e-6) * 10) * 0.03 / (10 * 64) AS v
      FROM cur JOIN tot USING (vec_id))"""


def corrected(spark, path):
    return lt.correct(
        curves(spark, path), background=F.transform("counts", lambda c: F.lit(2.0)),
        dead_time=1e-6, sampling_frequency=10.0, afterpulse_ratio=0.03,
    )


@query(
    "afterpulse_correct",
    f"WITH {CORR_SQL} SELECT vec_id, CAST(bin AS INTEGER) AS bin, round(v, 6) + 0.0 AS v FROM cor",
)
def afterpulse_correct(spark, path):
    x = corrected(spark, path).select("vec_id", F.posexplode("corrected").alias("bin", "v"))
    return x.select("vec_id", "bin", r6("v"))


@query(
    "mpet",
    f"""WITH {CORR_SQL} SELECT vec_id, label, CASE WHEN sum(v) > 0 THEN round(sum(v * bin * 0.2::DOUBLE) / sum(v) - 1.0, 6) + 0.0
      END AS mpet FROM cor WHERE bin * 0.2::DOUBLE BETWEEN 0.4 AND 12.3 GROUP BY ALL""",
)
def mpet(spark, path):
    x = corrected(spark, path)
    value = lt.mpet("corrected", lt.bin_times(F.size("counts"), BIN), t0=1.0)
    return x.select("vec_id", "label", (F.round(value, 6) + 0.0).alias("mpet"))


@query(
    "centroid_lifetime",
    f"""WITH {CUR}, ir AS (SELECT label, bin, avg(c) AS h FROM cur GROUP BY ALL),
    wb AS (SELECT vec_id, quantile_cont(c, 0.5) AS m FROM cur WHERE bin >= 57 GROUP BY 1),
    hb AS (SELECT label, quantile_cont(h, 0.5) AS m FROM ir WHERE bin >= 57 GROUP BY 1),
    wc AS (SELECT vec_id, label, sum(bin * 0.2::DOUBLE * greatest(c - m, 0)) / nullif(sum(greatest(c - m, 0)), 0) AS w
      FROM cur JOIN wb USING (vec_id) GROUP BY ALL),
    hc AS (SELECT label, sum(bin * 0.2::DOUBLE * greatest(h - m, 0)) / nullif(sum(greatest(h - m, 0)), 0) AS h
      FROM ir JOIN hb USING (label) GROUP BY ALL)
    SELECT vec_id, round(w - h, 6) + 0.0 AS lifetime FROM wc JOIN hc USING (label)""",
)
def centroid_lifetime(spark, path):
    c = curves(spark, path)
    irf = lt.pack_bins(lt.average_background(c, ["label"]), ["label"], "background", "irf")
    x = lt.moment_lifetime(
        c.join(irf, "label"), "counts", "irf", lt.bin_times(F.size("counts"), BIN)
    )
    return x.select("vec_id", r6("lifetime"))


@query(
    "average_background",
    f"WITH {CUR} SELECT label, CAST(bin AS INTEGER) AS bin, round(avg(c), 6) AS background FROM cur GROUP BY ALL",
)
def average_background(spark, path):
    x = lt.average_background(curves(spark, path), ["label"])
    return x.select("label", "bin", r6("background"))


@query(
    "bin_curves",
    f"""WITH {CUR}, o AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings)
    SELECT cur.label, CAST(i // 3 AS BIGINT) AS group_i, CAST(bin AS INTEGER) AS bin, round(sum(c), 5) AS c
    FROM cur JOIN o USING (vec_id) GROUP BY ALL HAVING count(*) = 3""",
)
def bin_curves(spark, path):
    indexed = index_rows(curves(spark, path), Series(("label",), "vec_id", 100000.0))
    x = lt.bin_curves(indexed, ["label"], 3)
    return x.select("label", "group_i", "bin", F.round("c", 5).alias("c"))


@query(
    "marker_bits",
    """SELECT l_orderkey, l_linenumber, (l_orderkey & 4) <> 0 AS marker1, (l_orderkey & 16) <> 0 AS marker3
    FROM lineitem""",
)
def marker_bits(spark, path):
    l = tb.read(spark, path, "lineitem")
    return l.select(
        "l_orderkey", "l_linenumber",
        lt.markers(l, "l_orderkey", 1).alias("marker1"), lt.markers(l, "l_orderkey", 3).alias("marker3"),
    )


SHAPE = dict(times=TIMES, lifetimes=(0.5, 1.8), t0=1.0, sigma=0.15, period=12.8)


def _summary_sql() -> str:
    raw = decay.component_basis(TIMES, (0.5, 1.8), 1.0, 0.15, 12.8, normalize=None)
    a = [repr(float(v)) + "::DOUBLE" for v in raw.sum(axis=0)]
    c = [repr(float(v)) + "::DOUBLE" for v in (np.array(TIMES)[:, None] * raw).sum(axis=0) / raw.sum(axis=0)]
    return f"""WITH k AS (SELECT l_orderkey, l_linenumber, l_quantity AS s, l_extendedprice / 1000 AS l FROM lineitem)
    SELECT l_orderkey, l_linenumber, round((l / {a[1]}) / (s / {a[0]} + l / {a[1]}), 6) AS long_amplitude_fraction,
      round((s / {a[0]} * 0.5 + l / {a[1]} * 1.8) / (s / {a[0]} + l / {a[1]}), 6) AS amplitude_weighted_lifetime,
      round((s * 0.5 + l * 1.8) / (s + l), 6) AS intensity_weighted_lifetime,
      round((s * {c[0]} + l * {c[1]}) / (s + l) - 1.0, 6) AS sensor_mpet FROM k"""


@query("component_summary", _summary_sql())
def component_summary(spark, path):
    l = tb.read(spark, path, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.array("l_quantity", F.col("l_extendedprice") / 1000).alias("components"),
    )
    x = lt.component_summaries(l, **SHAPE)
    return x.select(
        "l_orderkey", "l_linenumber",
        *[r6(c) for c in ("long_amplitude_fraction", "amplitude_weighted_lifetime",
                          "intensity_weighted_lifetime", "sensor_mpet")],
    )


@query(
    "residual_summary",
    f"""WITH {CUR}, r AS (SELECT vec_id, c, c - avg(c) OVER (PARTITION BY vec_id) AS e FROM cur)
    SELECT vec_id, round(100 * max(abs(e)) / max(abs(c)), 6) AS max_residual_percent,
      round(100 * sqrt(avg(e * e)) / max(abs(c)), 6) AS rmse_percent,
      round(100 * sum(abs(e)) / sum(abs(c)), 6) AS residual_area_percent FROM r GROUP BY vec_id""",
)
def residual_summary(spark, path):
    x = curves(spark, path).withColumn("_m", lt.total("counts") / F.size("counts"))
    x = x.withColumn("res", F.transform("counts", lambda c: c - F.col("_m")))
    x = lt.residual_summary(x, "counts", "res")
    return x.select(
        "vec_id", r6("max_residual_percent"), r6("rmse_percent"), r6("residual_area_percent")
    )


@query("nnls_components")
def nnls_components(spark, path):
    x = lt.fit_target(curves(spark, path), fit_background=True, **SHAPE)
    return x.select(
        "vec_id", F.round(F.col("components")[0], 4).alias("short"),
        F.round(F.col("components")[1], 4).alias("long"),
        F.round("background_counts", 4).alias("background"), r6("long_fraction"), r6("fit_rmse"),
    )


@query("decay_fit")
def decay_fit(spark, path):
    g = lt.average_background(curves(spark, path), ["label"])
    packed = lt.pack_bins(g, ["label"], "background", "counts")
    x = lt.fit_decays(packed, times=TIMES, period=12.8)
    return x.select("label", F.round(F.col("fit.lifetimes")[0], 3).alias("tau"), "fit.success")


@query("gamma_transfer")
def gamma_transfer(spark, path):
    hour = F.pmod(F.floor(F.col("t") / tb.HOUR), F.lit(24)).cast("double")
    e = tb.raw_events(spark, path).withColumn("grp", tb.group()).groupBy("grp", hour.alias("t"))
    x = e.agg(
        F.avg(F.when(F.col("kind") == "click", F.col("v"))).alias("drive"),
        F.avg(F.when(F.col("kind") == "purchase", F.col("v"))).alias("response"),
    ).dropna()
    y = tr.fit_gamma(x, ["grp"], [0.5, 1.0, 2.0, 4.0], orders=(1, 2), delays=(0.0, 1.0))
    return y.select("grp", "order", "tau", "delay", r6("gain"), F.round("r2", 4).alias("r2"))
