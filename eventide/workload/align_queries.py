"""Registered queries: clock alignment and preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.core.series import index_rows
from eventide.operators import align as al
from eventide.operators import preprocess as pp
from eventide.workload import tables as tb
from eventide.workload.event_queries import INTERNAL_PULSES, found_pulses, r6
from eventide.workload.registry import EV, query

PAIRED = f"""{EV},
    a AS (SELECT mouse, t AS ts, row_number() OVER (PARTITION BY mouse ORDER BY t) - 1 AS i
          FROM ev WHERE kind = 'click'),
    b AS (SELECT mouse, t AS tt, row_number() OVER (PARTITION BY mouse ORDER BY t) - 1 AS i
          FROM ev WHERE kind = 'view'),
    m AS (SELECT mouse, ts - min(ts) OVER (PARTITION BY mouse) AS x,
            tt - min(tt) OVER (PARTITION BY mouse) AS y FROM a JOIN b USING (mouse, i)),
    f AS (SELECT mouse, count(*) AS n, regr_slope(y, x) AS k, regr_intercept(y, x) AS c FROM m
          GROUP BY mouse HAVING count(*) >= 3)"""


@query(
    "clock_fit",
    f"""WITH {PAIRED} SELECT mouse, any_value(n) AS n, round(any_value(k), 6) AS scale,
      round(sqrt(avg(pow(y - (c + k * x), 2))), 3) AS rms, round(max(abs(y - (c + k * x))), 3) AS max_abs,
      round((any_value(k) - 1) * 1e6, 1) AS drift_ppm FROM m JOIN f USING (mouse) GROUP BY mouse""",
)
def clock_fit(spark, path):
    s = tb.series(spark, path)
    m = al.positional_matches(tb.train(spark, path, "click"), tb.train(spark, path, "view"), s)
    x = al.clock_fit(m, ["mouse"])
    return x.select(
        "mouse", "n", F.round("scale", 6).alias("scale"), F.round("rms", 3).alias("rms"),
        F.round("max_abs", 3).alias("max_abs"), F.round("drift_ppm", 1).alias("drift_ppm"),
    )


@query(
    "aligned_times",
    f"""WITH {PAIRED}, z AS (SELECT mouse, min(ts) AS s0 FROM (SELECT mouse, ts FROM a JOIN b USING (mouse, i))
      GROUP BY 1), z2 AS (SELECT mouse, min(tt) AS t0 FROM (SELECT mouse, tt FROM a JOIN b USING (mouse, i))
      GROUP BY 1)
    SELECT e.event_id, round(t0 + c + k * (e.t - s0), 2) AS t FROM ev e JOIN f USING (mouse)
    JOIN z USING (mouse) JOIN z2 USING (mouse) WHERE kind = 'error'""",
)
def aligned_times(spark, path):
    s = tb.series(spark, path)
    m = al.positional_matches(tb.train(spark, path, "click"), tb.train(spark, path, "view"), s)
    fits = al.clock_fit(m, ["mouse"])
    x = al.to_target_clock(tb.train(spark, path, "error"), fits, ["mouse"])
    return x.select("event_id", F.round("t", 2).alias("t"))


def _grid_pulses(spark, path, kinds):
    """Six-hour grid cells with any of the events: a periodic train with gaps."""
    e = tb.raw_events(spark, path).filter(F.col("kind").isin(*kinds))
    return e.select("mouse", (F.floor(F.col("t") / 21600.0) * 21600.0).alias("t")).distinct()


ORDINALS = f"""{EV},
    src AS (SELECT DISTINCT mouse, floor(t / 21600.0) * 21600.0 AS t FROM ev
            WHERE kind IN ('click', 'view', 'error')),
    tgt AS (SELECT DISTINCT mouse, floor(t / 21600.0) * 21600.0 AS t FROM ev
            WHERE kind IN ('purchase', 'signup')),
    so AS (SELECT mouse, t AS ts, row_number() OVER w - 1 AS source_i,
      CAST((t - min(t) OVER (PARTITION BY mouse)) / 21600.0 AS BIGINT) AS ordinal FROM src
      WINDOW w AS (PARTITION BY mouse ORDER BY t)),
    tg AS (SELECT mouse, t AS tt, row_number() OVER w - 1 AS target_i,
      CAST((t - min(t) OVER (PARTITION BY mouse)) / 21600.0 AS BIGINT) AS ordinal FROM tgt
      WINDOW w AS (PARTITION BY mouse ORDER BY t))"""


def _ordinal_inputs(spark, path):
    s = tb.series(spark, path)
    src = _grid_pulses(spark, path, ["click", "view", "error"])
    tgt = _grid_pulses(spark, path, ["purchase", "signup"])
    mice = tb.samples(spark, path).select("mouse").distinct().withColumn("period", F.lit(21600.0))
    return s, src, tgt, mice


@query(
    "ordinal_match",
    f"WITH {ORDINALS} SELECT mouse, ordinal, source_i, target_i, ts, tt FROM so JOIN tg USING (mouse, ordinal)",
)
def ordinal_match(spark, path):
    s, src, tgt, period = _ordinal_inputs(spark, path)
    return al.ordinal_matches(src, tgt, s, period, period)


@query(
    "unmatched_pulses",
    f"""WITH {ORDINALS} SELECT mouse, t, target_i FROM (SELECT mouse, tt AS t, target_i, ordinal FROM tg)
      WHERE (mouse, ordinal) NOT IN (SELECT mouse, ordinal FROM so)""",
)
def unmatched_pulses(spark, path):
    s, src, tgt, period = _ordinal_inputs(spark, path)
    m = al.ordinal_matches(src, tgt, s, period, period)
    return al.unmatched(tgt, m, s, "target_i")


@query(
    "median_interval",
    f"""WITH {EV}, d AS (SELECT mouse, t - lag(t) OVER (PARTITION BY mouse ORDER BY t) AS d FROM ev
      WHERE kind = 'click') SELECT mouse, round(quantile_cont(d, 0.5), 4) AS period FROM d
      WHERE d IS NOT NULL GROUP BY mouse""",
)
def median_interval(spark, path):
    x = al.median_interval(tb.train(spark, path, "click"), tb.series(spark, path))
    return x.select("mouse", F.round("period", 4).alias("period"))


@query(
    "demux_median",
    f"""WITH {INTERNAL_PULSES} SELECT p.mouse, p.rise_i, round(avg(x.t), 2) AS t,
      round(quantile_cont(e.v, 0.5), 6) AS v
    FROM pulses p JOIN x ON x.mouse = p.mouse AND x.i >= p.rise_i AND x.i < p.fall_i
    JOIN ev e ON e.mouse = x.mouse AND e.t = x.t GROUP BY ALL""",
)
def demux_median(spark, path):
    found, s = found_pulses(spark, path)
    x = index_rows(tb.samples(spark, path), s)
    y = pp.demultiplex(x, found, s, edge=0)
    return y.select("mouse", "rise_i", F.round("t", 2).alias("t"), r6("v"))


@query(
    "pulse_clock",
    f"""WITH {EV}, l AS (SELECT mouse, v, row_number() OVER w - 1 AS i, lead(v) OVER w AS nv,
        count(*) OVER (PARTITION BY mouse) AS n FROM ev WHERE kind = 'view'
        WINDOW w AS (PARTITION BY mouse ORDER BY t)),
    k AS (SELECT mouse, t, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY mouse) AS m FROM ev
        WHERE kind = 'click' WINDOW w AS (PARTITION BY mouse ORDER BY t)),
    q AS (SELECT k.*, n, CASE WHEN m > 1 THEN k * ((n - 1) / (m - 1)) ELSE 0 END AS x
          FROM k JOIN (SELECT DISTINCT mouse, n FROM l) USING (mouse))
    SELECT q.mouse, k, t, round(-(CASE WHEN nv IS NULL THEN v ELSE v + (x - i) * (nv - v) END), 6) AS v
    FROM q JOIN l ON l.mouse = q.mouse AND l.i = least(CAST(floor(x) AS BIGINT), q.n - 1)""",
)
def pulse_clock(spark, path):
    s = tb.series(spark, path)
    loco = index_rows(tb.raw_events(spark, path).filter("kind = 'view'").select("mouse", "t", "v"), s)
    x = pp.pulse_clock(loco, tb.train(spark, path, "click"), s, max_mismatch=1.0)
    return x.select("mouse", F.col("pulse_i").alias("k"), "t", r6("v"))


@query(
    "fractional_signal",
    f"""WITH {EV}, m AS (SELECT mouse, quantile_cont(v, 0.5) AS med FROM ev GROUP BY mouse)
    SELECT event_id, round((v - med) / med, 6) + 0.0 AS v FROM ev JOIN m USING (mouse)""",
)
def fractional_signal(spark, path):
    x = pp.fractional(tb.raw_events(spark, path), ["mouse"])
    return x.select("event_id", r6("v"))


def _price_lines(spark, path):
    return tb.read(spark, path, "lineitem").select(
        F.pmod("l_suppkey", F.lit(16)).alias("session"),
        F.col("l_quantity").alias("x"),
        F.col("l_extendedprice").alias("y"),
    )


@query("robust_dff")
def robust_dff(spark, path):
    data = _price_lines(spark, path)
    fits = pp.robust_fit(data, ["session"])
    q = pp.fit_quality(pp.delta_f_over_f(data, fits, ["session"]), ["session"])
    return fits.join(q, "session").select("session", *[r6(c) for c in ("b0", "b1", "r", "rmse")])
