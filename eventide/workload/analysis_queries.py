"""Registered queries: roll-ups, response metrics, ordering, nulls, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.core.lineage import cut
from eventide.core.ranks import percentiles
from eventide.core.series import index_rows
from eventide.functions.hashed import session_seed
from eventide.operators import halo
from eventide.operators import metrics as me
from eventide.operators import nulls as nl
from eventide.operators import ordering as od
from eventide.operators import perievent as pe
from eventide.operators import rollup as ru
from eventide.operators import stats as st
from eventide.workload import tables as tb
from eventide.workload.event_queries import (
    BASELINE, BOUTS, DT, GROUPED, TRIALS_SQL, WINDOW, click_bouts, purchases, r6, trials,
)
from eventide.workload.registry import EV, query

COND = "CASE WHEN t < 1705363200.0 THEN 'early' ELSE 'late' END"
WEEK = "CAST(floor((t - 1704067200.0) / 604800.0) AS BIGINT)"

# Session, mouse and group metrics: mean value per session, early / late.
METRICS_SQL = f"""{EV},
    sess AS (SELECT mouse, {GROUPED} AS grp, {COND} AS cond, {WEEK} AS session, kind AS metric,
               avg(v) AS value, count(*) AS n_trials FROM ev GROUP BY ALL),
    mice AS (SELECT mouse, grp, cond, metric, avg(value) AS value, count(*) AS n_sessions,
               CAST(sum(n_trials) AS BIGINT) AS n_trials FROM sess GROUP BY ALL)"""


def session_metrics(spark, path):
    e = tb.raw_events(spark, path)
    return (
        e.withColumns({"grp": tb.group(), "cond": tb.condition(), "session": tb.week()})
        .groupBy("mouse", "grp", "cond", "session", F.col("kind").alias("metric"))
        .agg(F.avg("v").alias("value"), F.count(F.lit(1)).alias("n_trials"))
    )


def mice(spark, path):
    return ru.mouse_metrics(session_metrics(spark, path), ["mouse", "grp", "cond", "metric"])


@query(
    "mouse_rollup",
    f"WITH {METRICS_SQL} SELECT * REPLACE (round(value, 6) AS value) FROM mice",
)
def mouse_rollup(spark, path):
    return mice(spark, path).withColumn("value", F.round("value", 6))


@query(
    "hier_rollup",
    f"""WITH {METRICS_SQL} SELECT grp, cond, metric, round(avg(value), 6) AS mean,
      round(stddev_samp(value) / sqrt(count(value)), 6) AS sem, count(value) AS n_mice
      FROM mice GROUP BY ALL""",
)
def hier_rollup(spark, path):
    x = ru.group_metrics(mice(spark, path), ["grp", "cond", "metric"])
    return x.select("grp", "cond", "metric", r6("mean"), r6("sem"), "n_mice")


@query(
    "trial_rollup",
    f"""WITH {EV}, s AS (SELECT mouse, {WEEK} AS session, avg(v) AS value, count(v) AS n
      FROM ev GROUP BY ALL)
    SELECT mouse, round(avg(value), 6) AS value, count(*) AS n_sessions,
      CAST(sum(n) AS BIGINT) AS n_trials FROM s GROUP BY mouse""",
)
def trial_rollup(spark, path):
    e = tb.raw_events(spark, path)
    rows = e.select("mouse", tb.week().alias("session"), F.col("v").alias("value"))
    _, per_mouse = ru.trial_metrics(rows, ["mouse", "session"], ["mouse"])
    return per_mouse.withColumn("value", F.round("value", 6))


@query(
    "session_spread",
    f"""WITH {EV} SELECT mouse, {WEEK} AS session, round(avg(v), 6) AS value,
      round(stddev_samp(v), 6) AS sd, count(v) AS n_trials FROM ev GROUP BY ALL""",
)
def session_spread(spark, path):
    e = tb.raw_events(spark, path)
    rows = e.select("mouse", tb.week().alias("session"), F.col("v").alias("value"))
    per_session, _ = ru.trial_metrics(rows, ["mouse", "session"], ["mouse"])
    return per_session.withColumns({"value": F.round("value", 6), "sd": F.round("sd", 6)})


@query(
    "median_iqr",
    f"""WITH {EV} SELECT kind, round(avg(v), 6) AS mean,
      round(stddev_samp(v) / sqrt(count(v)), 6) AS sem, count(v) AS n,
      round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median,
      round(quantile_cont(v, 0.75), 6) AS q75 FROM ev GROUP BY kind""",
)
def median_iqr(spark, path):
    x = ru.robust_summary(tb.raw_events(spark, path), ["kind"], "v")
    return x.select(
        "kind", r6("mean"), r6("sem"), F.col("n").cast("bigint").alias("n"),
        r6("q25"), r6("median"), r6("q75"),
    )


@query(
    "tumbling_bins",
    f"""WITH {EV}, x AS (SELECT mouse, v, row_number() OVER (PARTITION BY mouse ORDER BY t) - 1 AS i
      FROM ev) SELECT mouse, CAST(i // 5 AS BIGINT) AS bin, round(sum(v), 6) AS v FROM x
      GROUP BY ALL HAVING count(*) = 5""",
)
def tumbling_bins(spark, path):
    x = index_rows(tb.samples(spark, path), tb.series(spark, path))
    return ru.tumbling_bins(x, ["mouse"], 5).withColumn("v", F.round("v", 6))


@query(
    "block_reduce",
    f"""WITH {EV}, x AS (SELECT mouse, v, row_number() OVER (PARTITION BY mouse ORDER BY t) - 1 AS i
      FROM ev) SELECT mouse, CAST(i // 4 AS BIGINT) AS bin, round(avg(v), 6) AS block_mean,
      round(sum(v), 6) AS block_sum, bool_or(v <> 0) AS block_any, count(*) AS n
      FROM x GROUP BY ALL""",
)
def block_reduce(spark, path):
    x = index_rows(tb.samples(spark, path), tb.series(spark, path))
    y = ru.block_reduce(x, ["mouse"], 4)
    return y.withColumns({"block_mean": F.round("block_mean", 6), "block_sum": F.round("block_sum", 6)})


@query(
    "paired_difference",
    f"""WITH {METRICS_SQL}, d AS (SELECT grp, metric, mouse,
      max(value) FILTER (cond = 'late') - max(value) FILTER (cond = 'early') AS d FROM mice
      GROUP BY ALL HAVING d IS NOT NULL)
    SELECT grp, metric, round(avg(d), 6) + 0.0 AS mean, round(stddev_samp(d) / sqrt(count(d)), 6) AS sem,
      count(d) AS n_mice FROM d GROUP BY ALL""",
)
def paired_difference(spark, path):
    x = ru.paired_difference(
        mice(spark, path), condition="cond", first="early", second="late",
        mouse=["mouse"], at=["metric"], group=["grp"], value="value",
    )
    return x.select("grp", "metric", r6("mean"), r6("sem"), "n_mice")


PRISM = [f"{g}__{c}__purchase" for g in ("control", "treated") for c in ("early", "late")]


@query(
    "prism_wide",
    f"""WITH {METRICS_SQL} SELECT mouse, {", ".join(
        f"round(max(value) FILTER (grp || '__' || cond || '__' || metric = '{c}'), 6) AS {c}"
        for c in PRISM)} FROM mice GROUP BY mouse""",
)
def prism_wide(spark, path):
    x = ru.pivot_wide(mice(spark, path), PRISM)
    return x.select("mouse", *[F.round(c, 6).alias(c) for c in PRISM])


@query(
    "zscore_global",
    f"""WITH {EV} SELECT event_id, round((v - avg(v) OVER (PARTITION BY mouse))
      / stddev_pop(v) OVER (PARTITION BY mouse), 6) + 0.0 AS v FROM ev""",
)
def zscore_global(spark, path):
    x = ru.transform_series(tb.raw_events(spark, path), ["mouse"], "zscore")
    return x.select("event_id", r6("v"))


@query(
    "decimate",
    f"""WITH {EV}, x AS (SELECT mouse, t, v, row_number() OVER (PARTITION BY mouse ORDER BY t) - 1 AS i,
        count(*) OVER (PARTITION BY mouse) AS n FROM ev),
    j AS (SELECT unnest(range(0, 20)) AS j),
    p AS (SELECT DISTINCT mouse, CAST(floor(j * ((n - 1) / 19::DOUBLE)) AS BIGINT) AS i
          FROM (SELECT DISTINCT mouse, n FROM x WHERE n > 20), j)
    SELECT mouse, i, v FROM x WHERE n <= 20 OR (mouse, i) IN (SELECT mouse, i FROM p)""",
)
def decimate(spark, path):
    x = index_rows(tb.samples(spark, path), tb.series(spark, path))
    return ru.decimate(x, ["mouse"], 20).select("mouse", "i", "v")


@query(
    "ntile_blocks",
    f"""WITH {EV} SELECT event_id, CAST(ntile(5) OVER (PARTITION BY mouse ORDER BY t) - 1 AS BIGINT)
      AS block FROM ev""",
)
def ntile_blocks(spark, path):
    x = index_rows(tb.raw_events(spark, path), tb.series(spark, path))
    return ru.contiguous_blocks(x, ["mouse"], 5).select("event_id", "block")


@query(
    "moving_average",
    f"""WITH {TRIALS_SQL} SELECT event_i, lag_i, round(avg(v) OVER (PARTITION BY event_i ORDER BY lag_i
      ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS sm FROM trials""",
)
def moving_average(spark, path):
    x = me.moving_average(trials(spark, path), ["event_i"], "lag_i", 5)
    return x.select("event_i", "lag_i", r6("sm"))


RESPONSE = (0.0, 86400.0)
WITHIN = f"""{TRIALS_SQL},
    smo AS (SELECT *, avg(v) OVER (PARTITION BY event_i ORDER BY lag_i
            ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS sm FROM sub),
    win AS (SELECT *, lead(v) OVER w AS nv, lead(rel_t) OVER w AS nt,
            max(sm) OVER (PARTITION BY event_i) AS mx, min(sm) OVER (PARTITION BY event_i) AS mn
            FROM smo WHERE rel_t BETWEEN 0 AND 86400
            WINDOW w AS (PARTITION BY event_i ORDER BY lag_i))"""


def response(spark, path, names, threshold=1.0):
    sub = pe.normalise(trials(spark, path), ["mouse", "event_i"], mode="subtract", baseline=BASELINE)
    return me.response_metrics(
        sub, ["mouse", "event_i"], window=RESPONSE, dt=DT, n_lags=17, metrics=names,
        peak_smoothing=3 * DT, movement_threshold=threshold,
    )


@query(
    "metric_auc",
    f"""WITH {WITHIN} SELECT mouse, event_i, round(avg(v), 6) + 0.0 AS mean,
      round(sum((v + nv) / 2 * (nt - rel_t)), 3) + 0.0 AS auc FROM win GROUP BY mouse, event_i""",
)
def metric_auc(spark, path):
    x = response(spark, path, ("mean", "auc"))
    return x.select("mouse", "event_i", r6("mean"), (F.round("auc", 3) + 0.0).alias("auc"))


@query(
    "metric_pos_neg_auc",
    f"""WITH {WITHIN} SELECT mouse, event_i,
      round(sum((greatest(v, 0) + CASE WHEN nv IS NOT NULL THEN greatest(nv, 0) END) / 2 * (nt - rel_t)), 3)
        + 0.0 AS positive_auc,
      round(sum((least(v, 0) + CASE WHEN nv IS NOT NULL THEN least(nv, 0) END) / 2 * (nt - rel_t)), 3)
        + 0.0 AS negative_auc FROM win GROUP BY mouse, event_i""",
)
def metric_pos_neg_auc(spark, path):
    x = response(spark, path, ("positive_auc", "negative_auc"))
    return x.select(
        "mouse", "event_i",
        (F.round("positive_auc", 3) + 0.0).alias("positive_auc"),
        (F.round("negative_auc", 3) + 0.0).alias("negative_auc"),
    )


@query(
    "metric_peak_latency",
    f"""WITH {WITHIN} SELECT mouse, event_i, round(max(sm), 6) + 0.0 AS peak,
      min(rel_t) FILTER (sm = mx) AS peak_latency, round(min(sm), 6) + 0.0 AS trough,
      min(rel_t) FILTER (sm = mn) AS trough_latency FROM win GROUP BY mouse, event_i""",
)
def metric_peak_latency(spark, path):
    x = response(spark, path, ("peak", "peak_latency", "trough", "trough_latency"))
    return x.select("mouse", "event_i", r6("peak"), "peak_latency", r6("trough"), "trough_latency")


@query(
    "metric_counts",
    f"""WITH {WITHIN} SELECT mouse, event_i, round(sum(greatest(v, 0)) * 21600.0, 2) AS distance,
      round(avg(CASE WHEN v > 10 THEN 1.0 ELSE 0.0 END), 6) AS moving_fraction,
      min(rel_t) FILTER (v > 10) AS movement_onset_latency,
      max(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS any_lick,
      min(rel_t) FILTER (v > 0) AS first_lick_latency FROM win GROUP BY mouse, event_i""",
)
def metric_counts(spark, path):
    names = ("distance", "moving_fraction", "movement_onset_latency", "any_lick", "first_lick_latency")
    x = response(spark, path, names, threshold=10.0)
    return x.withColumns({"distance": F.round("distance", 2), "moving_fraction": r6("moving_fraction")})


@query(
    "metric_lick_count",
    f"""WITH {WITHIN} SELECT mouse, event_i, round(sum(greatest(v, 0)) * 21600.0, 2) AS lick_count
      FROM win GROUP BY mouse, event_i""",
)
def metric_lick_count(spark, path):
    return response(spark, path, ("lick_count",)).withColumn("lick_count", F.round("lick_count", 2))


@query(
    "metric_long_units",
    f"""WITH {WITHIN}, m AS (SELECT mouse, event_i, avg(v) AS mean, min(rel_t) FILTER (sm = mx)
      AS peak_latency FROM win GROUP BY mouse, event_i),
    l AS (SELECT mouse, event_i, unnest(['mean', 'peak_latency']) AS metric,
          unnest([mean, peak_latency]) AS value FROM m)
    SELECT mouse, event_i, metric, round(value, 6) + 0.0 AS value,
      CASE WHEN metric = 'mean' THEN 'dF/F' ELSE 's' END AS units FROM l""",
)
def metric_long_units(spark, path):
    names = ("mean", "peak_latency")
    x = me.metric_long(response(spark, path, names), ["mouse", "event_i"], names)
    return x.select("mouse", "event_i", "metric", r6("value"), me.metric_units("dF/F").alias("units"))


@query(
    "smooth_rate",
    f"""WITH {EV}, g AS (SELECT mouse, CAST(floor((t - 1704067200.0) / 3600.0) AS BIGINT) AS hour,
        count(*) FILTER (kind = 'click') AS v FROM ev GROUP BY ALL)
    SELECT mouse, hour, round(sum(v) OVER (PARTITION BY mouse ORDER BY hour ROWS BETWEEN 2 PRECEDING
      AND 2 FOLLOWING) / 5.0, 6) AS rate FROM g""",
)
def smooth_rate(spark, path):
    hour = F.floor((F.col("t") - 1704067200.0) / 3600.0).cast("bigint")
    g = tb.raw_events(spark, path).groupBy("mouse", hour.alias("hour")).agg(
        F.sum(F.when(F.col("kind") == "click", 1).otherwise(0)).alias("v")
    )
    # At most one row per recorded hour: the window is bounded by the month.
    x = me.smooth_rate(g, ["mouse"], "hour", rate_hz=1.0, seconds=5.0)
    return x.select("mouse", "hour", r6("rate"))


# ---------------------------------------------------------------- ordering


def alignments(spark, path):
    x = purchases(spark, path)
    return index_rows(x, tb.series(spark, path), "trial")


ALIGN = f"""{EV}, al AS (SELECT mouse, event_id AS event_i, t,
      row_number() OVER (PARTITION BY mouse ORDER BY t) - 1 AS trial FROM ev WHERE kind = 'purchase')"""


def _order_sql(values: str, direction: str) -> str:
    tie = "DESC" if direction == "DESC" else "ASC"
    return f"""WITH {ALIGN}, {values}
    SELECT mouse, event_i, trial, round(sort_value, 6) + 0.0 AS sort_value,
      CAST(row_number() OVER (PARTITION BY mouse ORDER BY sort_value {direction} NULLS LAST,
        CASE WHEN sort_value IS NULL THEN trial END ASC, trial {tie}) - 1 AS BIGINT) AS position
    FROM vals"""


def _ordered(spark, path, method, events, window):
    s = tb.series(spark, path)
    v = od.sort_values(alignments(spark, path), s, method, events=events, window=window)
    x = od.order_trials(v, ["mouse"], method)
    return x.select("mouse", "event_i", "trial", r6("sort_value"), "position")


@query(
    "heatmap_order",
    _order_sql(
        """vals AS (SELECT al.*, (SELECT min(c.t) - al.t FROM ev c WHERE c.mouse = al.mouse
           AND c.kind = 'click' AND c.t >= al.t AND c.t - al.t <= 86400.0) AS sort_value FROM al)""",
        "ASC",
    ),
)
def heatmap_order(spark, path):
    return _ordered(
        spark, path, "first_lick_latency", tb.train(spark, path, "click"), (0.0, tb.DAY)
    )


@query(
    "heatmap_order_counts",
    _order_sql(
        """vals AS (SELECT al.*, (SELECT count(*)::DOUBLE FROM ev c WHERE c.mouse = al.mouse
           AND c.kind = 'click' AND c.t >= al.t AND c.t <= al.t + 172800.0) AS sort_value FROM al)""",
        "DESC",
    ),
)
def heatmap_order_counts(spark, path):
    return _ordered(
        spark, path, "post_event_lick_count", tb.train(spark, path, "click"), (0.0, 2 * tb.DAY)
    )


@query(
    "heatmap_order_events",
    _order_sql("vals AS (SELECT *, trial::DOUBLE AS sort_value FROM al)", "ASC"),
)
def heatmap_order_events(spark, path):
    return _ordered(spark, path, "event_order", None, None)


@query(
    "heatmap_order_rate",
    _order_sql(
        """vals AS (SELECT al.*, (SELECT count(*)::DOUBLE FROM ev c WHERE c.mouse = al.mouse
           AND c.kind = 'click' AND c.t >= al.t - 172800.0 AND c.t <= al.t) / 172800.0 AS sort_value FROM al)""",
        "DESC",
    ),
)
def heatmap_order_rate(spark, path):
    return _ordered(
        spark, path, "pre_event_lick_rate", tb.train(spark, path, "click"), (-2 * tb.DAY, 0.0)
    )


@query(
    "heatmap_order_pooled",
    f"""WITH {ALIGN}, vals AS (SELECT al.*, (SELECT min(c.t) - al.t FROM ev c WHERE c.mouse = al.mouse
        AND c.kind = 'click' AND c.t >= al.t AND c.t - al.t <= 86400.0) AS sort_value FROM al)
    SELECT mouse, event_i, trial, round(sort_value, 6) + 0.0 AS sort_value,
      CAST(row_number() OVER (ORDER BY sort_value ASC NULLS LAST, event_i) - 1 AS BIGINT) AS position
    FROM vals""",
)
def heatmap_order_pooled(spark, path):
    s = tb.series(spark, path)
    v = od.sort_values(
        alignments(spark, path), s, "first_lick_latency", events=tb.train(spark, path, "click"), window=(0.0, tb.DAY)
    )
    x = od.order_trials(v.withColumn("_all", F.lit(1)), ["_all"], "first_lick_latency", trial="event_i")
    return x.select("mouse", "event_i", "trial", r6("sort_value"), "position")


@query(
    "heatmap_order_bouts",
    f"""WITH {BOUTS}, al AS (SELECT mouse, event_id AS event_i, t,
      row_number() OVER (PARTITION BY mouse ORDER BY t) - 1 AS trial FROM ev WHERE kind = 'purchase'),
    vals AS (SELECT al.*, (SELECT arg_min(b.n, b.onset_t)::DOUBLE FROM bouts b WHERE b.mouse = al.mouse
           AND b.onset_t >= al.t AND b.onset_t - al.t <= 432000.0) AS sort_value FROM al)
    SELECT mouse, event_i, trial, sort_value,
      CAST(row_number() OVER (PARTITION BY mouse ORDER BY sort_value DESC NULLS LAST,
        CASE WHEN sort_value IS NULL THEN trial END ASC, trial DESC) - 1 AS BIGINT) AS position
    FROM vals""",
)
def heatmap_order_bouts(spark, path):
    found = click_bouts(spark, path).withColumnRenamed("onset_t", "t")
    return _ordered(spark, path, "bout_size", found, (0.0, 5 * tb.DAY))


@query(
    "heatmap_order_response",
    f"""WITH {TRIALS_SQL}, tr AS (SELECT mouse, event_i, event_t, avg(v) AS sort_value FROM trials
      WHERE rel_t >= 0 GROUP BY ALL),
    vals AS (SELECT *, row_number() OVER (PARTITION BY mouse ORDER BY event_t) - 1 AS trial FROM tr)
    SELECT mouse, event_i, trial, round(sort_value, 6) AS sort_value, CAST(row_number() OVER
      (PARTITION BY mouse ORDER BY sort_value DESC, trial DESC) - 1 AS BIGINT) AS position FROM vals""",
)
def heatmap_order_response(spark, path):
    s = tb.series(spark, path)
    bounds = pe.recording_bounds(tb.samples(spark, path), s)
    al = index_rows(pe.complete_windows(purchases(spark, path), bounds, s, WINDOW), s, "trial")
    v = od.sort_values(al, s, "response_mean", trials=trials(spark, path))
    x = od.order_trials(v, ["mouse"], "response_mean")
    return x.select("mouse", "event_i", "trial", r6("sort_value"), "position")


@query(
    "mouse_order",
    f"""WITH {ALIGN}, vals AS (SELECT al.*, (SELECT al.t - max(c.t) FROM ev c WHERE c.mouse = al.mouse
           AND c.kind = 'view' AND c.t <= al.t AND c.t - al.t >= -432000.0) AS sort_value FROM al),
    m AS (SELECT mouse, quantile_cont(sort_value, 0.5) AS median_key FROM vals
          WHERE sort_value IS NOT NULL GROUP BY mouse)
    SELECT mouse, round(median_key, 4) AS median_key,
      CAST(row_number() OVER (ORDER BY median_key DESC, mouse DESC) - 1 AS BIGINT) AS mouse_position
    FROM m""",
)
def mouse_order(spark, path):
    s = tb.series(spark, path)
    v = od.sort_values(
        alignments(spark, path), s, "cue_to_bout_latency", events=tb.train(spark, path, "view"),
        window=(-5 * tb.DAY, 0.0),
    )
    x = od.mouse_order(v, descending=True)
    return x.withColumn("median_key", F.round("median_key", 4))


# ---------------------------------------------------------------- null models

SHUFFLES = 500
#: Onsets to the millisecond, in arithmetic that rounds alike everywhere.
MILLIS = "floor(t * 1000 + 0.5D) / 1000 AS t"
MD5U = "(('0x' || substr(md5({label}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


def _null_events(spark, path, method):
    s = tb.series(spark, path)
    bounds = nl.onset_bounds(pe.recording_bounds(tb.samples(spark, path), s), WINDOW)
    return nl.null_onsets(
        purchases(spark, path), s, bounds, n_shuffles=SHUFFLES, method=method, seed=7
    ), s


NULL_SQL = f"""{EV}, bnd AS (SELECT mouse, min(t) AS rec_lo, max(t) AS rec_hi,
      min(t) + 172800.0 AS lo, max(t) - 172800.0 AS hi FROM ev GROUP BY mouse),
    d AS (SELECT e.mouse, e.event_id AS event_i, shuffle, lo, hi, rec_lo, rec_hi,
      lo + {MD5U.format(label="'7|' || e.mouse || '|' || shuffle || '|' || e.event_id || '|0'")}
        * (hi - lo) AS t
      FROM ev e JOIN bnd USING (mouse), (SELECT unnest(range(0, {SHUFFLES}))::INTEGER AS shuffle)
      WHERE kind = 'purchase' AND hi > lo)"""


@query(
    "null_random_onsets",
    f"WITH {NULL_SQL} SELECT mouse, event_i, shuffle, floor(t * 1000 + 0.5) / 1000 AS t FROM d",
)
def null_random_onsets(spark, path):
    x, _ = _null_events(spark, path, "random_onsets")
    return x.select("mouse", "event_i", "shuffle", F.expr(MILLIS))


@query(
    "circular_shift",
    f"""WITH {EV}, bnd AS (SELECT mouse, min(t) + 172800.0 AS lo, max(t) - 172800.0 AS hi FROM ev
      GROUP BY mouse),
    d AS (SELECT e.mouse, e.event_id AS event_i, shuffle, lo, hi - lo AS span,
      {MD5U.format(label="'7|' || e.mouse || '|' || shuffle || '|0'")} * (hi - lo)
        + (e.t - lo - (hi - lo) * floor((e.t - lo) / (hi - lo))) AS off
      FROM ev e JOIN bnd USING (mouse), (SELECT unnest(range(0, {SHUFFLES}))::INTEGER AS shuffle)
      WHERE kind = 'purchase' AND hi > lo)
    SELECT mouse, event_i, shuffle, floor((lo + off - span * floor(off / span)) * 1000 + 0.5) / 1000 AS t FROM d""",
)
def circular_shift(spark, path):
    x, _ = _null_events(spark, path, "circular_shift")
    return x.select("mouse", "event_i", "shuffle", F.expr(MILLIS))


NULL_TRIALS_SQL = f"""{NULL_SQL},
    smp AS (SELECT mouse, t, v, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM ev
            WINDOW w AS (PARTITION BY mouse ORDER BY t)),
    q AS (SELECT d.mouse, event_i, shuffle, lag_i, -172800.0::DOUBLE + lag_i * 21600.0::DOUBLE AS rel_t,
            d.t + (-172800.0 + lag_i * 21600.0) AS qt
          FROM d, (SELECT unnest(range(0, 17))::INTEGER AS lag_i)
          WHERE d.t - 172800.0 >= rec_lo AND d.t + 172800.0 <= rec_hi),
    tr AS (SELECT q.*, CASE WHEN q.qt = s.t THEN s.v
             ELSE s.v + (q.qt - s.t) * ((s.v1 - s.v) / (s.t1 - s.t)) END AS v
           FROM q ASOF JOIN smp s ON q.mouse = s.mouse AND q.qt >= s.t),
    nsub AS (SELECT * EXCLUDE (v), v - avg(v) FILTER (rel_t < 0)
             OVER (PARTITION BY event_i, shuffle) AS v FROM tr),
    nm AS (SELECT mouse, shuffle, lag_i, avg(v) AS v FROM nsub GROUP BY ALL),
    ng AS (SELECT {GROUPED} AS grp, shuffle, lag_i, avg(v) AS v FROM nm GROUP BY ALL)"""


def null_group_means(spark, path):
    events, s = _null_events(spark, path, "random_onsets")
    return halo.group_means(
        tb.samples(spark, path), events.withColumn("grp", tb.group()), s, WINDOW, DT, "grp", mode="subtract", baseline=BASELINE)


@query(
    "null_envelope",
    f"""WITH {NULL_TRIALS_SQL} SELECT grp, lag_i, round(quantile_cont(v, 0.025), 6) + 0.0 AS lower,
      round(quantile_cont(v, 0.975), 6) + 0.0 AS upper, count(v) AS n_shuffles FROM ng GROUP BY ALL""",
)
def null_envelope(spark, path):
    x = nl.envelope(null_group_means(spark, path), ["grp", "lag_i"])
    return x.select("grp", "lag_i", r6("lower"), r6("upper"), "n_shuffles")


@query(
    "empirical_p",
    f"""WITH {NULL_TRIALS_SQL}, bnd2 AS (SELECT mouse, min(t) AS lo, max(t) AS hi FROM ev GROUP BY 1),
    og AS (SELECT e.mouse, e.event_id, lag_i, rel_t, e.t + rel_t AS qt FROM ev e JOIN bnd2 USING (mouse),
      (SELECT unnest(range(0, 17))::INTEGER AS lag_i, -172800.0::DOUBLE + lag_i * 21600.0::DOUBLE AS rel_t)
      WHERE kind = 'purchase' AND e.t - 172800.0 >= lo AND e.t + 172800.0 <= hi),
    ot AS (SELECT og.*, CASE WHEN og.qt = s.t THEN s.v
             ELSE s.v + (og.qt - s.t) * ((s.v1 - s.v) / (s.t1 - s.t)) END AS v
           FROM og ASOF JOIN smp s ON og.mouse = s.mouse AND og.qt >= s.t),
    os AS (SELECT * EXCLUDE (v), v - avg(v) FILTER (rel_t < 0) OVER (PARTITION BY event_id) AS v FROM ot),
    om AS (SELECT mouse, lag_i, avg(v) AS v FROM os GROUP BY ALL),
    ob AS (SELECT {GROUPED} AS grp, lag_i, avg(v) AS observed_mean FROM om GROUP BY ALL),
    c AS (SELECT grp, lag_i, quantile_cont(v, 0.5) AS med, avg(v) AS null_mean, count(v) AS n_shuffles,
            quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM ng GROUP BY ALL)
    SELECT grp, lag_i, round(any_value(observed_mean), 6) + 0.0 AS observed_mean,
      round(any_value(null_mean), 6) + 0.0 AS null_mean, round(any_value(lo), 6) + 0.0 AS null_lower,
      round(any_value(hi), 6) + 0.0 AS null_upper,
      round((1 + count(*) FILTER (abs(v - med) >= abs(observed_mean - med))) / (any_value(n_shuffles) + 1), 6)
        AS p_value, any_value(n_shuffles) AS n_shuffles
    FROM ng JOIN c USING (grp, lag_i) JOIN ob USING (grp, lag_i) GROUP BY ALL""",
)
def empirical_p(spark, path):
    null = cut(null_group_means(spark, path)).withColumnRenamed("v", "value")
    sub = pe.normalise(trials(spark, path), ["mouse", "event_i"], mode="subtract", baseline=BASELINE)
    observed = (
        sub.groupBy("mouse", "lag_i").agg(F.avg("v").alias("v")).withColumn("grp", tb.group())
        .groupBy("grp", "lag_i").agg(F.avg("v").alias("observed_mean"))
    )
    x = nl.shuffle_tests(observed, null, ["grp", "lag_i"])
    return x.select(
        "grp", "lag_i", r6("observed_mean"), r6("null_mean"), r6("null_lower"), r6("null_upper"),
        r6("p_value"), "n_shuffles",
    )


@query(
    "session_seed",
    """SELECT c_custkey, CAST(('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2)
      || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))
      ::UBIGINT AS VARCHAR) AS seed
    FROM (SELECT c_custkey, sha256('0|' || c_name || '|' || c_nationkey) AS h FROM customer)""",
)
def seed_query(spark, path):
    c = tb.read(spark, path, "customer")
    return c.select("c_custkey", session_seed(0, F.col("c_name"), F.col("c_nationkey")).alias("seed"))


# ---------------------------------------------------------------- statistics


@query(
    "welch_stat",
    f"""WITH {METRICS_SQL}, l AS (SELECT cond, metric, grp, count(value) AS n, avg(value) AS m,
      var_samp(value) AS s FROM mice GROUP BY ALL),
    p AS (SELECT a.cond, a.metric, a.n AS na, b.n AS nb, a.m AS ma, b.m AS mb, a.s AS sa, b.s AS sb
      FROM l a JOIN l b ON a.cond = b.cond AND a.metric = b.metric AND a.grp = 'control' AND b.grp = 'treated'
      WHERE a.n >= 2 AND b.n >= 2)
    SELECT cond, metric, na AS n_a, nb AS n_b, round(ma - mb, 6) + 0.0 AS difference,
      round((ma - mb) / sqrt(sa / na + sb / nb), 6) + 0.0 AS statistic,
      round(pow(sa / na + sb / nb, 2) / (pow(sa / na, 2) / (na - 1) + pow(sb / nb, 2) / (nb - 1)), 4) AS df,
      round((ma - mb) / sqrt(((na - 1) * sa + (nb - 1) * sb) / (na + nb - 2))
        * (1 - 3.0::DOUBLE / (4 * (na + nb) - 9)), 6) + 0.0 AS effect_size FROM p""",
)
def welch_stat(spark, path):
    levels = st.level_stats(mice(spark, path), ["cond", "metric", "grp"])
    x = st.welch(st.level_pairs(levels, ["cond", "metric"], "grp"))
    return x.select(
        "cond", "metric", "n_a", "n_b", r6("difference"), r6("statistic"),
        F.round("df", 4).alias("df"), r6("effect_size"),
    )


PAIRS_SQL = f"""{METRICS_SQL}, pr AS (SELECT a.grp, a.metric, a.mouse, a.value - b.value AS d
      FROM mice a JOIN mice b USING (grp, metric, mouse) WHERE a.cond = 'early' AND b.cond = 'late')"""


@query(
    "paired_t_stat",
    f"""WITH {PAIRS_SQL} SELECT grp, metric, count(d) AS n_pairs, round(avg(d), 6) + 0.0 AS difference,
      round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) + 0.0 AS statistic,
      round(avg(d) / stddev_samp(d), 6) + 0.0 AS effect_size FROM pr GROUP BY ALL""",
)
def paired_t_stat(spark, path):
    x = st.paired_stats(mice(spark, path), ["grp", "metric"], "cond")
    return x.select("grp", "metric", "n_pairs", r6("difference"), r6("statistic"), r6("effect_size"))


@query(
    "signed_rank",
    f"""WITH {PAIRS_SQL}, r AS (SELECT grp, metric, d, rank() OVER w + (count(*) OVER (PARTITION BY grp,
      metric, abs(d)) - 1) / 2.0::DOUBLE AS r FROM pr WHERE d <> 0
      WINDOW w AS (PARTITION BY grp, metric ORDER BY abs(d)))
    SELECT grp, metric, count(*) AS n_nonzero, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus,
      coalesce(sum(r) FILTER (d < 0), 0) AS w_minus,
      round((coalesce(sum(r) FILTER (d > 0), 0) - coalesce(sum(r) FILTER (d < 0), 0)) / sum(r), 6)
        + 0.0 AS effect_size FROM r GROUP BY ALL""",
)
def signed_rank(spark, path):
    d = st.pair_differences(mice(spark, path), ["grp", "metric"], "cond")
    x = st.signed_rank(d, ["grp", "metric"])
    return x.select("grp", "metric", "n_nonzero", "w_plus", "w_minus", r6("effect_size"))


@query(
    "mwu_rank_sum",
    f"""WITH {EV}, r AS (SELECT kind, {GROUPED} AS grp, rank() OVER (PARTITION BY kind ORDER BY v)
      + (count(*) OVER (PARTITION BY kind, v) - 1) / 2.0::DOUBLE AS r FROM ev),
    s AS (SELECT kind, count(*) FILTER (grp = 'control') AS n_a, count(*) FILTER (grp = 'treated') AS n_b,
      sum(r) FILTER (grp = 'control') AS rank_sum_a FROM r GROUP BY kind)
    SELECT kind, n_a, n_b, rank_sum_a, rank_sum_a - n_a * (n_a + 1) / 2 AS u,
      round(2 * (rank_sum_a - n_a * (n_a + 1) / 2) / (n_a * n_b) - 1, 6) + 0.0 AS effect_size FROM s""",
)
def mwu_rank_sum(spark, path):
    e = tb.raw_events(spark, path).withColumn("grp", tb.group())
    x = st.rank_sum(e, ["kind"], F.col("grp") == "control", value="v")
    return x.select("kind", "n_a", "n_b", "rank_sum_a", "u", r6("effect_size"))


@query(
    "holm",
    """WITH p AS (SELECT o_orderkey, o_totalprice / 500000.0 / 20000 AS p FROM orders),
    a AS (SELECT o_orderkey, p, least(1.0::DOUBLE, (count(*) OVER () - rank() OVER (ORDER BY p) + 1) * p)
      AS x FROM p)
    SELECT o_orderkey, round(max(x) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING), 13) AS p_adjusted_holm
    FROM a""",
)
def holm(spark, path):
    o = tb.read(spark, path, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 500000.0 / 20000).alias("p_value")
    )
    return st.holm(o).select("o_orderkey", F.round("p_adjusted_holm", 13).alias("p_adjusted_holm"))


@query("pairwise_tests")
def pairwise_tests(spark, path):
    x = st.pairwise_tests(mice(spark, path))
    return x.select(*[r6(f.name) if f.dataType.simpleString() == "double" else f.name for f in x.schema])


@query("pairwise_rank_tests")
def pairwise_rank_tests(spark, path):
    m = mice(spark, path)
    x = st.pairwise_tests(m, "wilcoxon").unionByName(st.pairwise_tests(m, "mannwhitney"))
    return x.select(*[r6(f.name) if f.dataType.simpleString() == "double" else f.name for f in x.schema])


@query(
    "bootstrap_interval",
    f"""WITH {METRICS_SQL}, p AS (SELECT grp, cond, metric, mouse, value, row_number() OVER (PARTITION BY grp, cond, metric
      ORDER BY mouse) - 1 AS i, count(*) OVER (PARTITION BY grp, cond, metric) AS n FROM mice),
    s AS (SELECT grp, cond, metric, b, least(CAST(floor({MD5U.format(
        label="'3|' || grp || '|' || cond || '|' || metric || '|' || b || '|' || i")} * n) AS BIGINT), n - 1) AS i
      FROM p, (SELECT unnest(range(0, 5000)) AS b)),
    m AS (SELECT grp, cond, metric, b, avg(p.value) AS m FROM s JOIN p USING (grp, cond, metric, i) GROUP BY ALL)
    SELECT grp, cond, metric, round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper,
      count(m) AS n_resamples FROM m GROUP BY ALL""",
)
def bootstrap_interval(spark, path):
    x = st.bootstrap_mean_interval(mice(spark, path), ["grp", "cond", "metric"], n_resamples=5000, seed=3)
    return x.select("grp", "cond", "metric", r6("lower"), r6("upper"), "n_resamples")


@query("mean_t_interval")
def mean_t_interval(spark, path):
    return st.mean_t_interval(mice(spark, path), ["grp", "cond", "metric"])


@query(
    "spearman",
    """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)
      + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS a,
      rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice)
      + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem)
    SELECT l_returnflag, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY 1""",
)
def spearman(spark, path):
    l = tb.read(spark, path, "lineitem")
    x = st.spearman(l, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return x.select("l_returnflag", r6("rho"), "n")


@query(
    "pearson_channel_audit",
    """WITH c AS (SELECT l_returnflag AS grp, unnest(['discount', 'quantity', 'tax']) AS channel,
      unnest([corr(l_extendedprice, l_discount), corr(l_extendedprice, l_quantity),
        corr(l_extendedprice, l_tax)]) AS r FROM lineitem GROUP BY 1)
    SELECT grp, arg_max(channel, r) AS channel, round(max(r), 6) AS r FROM c GROUP BY grp""",
)
def pearson_channel_audit(spark, path):
    l = tb.read(spark, path, "lineitem")
    long = l.selectExpr(
        "l_returnflag AS grp", "l_extendedprice AS y",
        "stack(3, 'discount', l_discount, 'quantity', l_quantity, 'tax', l_tax) AS (channel, x)",
    )
    x = ru.best_channel(ru.correlation(long, ["grp", "channel"], "y", "x"), ["grp"])
    return x.select("grp", "channel", r6("r"))


@query(
    "mad_noise",
    f"""WITH {EV}, m AS (SELECT mouse, quantile_cont(v, 0.5) AS med FROM ev GROUP BY mouse)
    SELECT mouse, round(any_value(med), 6) AS med, round(1.4826 * quantile_cont(abs(v - med), 0.5), 6) AS noise
    FROM ev JOIN m USING (mouse) GROUP BY mouse""",
)
def mad_noise(spark, path):
    x = st.mad_noise(tb.samples(spark, path), ["mouse"])
    return x.select("mouse", r6("med"), r6("noise"))


@query(
    "background_percentiles",
    """SELECT l_returnflag, round(quantile_cont(l_discount, 0.5), 6) AS median,
      round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1""",
)
def background_percentiles(spark, path):
    l = tb.read(spark, path, "lineitem")
    a = percentiles(l, ["l_returnflag"], "l_discount", {"median": 0.5}).drop("n")
    b = percentiles(l, ["l_returnflag"], "l_extendedprice", {"p95": 0.95}).drop("n")
    return a.join(b, "l_returnflag").select(
        "l_returnflag", r6("median"), F.round("p95", 4).alias("p95")
    )
