"""Registered queries: peri-event extraction, event detection, matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.core.lineage import cut
from eventide.core.series import index_rows
from eventide.operators import events as ev
from eventide.operators import matching as mt
from eventide.operators import perievent as pe
from eventide.plans.psth import first_event_only, peri_event_means, trial_table
from eventide.workload import tables as tb
from eventide.workload.registry import EV, query

WINDOW = (-2 * tb.DAY, 2 * tb.DAY)
BASELINE = (-2 * tb.DAY, 0.0)
DT = 6 * tb.HOUR
BOUT_GAP = 12 * tb.HOUR


def r6(c):
    return (F.round(c, 6) + F.lit(0.0)).alias(c) if isinstance(c, str) else F.round(c, 6) + F.lit(0.0)


def purchases(spark, path):
    return tb.train(spark, path, "purchase").withColumnRenamed("event_id", "event_i")


GROUPED = "CASE WHEN mouse % 2 = 0 THEN 'control' ELSE 'treated' END"

# Trials around purchases: complete windows, linear interpolation.
TRIALS_SQL = f"""{EV},
smp AS (SELECT mouse, t, v, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM ev
        WINDOW w AS (PARTITION BY mouse ORDER BY t)),
bnd AS (SELECT mouse, min(t) AS lo, max(t) AS hi FROM ev GROUP BY mouse),
al AS (SELECT e.mouse, e.event_id AS event_i, e.t AS event_t FROM ev e JOIN bnd USING (mouse)
       WHERE e.kind = 'purchase' AND e.t - 172800.0 >= lo AND e.t + 172800.0 <= hi),
grid AS (SELECT al.*, g.lag_i, -172800.0::DOUBLE + g.lag_i * 21600.0::DOUBLE AS rel_t
         FROM al, (SELECT unnest(range(0, 17))::INTEGER AS lag_i) g),
trials AS (
  SELECT q.mouse, q.event_i, q.event_t, q.lag_i, q.rel_t,
    CASE WHEN q.event_t + q.rel_t = s.t THEN s.v
         ELSE s.v + (q.event_t + q.rel_t - s.t) * ((s.v1 - s.v) / (s.t1 - s.t)) END AS v
  FROM (SELECT *, event_t + rel_t AS qt FROM grid) q ASOF JOIN smp s
    ON q.mouse = s.mouse AND q.qt >= s.t),
sub AS (SELECT * EXCLUDE (v), v - avg(v) FILTER (rel_t < 0) OVER (PARTITION BY event_i) AS v
        FROM trials),
zs AS (SELECT * EXCLUDE (v),
        (v - avg(v) FILTER (rel_t < 0) OVER (PARTITION BY event_i))
        / nullif(stddev_samp(v) FILTER (rel_t < 0) OVER (PARTITION BY event_i), 0) AS v
       FROM trials)"""


@query(
    "peri_event_mean",
    f"""WITH {TRIALS_SQL},
    m AS (SELECT mouse, lag_i, rel_t, avg(v) AS v FROM sub GROUP BY ALL)
    SELECT {GROUPED} AS grp, lag_i, rel_t, round(avg(v), 6) + 0.0 AS mean,
           round(stddev_samp(v) / sqrt(count(v)), 6) + 0.0 AS sem, count(v) AS n_mice
    FROM m GROUP BY 1, 2, 3""",
)
def peri_event_mean(spark, path):
    out = peri_event_means(
        tb.samples(spark, path),
        purchases(spark, path).withColumn("grp", tb.group()),
        tb.series(spark, path, 17),
        session=[], mouse=["mouse"], group=["grp"],
        window=WINDOW, dt=DT, normalization="subtract", baseline=BASELINE,
    )
    return out.select("grp", "lag_i", "rel_t", r6("mean"), r6("sem"), "n_mice")


@query(
    "peri_event_strata",
    f"""WITH {TRIALS_SQL},
    k AS (SELECT *, {GROUPED} AS grp, CASE WHEN event_t < 1705363200.0 THEN 'early' ELSE 'late' END
          AS cond, CAST(floor((event_t - 1704067200.0) / 604800.0) AS BIGINT) AS session FROM zs),
    s AS (SELECT mouse, grp, cond, session, lag_i, rel_t, avg(v) AS v FROM k GROUP BY ALL),
    m AS (SELECT mouse, grp, cond, lag_i, rel_t, avg(v) AS v FROM s GROUP BY ALL)
    SELECT grp, cond, lag_i, rel_t, round(avg(v), 6) + 0.0 AS mean,
           round(stddev_samp(v) / sqrt(count(v)), 6) + 0.0 AS sem, count(v) AS n_mice
    FROM m GROUP BY ALL""",
)
def peri_event_strata(spark, path):
    events = purchases(spark, path).withColumns(
        {"grp": tb.group(), "cond": tb.condition(), "session": tb.week()}
    )
    out = peri_event_means(
        tb.samples(spark, path), events, tb.series(spark, path, 17),
        session=["session"], mouse=["mouse"], group=["grp", "cond"],
        window=WINDOW, dt=DT, normalization="zscore", baseline=BASELINE,
    )
    return out.select("grp", "cond", "lag_i", "rel_t", r6("mean"), r6("sem"), "n_mice")


def trials(spark, path):
    """Interpolated purchase trials: mouse, event_i, event_t, lag_i, rel_t, v."""
    return pe.extract(
        tb.samples(spark, path), purchases(spark, path), tb.series(spark, path, 17), WINDOW, DT
    )


@query(
    "peri_event_trials",
    f"WITH {TRIALS_SQL} SELECT mouse, event_i, lag_i, rel_t, round(v, 6) + 0.0 AS v FROM trials",
)
def peri_event_trials(spark, path):
    return trials(spark, path).select("mouse", "event_i", "lag_i", "rel_t", r6("v"))


@query(
    "peri_event_partial",
    f"""WITH {EV},
    smp AS (SELECT mouse, t, v, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM ev
            WINDOW w AS (PARTITION BY mouse ORDER BY t)),
    q AS (SELECT mouse, event_id AS event_i, lag_i, t - 172800.0 + lag_i * 21600.0 AS qt
          FROM ev, (SELECT unnest(range(0, 17))::INTEGER AS lag_i) WHERE kind = 'purchase')
    SELECT q.mouse, q.event_i, q.lag_i, round(CASE WHEN q.qt = s.t THEN s.v WHEN s.t1 IS NOT NULL
      THEN s.v + (q.qt - s.t) * ((s.v1 - s.v) / (s.t1 - s.t)) END, 6) + 0.0 AS v
    FROM q ASOF LEFT JOIN smp s ON q.mouse = s.mouse AND q.qt >= s.t""",
)
def peri_event_partial(spark, path):
    x = pe.extract(
        tb.samples(spark, path), purchases(spark, path), tb.series(spark, path, 17), WINDOW, DT,
        require_complete=False,
    )
    return x.select("mouse", "event_i", "lag_i", r6("v"))


@query(
    "baseline_zscore",
    f"""WITH {TRIALS_SQL}
    SELECT mouse, event_i, lag_i, round(v, 6) + 0.0 AS v FROM zs""",
)
def baseline_zscore(spark, path):
    z = trial_table(
        tb.samples(spark, path), purchases(spark, path), tb.series(spark, path, 17),
        window=WINDOW, dt=DT, normalization="zscore", baseline=BASELINE,
    )
    return z.select("mouse", "event_i", "lag_i", r6("v"))


@query(
    "complete_windows",
    f"""WITH {EV}, bnd AS (SELECT mouse, min(t) AS lo, max(t) AS hi FROM ev GROUP BY mouse)
    SELECT e.mouse, e.event_id AS event_i FROM ev e JOIN bnd USING (mouse)
    WHERE kind = 'purchase' AND e.t - 172800.0 >= lo AND e.t + 172800.0 <= hi""",
)
def complete_windows(spark, path):
    s = tb.series(spark, path)
    bounds = pe.recording_bounds(tb.samples(spark, path), s)
    return pe.complete_windows(purchases(spark, path), bounds, s, WINDOW).select("mouse", "event_i")


@query(
    "lag_grid_summary",
    f"""WITH {TRIALS_SQL}
    SELECT lag_i, rel_t, round(avg(v), 6) + 0.0 AS mean,
      round(stddev_samp(v) / sqrt(count(v)), 6) + 0.0 AS sem, count(v) AS n
    FROM trials GROUP BY lag_i, rel_t""",
)
def lag_grid_summary(spark, path):
    x = pe.mean_and_sem(trials(spark, path), ["lag_i", "rel_t"])
    return x.select("lag_i", "rel_t", r6("mean"), r6("sem"), "n")


@query(
    "peri_event_rate",
    f"""WITH {EV}, bnd AS (SELECT mouse, min(t) AS lo, max(t) AS hi FROM ev GROUP BY mouse),
    al AS (SELECT e.mouse, e.event_id AS event_i, e.t FROM ev e JOIN bnd USING (mouse)
           WHERE kind = 'purchase' AND e.t - 172800.0 >= lo AND e.t + 172800.0 <= hi),
    g AS (SELECT al.*, lag_i, t + (-172800.0 + lag_i * 21600.0) AS a,
                 t + (-172800.0 + (lag_i + 1) * 21600.0) AS b
          FROM al, (SELECT unnest(range(0, 16))::INTEGER AS lag_i))
    SELECT g.mouse, g.event_i, g.lag_i, round(count(c.t) / 21600.0, 12) AS v
    FROM g LEFT JOIN ev c ON c.mouse = g.mouse AND c.kind = 'click' AND c.t >= g.a
      AND (c.t < g.b OR (g.lag_i = 15 AND c.t = g.b))
    GROUP BY ALL""",
)
def peri_event_rate(spark, path):
    s = tb.series(spark, path, 17)
    x = pe.event_rate(
        tb.train(spark, path, "click"), purchases(spark, path), s, WINDOW, DT,
        bounds=pe.recording_bounds(tb.samples(spark, path), s),
    )
    return x.select("mouse", "event_i", "lag_i", F.round("v", 12).alias("v"))


@query(
    "native_samples",
    f"""WITH {EV}
    SELECT a.mouse, a.event_id AS event_i, round(x.t - a.t, 6) + 0.0 AS rel_t, x.v
    FROM ev a JOIN ev x ON a.mouse = x.mouse AND x.t - a.t BETWEEN -86400.0 AND 86400.0
    WHERE a.kind = 'purchase'""",
)
def native_samples(spark, path):
    x = pe.native_samples(
        tb.samples(spark, path), purchases(spark, path), tb.series(spark, path),
        (-tb.DAY, tb.DAY),
    )
    return x.select("mouse", "event_i", r6("rel_t"), "v")


@query(
    "first_event_only",
    f"""WITH {TRIALS_SQL}, f AS (SELECT mouse, min(t) AS t FROM ev WHERE kind = 'purchase'
      GROUP BY mouse)
    SELECT tr.mouse, tr.lag_i, round(tr.v, 6) + 0.0 AS v FROM trials tr
    JOIN f ON f.mouse = tr.mouse AND f.t = tr.event_t""",
)
def first_only(spark, path):
    s = tb.series(spark, path)
    first = first_event_only(purchases(spark, path), s)
    x = pe.extract(tb.samples(spark, path), first, s, WINDOW, DT)
    return x.select("mouse", "lag_i", r6("v"))


@query(
    "interp_join",
    f"""WITH {EV},
    smp AS (SELECT mouse, t, v, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM ev
            WHERE kind IN ('view', 'purchase') WINDOW w AS (PARTITION BY mouse ORDER BY t)),
    fst AS (SELECT mouse, arg_min(v, t) AS v FROM ev WHERE kind IN ('view', 'purchase') GROUP BY 1)
    SELECT q.mouse, q.event_id, round(CASE WHEN s.t IS NULL THEN fst.v WHEN s.t1 IS NULL THEN s.v
      ELSE s.v + (q.t - s.t) * ((s.v1 - s.v) / (s.t1 - s.t)) END, 6) + 0.0 AS ref
    FROM ev q ASOF LEFT JOIN smp s ON q.mouse = s.mouse AND q.t >= s.t
    LEFT JOIN fst ON fst.mouse = q.mouse WHERE q.kind = 'click'""",
)
def interp_join(spark, path):
    ref = tb.raw_events(spark, path).filter(F.col("kind").isin("view", "purchase"))
    x = pe.interpolate(
        tb.train(spark, path, "click"), ref, tb.series(spark, path), out="ref", clamp=True
    )
    return x.select("mouse", "event_id", r6("ref"))


@query(
    "ttl_pulses",
    f"""WITH {EV},
    x AS (SELECT mouse, t, v > 50 AS hi, row_number() OVER w - 1 AS i,
            lag(v > 50) OVER w AS was, lead(v > 50) OVER w AS nxt FROM ev
          WINDOW w AS (PARTITION BY mouse ORDER BY t)),
    e AS (SELECT *, (hi AND (was IS NULL OR NOT was)) AS rise,
            ((NOT hi AND was) OR (hi AND nxt IS NULL AND was)) AS fall FROM x),
    p AS (SELECT *, lead(t) OVER w AS off_t, lead(i) OVER w AS off_i, lead(rise) OVER w AS off_rise
          FROM e WHERE rise OR fall WINDOW w AS (PARTITION BY mouse ORDER BY t))
    SELECT mouse, t AS onset_t, off_t AS offset_t, i AS rise_i, off_i AS fall_i
    FROM p WHERE rise AND NOT off_rise AND off_t - t >= 3600.0""",
)
def ttl_pulses(spark, path):
    s = tb.series(spark, path)
    x = index_rows(tb.samples(spark, path), s)
    return ev.pulses(x, s, threshold=50.0, min_width=3600.0)


def found_pulses(spark, path, include_boundary=False):
    s = tb.series(spark, path)
    x = index_rows(tb.samples(spark, path), s)
    return cut(ev.pulses(x, s, threshold=50.0, include_boundary=include_boundary)), s


INTERNAL_PULSES = f"""{EV},
    x AS (SELECT mouse, t, v > 50 AS hi, row_number() OVER w - 1 AS i,
            lag(v > 50) OVER w AS was FROM ev WINDOW w AS (PARTITION BY mouse ORDER BY t)),
    p AS (SELECT *, lead(t) OVER w AS off_t, lead(i) OVER w AS off_i FROM x
          WHERE was IS NOT NULL AND hi <> was WINDOW w AS (PARTITION BY mouse ORDER BY t)),
    pulses AS (SELECT mouse, t AS onset_t, off_t AS offset_t, i AS rise_i, off_i AS fall_i
               FROM p WHERE hi AND off_t IS NOT NULL)"""


@query(
    "internal_pulses",
    f"WITH {INTERNAL_PULSES} SELECT * FROM pulses WHERE fall_i - rise_i BETWEEN 2 AND 6",
)
def internal_pulses(spark, path):
    s = tb.series(spark, path)
    x = index_rows(tb.samples(spark, path), s)
    return ev.pulses(
        x, s, threshold=50.0, include_boundary=False, width_in="samples", min_width=2, max_width=6
    )


@query(
    "pulse_merge",
    f"""WITH {INTERNAL_PULSES},
    n AS (SELECT *, CASE WHEN onset_t - lag(offset_t) OVER w <= 28800.0 THEN 0 ELSE 1 END AS new
          FROM pulses WINDOW w AS (PARTITION BY mouse ORDER BY onset_t)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY mouse ORDER BY onset_t) AS id FROM n)
    SELECT mouse, min(onset_t) AS onset_t, max(offset_t) AS offset_t, count(*) AS n_pulses
    FROM g GROUP BY mouse, id""",
)
def pulse_merge(spark, path):
    found, s = found_pulses(spark, path)
    return ev.merge_pulses(found, s, max_gap=8 * tb.HOUR)


BOUTS = f"""{EV},
    lk AS (SELECT mouse, t, CASE WHEN t - lag(t) OVER w <= 172800.0 THEN 0 ELSE 1 END AS new,
             row_number() OVER w AS rn FROM ev WHERE kind = 'click'
           WINDOW w AS (PARTITION BY mouse ORDER BY t)),
    bg AS (SELECT *, sum(new) OVER (PARTITION BY mouse ORDER BY t) AS id FROM lk),
    bouts AS (SELECT mouse, min(t) AS onset_t, max(t) AS offset_t, count(*) AS n,
                min(rn) - 1 AS start_i, max(rn) AS stop_i FROM bg GROUP BY mouse, id
              HAVING count(*) >= 3)"""
CLICK_GAP = 2 * tb.DAY


def click_bouts(spark, path):
    s = tb.series(spark, path)
    return ev.bouts(tb.train(spark, path, "click"), s, max_gap=CLICK_GAP, min_count=3)


@query("bouts", f"WITH {BOUTS} SELECT * FROM bouts")
def bouts(spark, path):
    return click_bouts(spark, path)


@query(
    "event_counts_grid",
    f"""WITH {EV}, b AS (SELECT mouse, min(t) AS t0,
        CAST(floor((max(t) - min(t)) / 21600.0) AS BIGINT) + 1 AS n_bins FROM ev GROUP BY mouse)
    SELECT e.mouse, CAST(floor((e.t - (t0 - 10800.0)) / 21600.0) AS BIGINT) AS bin, count(*) AS n
    FROM ev e JOIN b USING (mouse) WHERE kind = 'click' AND e.t <= t0 + (n_bins - 0.5) * 21600.0
    GROUP BY ALL""",
)
def event_counts_grid(spark, path):
    s = tb.series(spark, path)
    return ev.event_counts_on_grid(tb.train(spark, path, "click"), s, grid_bounds(spark, path), DT)


def grid_bounds(spark, path):
    """First sample and number of grid samples of every series."""
    n = F.floor((F.max("t") - F.min("t")) / DT).cast("bigint") + 1
    return tb.samples(spark, path).groupBy("mouse").agg(F.min("t").alias("t0"), n.alias("n_bins"))


@query(
    "bout_features_grid",
    f"""WITH {BOUTS}, b AS (SELECT mouse, min(t) AS t0,
        CAST(floor((max(t) - min(t)) / 21600.0) AS BIGINT) + 1 AS n_bins FROM ev GROUP BY mouse),
    c AS (SELECT mouse, onset_t, offset_t, n_bins,
        CAST(floor((onset_t - (t0 - 10800.0)) / 21600.0) AS BIGINT) AS a,
        least(CAST(floor((offset_t - (t0 - 10800.0)) / 21600.0) AS BIGINT), n_bins - 1) AS z
        FROM bouts JOIN b USING (mouse)),
    o AS (SELECT *, unnest(range(a, z + 1)) AS bin FROM c WHERE a <= n_bins - 1)
    SELECT mouse, bin, CAST(sum(CASE WHEN bin = a THEN 1 ELSE 0 END) AS BIGINT) AS onset_count,
      round(sum(CASE WHEN bin = a THEN offset_t - onset_t ELSE 0 END), 4) AS duration_at_onset,
      CAST(1 AS INTEGER) AS occupancy FROM o GROUP BY mouse, bin""",
)
def bout_features_grid(spark, path):
    s = tb.series(spark, path)
    x = ev.bout_grid_features(click_bouts(spark, path), s, grid_bounds(spark, path), DT)
    return x.withColumn("duration_at_onset", F.round("duration_at_onset", 4))


@query(
    "trial_bout_features",
    """WITH lk AS (SELECT l_orderkey AS trial, l_linenumber AS k FROM lineitem
       WHERE l_linenumber >= 0 GROUP BY ALL),
    n AS (SELECT *, CASE WHEN (k - lag(k) OVER (PARTITION BY trial ORDER BY k)) <= 1 THEN 0 ELSE 1
          END AS new FROM lk),
    g AS (SELECT *, sum(new) OVER (PARTITION BY trial ORDER BY k) AS id FROM n),
    b AS (SELECT trial, min(k) AS a, max(k) AS z, count(*) AS n FROM g GROUP BY trial, id
          HAVING count(*) >= 3),
    o AS (SELECT *, CAST(unnest(range(a, z + 1)) AS BIGINT) AS k FROM b)
    SELECT trial, k, CASE WHEN k = a THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS onset,
      CASE WHEN k = a THEN n::DOUBLE ELSE 0.0::DOUBLE END AS bout_size, 1.0::DOUBLE AS occupancy,
      round(n / ((z - a + 1) / 10.0::DOUBLE), 6) AS rate FROM o""",
)
def trial_bout_features(spark, path):
    licks = (
        tb.read(spark, path, "lineitem")
        .select(F.col("l_orderkey").alias("trial"), F.col("l_linenumber").cast("bigint").alias("k"))
        .distinct()
    )
    x = ev.trial_bout_features(
        licks, ("trial",), rate_hz=10.0, max_gap=0.15, min_count=3, width=100.0
    )
    return x.select(
        "trial", "k", "onset", F.col("size").alias("bout_size"), "occupancy",
        F.round("rate", 6).alias("rate"),
    )


@query(
    "first_after_reference",
    f"""WITH {EV}, r AS (SELECT mouse, t, row_number() OVER w - 1 AS ref_i, lead(t) OVER w AS nxt
        FROM ev WHERE kind = 'purchase' WINDOW w AS (PARTITION BY mouse ORDER BY t))
    SELECT r.mouse, r.ref_i, r.t AS ref_t, min(c.t) AS match_t FROM r JOIN ev c
      ON c.mouse = r.mouse AND c.kind = 'click' AND c.t >= r.t + 3600.0
      AND c.t < least(r.t + 432000.0, coalesce(r.nxt, 1e18))
    GROUP BY ALL""",
)
def first_after_reference(spark, path):
    return mt.first_after_reference(
        tb.train(spark, path, "purchase"), tb.train(spark, path, "click"),
        tb.series(spark, path), (tb.HOUR, 5 * tb.DAY),
    )


@query(
    "cue_bounded_match",
    f"""WITH {BOUTS.replace("HAVING count(*) >= 3", "HAVING count(*) >= 1")},
    fin AS (SELECT mouse, max(t) AS end_t FROM ev GROUP BY mouse),
    c AS (SELECT e.mouse, t, row_number() OVER w - 1 AS cue_i, coalesce(lead(t) OVER w, end_t) AS z
          FROM ev e JOIN fin USING (mouse) WHERE kind = 'view'
          WINDOW w AS (PARTITION BY e.mouse ORDER BY t)),
    b1 AS (SELECT c.mouse, c.cue_i, min(b.onset_t) AS bout_t FROM c JOIN bouts b
           ON b.mouse = c.mouse AND b.onset_t >= c.t AND b.onset_t < c.z GROUP BY ALL),
    d1 AS (SELECT c.mouse, c.cue_i, min(d.t) AS delivery_t FROM c JOIN ev d
           ON d.mouse = c.mouse AND d.kind = 'purchase' AND d.t >= c.t AND d.t < c.z GROUP BY ALL)
    SELECT c.mouse, c.cue_i, c.t AS cue_t, bout_t, delivery_t,
           round(delivery_t - bout_t, 6) + 0.0 AS latency
    FROM c JOIN b1 USING (mouse, cue_i) JOIN d1 USING (mouse, cue_i)
    WHERE delivery_t - bout_t >= 0""",
)
def cue_bounded_match(spark, path):
    s = tb.series(spark, path)
    found = ev.bouts(tb.train(spark, path, "click"), s, max_gap=CLICK_GAP, min_count=1)
    end = tb.samples(spark, path).groupBy("mouse").agg(F.max("t").alias("end_t"))
    x = mt.cue_bounded_match(
        tb.train(spark, path, "view"),
        found.withColumnRenamed("onset_t", "t"),
        tb.train(spark, path, "purchase"), s, end,
    )
    return x.withColumn("latency", r6("latency"))


@query(
    "nearest_event",
    f"""WITH {EV}, a AS (SELECT mouse, event_id, t FROM ev WHERE kind = 'purchase')
    SELECT a.mouse, a.event_id,
      min(c.t) FILTER (c.t >= a.t AND c.t - a.t <= 172800.0) AS first_t,
      max(c.t) FILTER (c.t <= a.t AND c.t - a.t >= -172800.0) AS last_t
    FROM a LEFT JOIN ev c ON c.mouse = a.mouse AND c.kind = 'click' GROUP BY ALL""",
)
def nearest_event(spark, path):
    s = tb.series(spark, path)
    clicks = tb.train(spark, path, "click")
    x = mt.first_in_window(
        tb.train(spark, path, "purchase"), clicks, s, (0.0, 2 * tb.DAY), out="first_t"
    )
    x = mt.last_in_window(x, clicks, s, (-2 * tb.DAY, 0.0), out="last_t")
    return x.select("mouse", "event_id", "first_t", "last_t")


@query(
    "count_in_window",
    f"""WITH {EV}, a AS (SELECT mouse, event_id, t FROM ev WHERE kind = 'purchase')
    SELECT a.mouse, a.event_id, count(c.t) AS n,
      round(count(c.t) / 259200.0, 12) AS rate
    FROM a LEFT JOIN ev c ON c.mouse = a.mouse AND c.kind = 'click'
      AND c.t >= a.t - 86400.0 AND c.t <= a.t + 172800.0 GROUP BY ALL""",
)
def count_in_window(spark, path):
    x = mt.count_in_window(
        tb.train(spark, path, "purchase"), tb.train(spark, path, "click"),
        tb.series(spark, path), (-tb.DAY, 2 * tb.DAY),
    )
    return x.select("mouse", "event_id", "n", F.round(F.col("n") / (3 * tb.DAY), 12).alias("rate"))


@query(
    "trial_class",
    f"""WITH {INTERNAL_PULSES},
    c AS (SELECT p.mouse, p.onset_t, p.offset_t,
      coalesce(bool_or(k.t >= p.onset_t AND k.t <= p.offset_t), false) AS cue_lick,
      coalesce(bool_or(k.t > p.offset_t AND k.t <= p.offset_t + 43200.0), false) AS post_lick
      FROM pulses p LEFT JOIN ev k ON k.mouse = p.mouse AND k.kind = 'click' GROUP BY ALL)
    SELECT *, cue_lick AND NOT post_lick AS cue_only, NOT cue_lick AND post_lick AS post_only,
      cue_lick AND post_lick AS cue_and_post, NOT cue_lick AND NOT post_lick AS cue_miss FROM c""",
)
def trial_class(spark, path):
    found, s = found_pulses(spark, path)
    return mt.classify_cues(
        found.select("mouse", "onset_t", "offset_t"), tb.train(spark, path, "click"), s,
        post_window=12 * tb.HOUR,
    )


@query(
    "lick_window_trials",
    f"""WITH {EV} SELECT a.mouse, a.event_id FROM ev a WHERE a.kind = 'purchase' AND EXISTS (
      SELECT 1 FROM ev c WHERE c.mouse = a.mouse AND c.kind = 'click'
      AND c.t - a.t > 28800.0 AND c.t - a.t <= 86400.0)""",
)
def lick_window_trials(spark, path):
    x = mt.with_event_in_window(
        tb.train(spark, path, "purchase"), tb.train(spark, path, "click"), tb.series(spark, path),
        (8 * tb.HOUR, tb.DAY), open_left=True,
    )
    return x.select("mouse", "event_id")


@query(
    "signal_qc",
    f"""WITH {EV}
    SELECT mouse, kind, count(v) AS n, min(v) AS minimum, max(v) AS maximum,
      round(max(v) - min(v), 6) AS peak_to_peak, round(stddev_pop(v), 6) AS sd, max(abs(v)) AS max_abs,
      CASE WHEN count(v) = 0 THEN 'invalid_empty' WHEN max(abs(v)) <= 1e-12 THEN 'invalid_flat_zero'
        ELSE 'valid' END AS status FROM ev GROUP BY mouse, kind""",
)
def signal_qc(spark, path):
    x = ev.signal_quality(tb.raw_events(spark, path), ("mouse", "kind"))
    return x.withColumns({"peak_to_peak": r6("peak_to_peak"), "sd": r6("sd")})


@query(
    "local_maxima",
    f"""WITH {EV},
    x AS (SELECT mouse, t, v, row_number() OVER w - 1 AS i,
            CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS new FROM ev
          WINDOW w AS (PARTITION BY mouse ORDER BY t)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY mouse ORDER BY t) AS run FROM x),
    r AS (SELECT mouse, run, min(i) AS i0, max(i) AS i1, max(v) AS v FROM g GROUP BY mouse, run),
    y AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a FROM r
          WINDOW w AS (PARTITION BY mouse ORDER BY run))
    SELECT mouse, CAST((i0 + i1) // 2 AS BIGINT) AS i, v FROM y WHERE v >= 60 AND v > b AND v > a""",
)
def local_maxima(spark, path):
    s = tb.series(spark, path)
    return ev.local_maxima(index_rows(tb.samples(spark, path), s), s, height=60.0)


@query(
    "preceding_gap",
    f"""WITH {EV}, b AS (SELECT mouse, min(t) AS lo FROM ev GROUP BY mouse)
    SELECT e.mouse, e.event_id, round(e.t - coalesce(lag(e.t) OVER (PARTITION BY e.mouse
      ORDER BY e.t), lo), 6) AS gap FROM ev e JOIN b USING (mouse) WHERE kind = 'click'""",
)
def preceding_gap(spark, path):
    s = tb.series(spark, path)
    lo = tb.samples(spark, path).groupBy("mouse").agg(F.min("t").alias("lo"))
    x = ev.preceding_gap(tb.train(spark, path, "click").join(lo, "mouse"), s, "lo")
    return x.select("mouse", "event_id", r6("gap"))


@query(
    "coverage",
    f"""WITH {EV}, b AS (SELECT mouse, min(t) AS lo, max(t) AS hi FROM ev
        WHERE kind IN ('view', 'signup') GROUP BY mouse)
    SELECT e.mouse, round(avg(CASE WHEN t BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6) AS coverage
    FROM ev e JOIN b USING (mouse) GROUP BY e.mouse""",
)
def coverage(spark, path):
    rec = tb.raw_events(spark, path).filter(F.col("kind").isin("view", "signup"))
    bounds = rec.groupBy("mouse").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    x = ev.coverage(tb.samples(spark, path), bounds, ("mouse",))
    return x.select("mouse", r6("coverage"))


@query(
    "bout_delivery",
    f"""WITH {BOUTS}
    SELECT b.mouse, b.onset_t, count(d.t) > 0 AS has_delivery,
      round(max(d.t - b.onset_t), 6) + 0.0 AS delivery_latency
    FROM bouts b LEFT JOIN ev d ON d.mouse = b.mouse AND d.kind = 'purchase'
      AND d.t >= b.onset_t - 86400.0 AND d.t <= b.onset_t + 259200.0 GROUP BY ALL""",
)
def bout_delivery(spark, path):
    x = ev.bouts_with_delivery(
        click_bouts(spark, path), tb.train(spark, path, "purchase"), tb.series(spark, path),
        (-tb.DAY, 3 * tb.DAY),
    )
    return x.select("mouse", "onset_t", "has_delivery", r6("delivery_latency"))


PROGRESS = f"""{EV}, p AS (SELECT mouse, event_id, row_number() OVER (PARTITION BY mouse ORDER BY t)
    AS k, count(*) OVER (PARTITION BY mouse) AS n_total FROM ev WHERE kind = 'purchase')"""


@query(
    "delivery_progress",
    f"""WITH {PROGRESS} SELECT mouse, event_id, k, n_total,
      CASE WHEN n_total > 1 THEN round((k - 1) / (n_total - 1), 6) ELSE 0.0 END AS progress FROM p""",
)
def delivery_progress(spark, path):
    x = ev.delivery_progress(tb.train(spark, path, "purchase"), tb.series(spark, path))
    return x.select("mouse", "event_id", F.col("ordinal").alias("k"), "n_total", r6("progress"))


@query(
    "tertile_groups",
    f"""WITH {PROGRESS} SELECT mouse, event_id, CASE WHEN k = 1 THEN 'first'
      WHEN least(3 * (k - 2) // (n_total - 1), 2) = 0 THEN 'early'
      WHEN least(3 * (k - 2) // (n_total - 1), 2) = 1 THEN 'middle' ELSE 'late' END AS stage FROM p""",
)
def tertile_groups(spark, path):
    x = ev.delivery_progress(tb.train(spark, path, "purchase"), tb.series(spark, path))
    return ev.delivery_stage(x).select("mouse", "event_id", "stage")
