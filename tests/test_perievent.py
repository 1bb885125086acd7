import numpy as np
import pytest
from conftest import signal, train
from pyspark.sql import functions as F

from eventide.core.series import Series
from eventide.operators import metrics as me
from eventide.operators import ordering as od
from eventide.operators import perievent as pe
from eventide.operators import rollup as ru


def events(spark, ts):
    return spark.createDataFrame([("a", i, float(t)) for i, t in enumerate(ts)], "k string, event_i int, t double")


@pytest.mark.parametrize("width", [0.25, 3.0, 1e5])
def test_complete_windows_interpolate(spark, width):
    s = Series(("k",), "t", width)
    t = np.arange(0, 10.05, 0.1)
    x = pe.extract(signal(spark, t, t), events(spark, [0.5, 5, 9.8]), s, (-1, 1), 0.25)
    got = x.orderBy("lag_i").collect()
    assert {r.event_i for r in got} == {1}
    np.testing.assert_allclose([r.v for r in got], 5 + np.arange(-1, 1.01, 0.25))


def test_partial_windows(spark, series):
    t = np.linspace(0, 2, 21)
    x = pe.extract(signal(spark, t, 2 * t), events(spark, [0.2, 1]), series, (-0.5, 0.5), 0.5, require_complete=False)
    rows = {(r.event_i, r.lag_i): r.v for r in x.collect()}
    assert rows[(0, 0)] is None
    assert [rows[(1, i)] for i in range(3)] == pytest.approx([1.0, 2.0, 3.0])


def test_missing_sample_spreads_to_neighbours(spark, series):
    x = signal(spark, [0, 1, 2, 3], [0, None, 2, 3])
    q = spark.createDataFrame([("a", v) for v in (0.0, 0.5, 1.5, 2.0, 2.5)], "k string, t double")
    got = [r.out for r in pe.interpolate(q, x, series, out="out").orderBy("t").collect()]
    assert got == [0.0, None, None, 2.0, 2.5]


def test_event_rate(spark, series):
    b = spark.createDataFrame([("a", 0.0, 20.0)], "k string, lo double, hi double")
    x = pe.event_rate(train(spark, [9.25, 10.25, 10.75, 19]), events(spark, [0.5, 10, 19.5]), series, (-1, 1), 0.5, bounds=b)
    rows = x.orderBy("lag_i").collect()
    assert {r.event_i for r in rows} == {1}
    assert [r.v for r in rows] == [2.0, 0.0, 2.0, 2.0]
    assert [r.rel_t for r in rows] == [-0.75, -0.25, 0.25, 0.75]


def test_event_rate_partial_and_divisible(spark, series):
    b = spark.createDataFrame([("a", 0.0, 2.0)], "k string, lo double, hi double")
    x = pe.event_rate(
        train(spark, [0.25, 1.25]), events(spark, [0.1]), series, (-0.5, 1), 0.5, bounds=b, require_complete=False
    )
    assert [r.v for r in x.orderBy("lag_i").collect()] == [None, 2.0, 0.0]
    with pytest.raises(ValueError, match="divisible"):
        pe.event_rate(train(spark, [1]), events(spark, [1]), series, (-1, 1), 0.3)


def test_last_bin_is_closed(spark, series):
    x = pe.event_rate(train(spark, [11.0]), events(spark, [10]), series, (-1, 1), 1.0)
    assert [r.v for r in x.orderBy("lag_i").collect()] == [0.0, 1.0]


def test_normalise(spark):
    rows = [(0, i, float(i - 2), v) for i, v in enumerate([1.0, 3.0, 10.0, None])]
    rows += [(1, i, float(i - 2), v) for i, v in enumerate([2.0, 2.0, 5.0, 6.0])]
    df = spark.createDataFrame(rows, "e int, lag_i int, rel_t double, v double")
    z = pe.normalise(df, ["e"], mode="zscore", baseline=(-2, 0)).orderBy("e", "lag_i").collect()
    assert [r.v for r in z[:3]] == pytest.approx([-1 / 2**0.5, 1 / 2**0.5, 8 / 2**0.5])
    assert z[3].v is None and all(r.v is None for r in z[4:])
    m = pe.normalise(df, ["e"], mode="subtract", baseline=(-2, 0)).orderBy("e", "lag_i").collect()
    assert [r.v for r in m] == [-1.0, 1.0, 8.0, None, 0.0, 0.0, 3.0, 4.0]
    with pytest.raises(ValueError):
        pe.normalise(df, ["e"], mode="other")


def test_native_samples(spark, series):
    x = pe.native_samples(signal(spark, range(10), range(10)), events(spark, [4.5]), series, (-1.5, 1.5))
    assert sorted(r.rel_t for r in x.collect()) == [-1.5, -0.5, 0.5, 1.5]


def trace(spark, ts, *vs):
    rows = [(k, float(t), None if v is None else float(v)) for k, row in enumerate(vs) for t, v in zip(ts, row)]
    return spark.createDataFrame(rows, "e int, rel_t double, v double")


def metric(spark, ts, vs, names, window=(0, 2), dt=1.0, **kw):
    x = me.response_metrics(trace(spark, ts, *vs), ["e"], window=window, dt=dt, n_lags=len(ts), metrics=names, **kw)
    return [tuple(r[n] for n in names) for r in x.orderBy("e").collect()]


def test_trace_metrics(spark):
    names = ("mean", "auc", "peak", "peak_latency", "trough")
    assert metric(spark, [-1, 0, 1, 2], [[0, 0, 1, 2]], names) == [(1.0, 2.0, 2.0, 2.0, 0.0)]


def test_lick_metrics(spark):
    names = ("lick_count", "any_lick", "first_lick_latency")
    got = metric(spark, [-1, 0, 1, 2], [[0, 0, 2, 0], [0, 0, 0, 0]], names)
    assert got == [(2.0, 1.0, 1.0), (0.0, 0.0, None)]


def test_running_metrics(spark):
    names = ("distance", "moving_fraction", "movement_onset_latency")
    (got,) = metric(spark, [-1, 0, 1, 2], [[0, 0.5, 2, 3]], names)
    assert got == (5.5, pytest.approx(2 / 3), 1.0)


def test_missing_is_not_zero(spark):
    names = ("lick_count", "any_lick", "mean", "auc", "positive_auc")
    assert metric(spark, [0, 1, 2], [[None] * 3], names) == [(None,) * 5]
    (got,) = metric(spark, [0, 1, 2], [[1, None, 3]], ("mean", "auc"))
    assert got == (2.0, None)


def test_first_extremum_wins(spark):
    (got,) = metric(spark, [0, 1, 2], [[5, 1, 5]], ("peak", "peak_latency"))
    assert got == (5.0, 0.0)


def test_smoothing_width():
    assert me.smoothing_width(0.1, 0.02, 100) == 5
    assert me.smoothing_width(0.08, 0.02, 100) == 3
    assert me.smoothing_width(9.0, 0.02, 4) == 3
    assert me.smoothing_width(0.001, 0.02, 4) == 1


def test_hierarchy_weighs_mice_equally(spark):
    rows = [("M1", "g", "c", "m", 1.0, 9), ("M1", "g", "c", "m", 3.0, 1), ("M2", "g", "c", "m", 6.0, 4)]
    s = spark.createDataFrame(rows, "mouse string, grp string, cond string, metric string, value double, n_trials int")
    m = ru.mouse_metrics(s, ["mouse", "grp", "cond", "metric"])
    assert {r.mouse: (r.value, r.n_trials) for r in m.collect()} == {"M1": (2.0, 10), "M2": (6.0, 4)}
    g = ru.group_metrics(m, ["grp", "cond", "metric"]).first()
    assert (g["mean"], g.n_mice) == (4.0, 2)


def test_roll_up_levels(spark):
    rows = [("g", "M1", "s1", 0, v) for v in (0.0, 2.0, 4.0)] + [("g", "M1", "s2", 0, 10.0), ("g", "M2", "s3", 0, 0.0)]
    df = spark.createDataFrame(rows, "grp string, mouse string, session string, lag int, v double")
    r = ru.roll_up(df, at=["lag"], session=["session"], mouse=["mouse"], group=["grp"]).first()
    assert (r["mean"], r.n_mice) == (3.0, 2)


def test_blocks_and_bins(spark):
    df = spark.range(7).select(F.lit("a").alias("k"), F.col("id").alias("i"), F.col("id").cast("double").alias("v"))
    b = ru.contiguous_blocks(df, ["k"], 3).orderBy("i").collect()
    assert [r.block for r in b] == [0, 0, 0, 1, 1, 2, 2]
    assert [r.block for r in ru.contiguous_blocks(df.filter("i < 2"), ["k"], 3).orderBy("i").collect()] == [0, 1]
    t = ru.tumbling_bins(df, ["k"], 3).orderBy("bin").collect()
    assert [r.v for r in t] == [3.0, 12.0]
    d = ru.decimate(df, ["k"], 4).orderBy("i").collect()
    assert [r.i for r in d] == list(np.linspace(0, 6, 4, dtype=int))


@pytest.mark.parametrize("n,m", [(101, 7), (50, 49), (1000, 13), (5, 9)])
def test_decimate_matches_linspace(spark, n, m):
    df = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("i"))
    got = sorted(r.i for r in ru.decimate(df, ["k"], m).collect())
    want = list(range(n)) if n <= m else sorted(set(np.linspace(0, n - 1, m).astype(int)))
    assert got == want


@pytest.fixture(scope="module")
def heatmap(spark):
    al = spark.createDataFrame([("a", i, i, float(t)) for i, t in enumerate([10, 30, 50])], "k string, event_i int, trial int, t double")
    return al


def order(df):
    return [(r.trial, r.sort_value) for r in df.orderBy("position").collect()]


def test_order_by_latency(spark, series, heatmap):
    v = od.sort_values(heatmap, series, "ensure_latency", events=train(spark, [13, 31]), window=(0, 10))
    assert order(od.order_trials(v, ["k"], "ensure_latency")) == [(1, 1.0), (0, 3.0), (2, None)]
    assert [t for t, _ in order(od.order_trials(v, ["k"], "ensure_latency", unmatched="exclude"))] == [1, 0]


def test_descending_reverses_ties(spark, heatmap):
    v = heatmap.withColumn("sort_value", F.lit(1.0)).withColumn("matched_t", F.lit(None).cast("double"))
    assert [t for t, _ in order(od.order_trials(v, ["k"], "bout_size"))] == [2, 1, 0]
    assert [t for t, _ in order(od.order_trials(v, ["k"], "event_order"))] == [0, 1, 2]


def test_order_by_bout_size(spark, series, heatmap):
    b = spark.createDataFrame([("a", 11.0, 3), ("a", 31.0, 7), ("a", 51.0, 5)], "k string, t double, n int")
    v = od.sort_values(heatmap, series, "bout_size", events=b, window=(0, 5))
    assert order(od.order_trials(v, ["k"], "bout_size")) == [(1, 7.0), (2, 5.0), (0, 3.0)]


def test_cue_to_bout(spark, series, heatmap):
    v = od.sort_values(heatmap, series, "cue_to_bout_latency", events=train(spark, [8, 28, 45]), window=(-10, 0))
    assert sorted(r.sort_value for r in v.collect()) == [2.0, 2.0, 5.0]
