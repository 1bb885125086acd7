"""Shuffle means cut out block by block against the row-per-lag path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.core import ranks
from eventide.core.series import Series, asof
from eventide.operators import halo, nulls
from eventide.operators import perievent as pe


@pytest.mark.parametrize("mode", ["none", "subtract", "zscore"])
@pytest.mark.parametrize("width", [0.5, 1000.0])
def test_means_equal_trials(spark, mode, width):
    rng = np.random.default_rng(6)
    samples, onsets = [], []
    for k in ("a", "b", "c"):
        t = np.cumsum(rng.exponential(0.3, 200))
        t[100:] += 15  # a gap longer than a window
        for i, x in enumerate(t):
            samples.append((k, float(x), None if i % 37 == 5 else float(rng.normal())))
        at = np.concatenate([rng.uniform(t[0] - 2, t[-1] + 2, 90), t[10:14], [t[0] + 2, t[-1] - 3]])
        onsets += [(k, i % 70, i, float(x)) for i, x in enumerate(at)]
    s = Series(("k",), "t", width)
    sig = spark.createDataFrame(samples, "k string, t double, v double").repartition(3)
    on = spark.createDataFrame(onsets + [("nothing", 0, 0, 5.0)], "k string, shuffle int, event_i int, t double").repartition(4)
    got = halo.by_lag(halo.shuffle_means(sig, on, s, (-2.0, 3.0), 0.5, mode=mode, baseline=(-2.0, 0.0)))
    x = pe.extract(sig, on, Series(("k",), "t", 2.0), (-2.0, 3.0), 0.5)
    x = pe.normalise(x, ["k", "shuffle", "event_i"], mode=mode, baseline=(-2.0, 0.0))
    want = {(r.k, r.shuffle, r.lag_i): r.v for r in x.groupBy("k", "shuffle", "lag_i").agg(F.avg("v").alias("v")).collect()}
    rows = {(r.k, r.shuffle, r.lag_i): r.v for r in got.collect()}
    assert rows.keys() == want.keys() and len(rows) > 500
    for key, v in want.items():
        assert rows[key] == (pytest.approx(v, abs=1e-9) if v is not None else None)


def test_no_onsets(spark):
    s = Series(("k",), "t", 1.0)
    sig = spark.createDataFrame([("a", 0.0, 1.0)], "k string, t double, v double")
    on = spark.createDataFrame([], "k string, shuffle int, t double")
    assert halo.shuffle_means(sig, on, s, (-1.0, 1.0), 0.5).count() == 0


@pytest.mark.parametrize("width", [0.5, 1000.0])
def test_group_means_and_spread(spark, width, monkeypatch):
    rng = np.random.default_rng(7)
    s = Series(("k",), "t", width)
    samples, onsets = [], []
    for k in range(4):
        t = np.cumsum(rng.exponential(0.3, 120))
        samples += [(k, float(x), None if i % 37 == 5 else float(rng.normal())) for i, x in enumerate(t)]
        onsets += [(k, k % 2, i % 70, i, float(x)) for i, x in enumerate(rng.uniform(t[0] - 2, t[-1] + 2, 200))]
    sig = spark.createDataFrame(samples, "k bigint, t double, v double").repartition(3)
    on = spark.createDataFrame(onsets, "k bigint, g int, shuffle int, event_i int, t double").repartition(4)

    def means():
        rows = halo.group_means(sig, on, s, (-2.0, 3.0), 0.5, "g", mode="subtract", baseline=(-2.0, 0.0)).collect()
        return {(r.g, r.shuffle, r.lag_i): r.v for r in rows}

    got = means()
    monkeypatch.setattr(halo, "TOGETHER", 0)
    want = means()
    assert got.keys() == want.keys() and len(got) > 500
    assert all(got[k] == (pytest.approx(v, abs=1e-9) if v is not None else None) for k, v in want.items())

    found = {(r.k, r.t): r for r in halo.trial_spread(sig, on, s, (-2.0, 3.0), 0.5, baseline=(-2.0, 0.0)).collect()}
    x = pe.extract(sig, on, Series(("k",), "t", 2.0), (-2.0, 3.0), 0.5)
    base = F.when(F.col("rel_t") < 0, F.col("v"))
    trials = x.groupBy("k", "event_t").agg(
        F.stddev_samp(base).alias("sd"), F.avg(base).alias("m"), F.max("v").alias("hi"), F.min("v").alias("lo")).collect()
    assert len(trials) == len(found) > 100
    for r in trials:
        for c in ("sd", "m", "hi", "lo"):
            assert found[r.k, r.event_t][c] == (pytest.approx(r[c], abs=1e-9) if r[c] is not None else None)


def test_random_onsets_drawn_where_their_signal_is(spark):
    """The same trials as onsets that are drawn, looked up and matched one by one."""
    rng = np.random.default_rng(8)
    signal, events, marks = [], [], []
    for key in ("a", "b", "", None, "long label of a series"):
        times = np.sort(rng.uniform(0, 60, 50))
        signal += [(key, float(t), None if rng.random() < 0.1 else float(rng.normal())) for t in times]
        events += [(key, int(i) if i % 4 else None) for i in rng.integers(-20, 10**9, 6)]
        marks += [] if key == "b" else [(key, float(t)) for t in rng.uniform(0, 60, 4)]
    events += events[:2]  # rows that come twice
    s = Series(("k",), "t", 4.0)
    samples = spark.createDataFrame(signal, "k string, t double, v double")
    own = spark.createDataFrame([(k, i, 1.0) for k, i in events], "k string, event_i bigint, t double")
    at = spark.createDataFrame(marks, "k string, t double")
    bounds = spark.createDataFrame([("a", 2.0, 57.0), ("b", 1.0, 59.0), ("", 5.0, 5.0), ("long label of a series", 3.0, 50.0)], "k string, lo double, hi double")
    window, dt, baseline = (-3.0, 3.0), 0.5, (-3.0, 0.0)
    got = halo.random_spread(samples, own, bounds, at, s, window, dt, baseline=baseline, n_shuffles=120, seed=7)
    onsets = nulls.null_onsets(own, s, bounds, n_shuffles=120, seed=7)
    spread = halo.trial_spread(samples, onsets, s, window, dt, baseline=baseline)
    x = asof(spread, at, s, back={"_b": "t"}, ahead={"_a": "t"})
    want = x.select("sd", "m", "hi", "lo", F.least(F.col("t") - F.col("_b"), F.col("_a") - F.col("t")).alias("near"))
    a, b = (df.toPandas().astype(float).sort_values(["m", "hi", "lo", "near"]).to_numpy() for df in (got, want))
    assert len(a) == len(b) > 1000 and np.isnan(a[:, 4]).any()
    np.testing.assert_allclose(a, b, rtol=1e-12)


def test_large_series_are_named(spark, monkeypatch):
    monkeypatch.setattr(halo, "EVENTS", 3)
    monkeypatch.setattr(halo, "SAMPLES", 5)
    rows = [("few", 1.0)] * 3 + [("events", 1.0)] * 4
    samples = [("few", 1.0)] * 5 + [("samples", 1.0)] * 6
    found = halo.oversized(*(spark.createDataFrame(x, "k string, t double") for x in (samples, rows)), Series(("k",), "t", 1.0))
    assert {r.k for r in found.collect()} == {"events", "samples"}


def test_percentile_between_narrow_ends(spark):
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=30_001), rng.integers(0, 3, 500).astype(float), np.array([4.0]), np.array([])):
        rows = [(i % 2 == 0, float(v)) for i, v in enumerate(values)] + [(True, None), (False, None)]
        df = spark.createDataFrame(rows, "g boolean, v double")
        found = ranks.percentile_of_few_groups(df, ["g"], "v", "m", 0.5, also=[F.count(F.lit(1)).alias("n"), F.min("v").alias("least")])
        got = {r.g: (r.n, r.least, r.m) for r in found.collect()}
        assert got.keys() == {True, False}
        for i, g in ((0, True), (1, False)):
            own = values[i::2]
            assert got[g] == ((len(own) + 1, own.min(), pytest.approx(np.quantile(own, 0.5), abs=1e-15)) if len(own) else (1, None, None))
