import numpy as np
import pytest
from conftest import signal, train
from pyspark.sql import functions as F

from eventide.core.series import Series
from eventide.operators import events as ev
from eventide.operators import matching as mt


def times(df, *cols):
    rows = df.orderBy(cols[0]).collect()
    return [tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols) for r in rows]


@pytest.mark.parametrize("width", [0.15, 100.0])
def test_boundary_pulses_and_width(spark, width):
    s = Series(("k",), "t", width)
    x = signal(spark, [i / 10 for i in range(8)], [5, 5, 0, 0, 5, 5, 5, 0])
    found = ev.pulses(x, s, min_width=0.25)
    assert times(found, "rise_i", "fall_i") == [(4, 7)]
    r = found.first()
    assert r.offset_t - r.onset_t == pytest.approx(0.3)
    assert times(ev.pulses(x, s), "rise_i", "fall_i") == [(0, 2), (4, 7)]


@pytest.mark.parametrize("width", [0.5, 100.0])
def test_internal_pulses(spark, width):
    s = Series(("k",), "t", width)
    x = signal(spark, range(6), [5, 0, 0, 5, 0, 5])
    assert times(ev.pulses(x, s, include_boundary=False), "rise_i", "fall_i") == [(3, 4)]
    # A pulse that starts on the last sample has no end.
    assert times(ev.pulses(x, s), "rise_i", "fall_i") == [(0, 1), (3, 4)]
    still = signal(spark, range(5), [0, 5, 5, 5, 5])
    assert times(ev.pulses(still, s), "rise_i", "fall_i") == [(1, 4)]
    assert ev.pulses(still, s, include_boundary=False).count() == 0


def test_midrange_threshold(spark, series):
    x = signal(spark, range(4), [0, 10, 4, 10])
    t = ev.midrange_threshold(x, series)
    y = x.join(t, "k")
    assert times(ev.pulses(y, series, threshold=F.col("threshold"), include_boundary=False), "rise_i", "fall_i") == [(1, 2)]


def test_merge_pulses_uses_the_offset(spark, series):
    p = spark.createDataFrame(
        [("a", 0.0, 1.0), ("a", 1.5, 2.0), ("a", 2.6, 3.0)], "k string, onset_t double, offset_t double"
    )
    assert times(ev.merge_pulses(p, series, max_gap=0.5), "onset_t", "offset_t", "n_pulses") == [(0.0, 2.0, 2), (2.6, 3.0, 1)]


@pytest.mark.parametrize("width", [0.1, 0.3, 50.0])
def test_bouts(spark, width):
    s = Series(("k",), "t", width)
    b = ev.bouts(train(spark, [0, 0.2, 0.4, 2, 2.2]), s, max_gap=0.5, min_count=3)
    assert times(b, "onset_t", "offset_t", "n", "start_i", "stop_i") == [(0.0, 0.4, 3, 0, 3)]
    # A gap of exactly the limit stays in the bout.
    b = ev.bouts(train(spark, [0, 0.5, 1.0, 1.75]), s, max_gap=0.5, min_count=1)
    assert times(b, "onset_t", "n") == [(0.0, 3), (1.75, 1)]


def test_bout_limits(spark, series):
    with pytest.raises(ValueError, match="max_gap"):
        ev.bouts(train(spark, [1]), series, max_gap=0)
    with pytest.raises(ValueError, match="min_count"):
        ev.bouts(train(spark, [1]), series, min_count=0)


def test_bout_grid_features(spark, series):
    b = ev.bouts(train(spark, [0.2, 0.4, 0.6, 2, 2.2]), series, max_gap=0.5, min_count=3)
    bounds = spark.createDataFrame([("a", 0.0, 30)], "k string, t0 double, n_bins int")
    x = ev.bout_grid_features(b, series, bounds, 0.1)
    assert [r[0] for r in times(x.filter("occupancy = 1"), "bin")] == [2, 3, 4, 5, 6]
    r = x.filter("onset_count = 1").collect()
    assert [(q.bin, round(q.duration_at_onset, 9)) for q in r] == [(2, 0.4)]


def test_trial_bout_features(spark):
    rows = [("a", k) for k in (1, 2, 3, 9)]
    x = ev.trial_bout_features(
        spark.createDataFrame(rows, "k string, s int"), ("k",), sample="s", rate_hz=10.0, max_gap=0.15,
        min_count=3, width=1.0,
    )
    got = {r.s: r for r in x.collect()}
    assert sorted(got) == [1, 2, 3]
    assert got[1].onset == 1 and got[1].size == 3 and got[2].size == 0
    assert got[3].rate == pytest.approx(3 / 0.3)


def test_signal_quality(spark):
    rows = [("flat", 0.0)] * 10 + [("ok", v) for v in (0.0, 0.1, 0.0)] + [("const", 1.0)] * 5
    q = ev.signal_quality(spark.createDataFrame(rows, "k string, v double"), ("k",))
    assert {r.k: r.status for r in q.collect()} == {"flat": "invalid_flat_zero", "ok": "valid", "const": "valid"}
    empty = spark.createDataFrame([("e", float("nan"))], "k string, v double")
    assert ev.signal_quality(empty, ("k",)).first().status == "invalid_empty"


def test_local_maxima_report_plateau_middle(spark, series):
    x = signal(spark, range(9), [0, 3, 3, 3, 0, 1, 0, 5, 0])
    assert times(ev.local_maxima(x, series), "i") == [(2,), (7,)]


@pytest.mark.parametrize("width", [3.0, 1000.0])
def test_first_after_reference(spark, width):
    s = Series(("k",), "t", width)
    m = mt.first_after_reference(train(spark, [10, 15, 30]), train(spark, [9, 12, 16, 18, 55]), s, (0, 20))
    assert times(m, "ref_i", "match_t") == [(0, 12.0), (1, 16.0)]
    m = mt.first_after_reference(train(spark, [10]), train(spark, [10.2, 11.5]), s, (1, 3))
    assert times(m, "match_t") == [(11.5,)]
    # The next reference is an exclusive bound.
    m = mt.first_after_reference(train(spark, [10, 12]), train(spark, [12]), s, (0, 20))
    assert times(m, "ref_i", "match_t") == [(1, 12.0)]


def test_cue_bounded_match(spark, series):
    end = spark.createDataFrame([("a", 70.0)], "k string, end_t double")
    args = (train(spark, [10, 30, 50]), train(spark, [12, 15, 34, 54]), train(spark, [11, 36]), series, end)
    m = mt.cue_bounded_match(*args)
    assert times(m, "cue_i", "bout_t", "latency") == [(1, 34.0, 2.0)]
    m = mt.cue_bounded_match(*args, minimum_latency=-5.0)
    assert times(m, "cue_i", "latency") == [(0, -1.0), (1, 2.0)]


def cues(spark, on, off):
    return spark.createDataFrame([("a", float(x), float(y)) for x, y in zip(on, off)], "k string, onset_t double, offset_t double")


def flags(df, col):
    return [r[col] for r in df.orderBy("onset_t").collect()]


def test_cue_classes(spark, series):
    x = mt.classify_cues(cues(spark, [0, 10], [5, 18]), train(spark, [4, 19]), series, post_window=2.0)
    assert flags(x, "cue_lick") == [True, False] and flags(x, "post_lick") == [False, True]
    assert flags(x, "cue_only") == [True, False] and flags(x, "post_only") == [False, True]


def test_cue_window_parameter(spark, series):
    c, licks = cues(spark, [0, 10], [1, 11]), train(spark, [0.5, 2.5, 10.5])
    x = mt.classify_cues(c, licks, series, post_window=1.0)
    assert flags(x, "cue_only") == [True, True]
    x = mt.classify_cues(c, licks, series, post_window=2.0)
    assert flags(x, "cue_and_post") == [True, False] and flags(x, "cue_only") == [False, True]


def test_counts_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    a, e = np.sort(rng.uniform(0, 50, 40)), np.sort(rng.uniform(0, 50, 200))
    e[:40] = a + 1.0
    e = np.unique(e)
    for width in (0.8, 1e4):
        s = Series(("k",), "t", width)
        x = mt.count_in_window(train(spark, a), train(spark, e), s, (-1.0, 1.0)).collect()
        for r in x:
            assert r.n == np.sum((e >= r.t - 1.0) & (e <= r.t + 1.0))
        y = mt.with_event_in_window(train(spark, a), train(spark, e), s, (0.2, 0.9), open_left=True)
        want = [t for t in a if np.any((e - t > 0.2) & (e - t <= 0.9))]
        assert [q[0] for q in times(y, "t")] == [round(t, 9) for t in want]


def test_delivery_stages(spark, series):
    p = ev.delivery_progress(train(spark, range(7)), series)
    assert [r.progress for r in p.orderBy("t").collect()] == pytest.approx([i / 6 for i in range(7)])
    st = ev.delivery_stage(p).orderBy("t").collect()
    assert [r.stage for r in st] == ["first", "early", "early", "middle", "middle", "late", "late"]
