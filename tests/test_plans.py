import numpy as np
import pytest
from conftest import signal, train
from pyspark.sql import functions as F

from eventide.core.checks import ContractError
from eventide.core.series import Series
from eventide.functions import decay
from eventide.operators import basis as bs
from eventide.operators import glm
from eventide.plans import batch, designs
from eventide.plans import lifetime as pl
from eventide.plans import preprocessing as pre
from eventide.plans import trials as pt
from eventide.plans.psth import first_event_only, peri_event_means, stratum


def raw_session(spark):
    """500 samples at 100 Hz with interleaved light pulses and behaviour."""
    n = 500
    ch = {c: np.zeros(n) for c in ("ttl_465", "ttl_405", "sync", "licking", "visual_cue", "ensure")}
    for start in range(10, 480, 60):
        ch["ttl_465"][start: start + 8] = 5
    for start in range(20, 490, 60):
        ch["ttl_405"][start: start + 8] = 5
    for start in range(2, 490, 10):
        ch["sync"][start: start + 5] = 5
    ch["visual_cue"][100:107] = ch["visual_cue"][120:127] = 5
    ch["licking"][150:154] = ch["ensure"][200:207] = 5
    base = 2 + 0.001 * np.arange(n)
    ch["photoreceiver_1"], ch["photoreceiver_2"] = base, 2 * base
    rows = [("s1", c, i, i / 100, float(v[i])) for c, v in ch.items() for i in range(n)]
    samples = spark.createDataFrame(rows, "session_id string, channel string, i bigint, t double, v double")
    loco = spark.createDataFrame([("s1", i, float(i)) for i in range(49)], "session_id string, i bigint, v double")
    return samples, loco


def test_preprocess_session(spark):
    samples, loco = raw_session(spark)
    out = pre.preprocess_sessions(samples, loco, Series(("session_id",), "t", 0.7), edge=2)
    photo = out["photometry"].toPandas()
    assert sorted(photo.groupby("channel").size()) == [8, 8] and np.isfinite(photo.dff).all()
    assert photo[photo.channel == 1].sort_values("t").y.iloc[0] == pytest.approx(2 + 0.001 * 13.5)
    cues = out["cues"].collect()
    assert [(round(r.onset_t, 6), round(r.offset_t, 6), r.post_only) for r in cues] == [(1.0, 1.27, True)]
    assert [r.t for r in out["licks"].collect()] == [1.5] and out["bouts"].count() == 0
    assert [round(r.duration, 6) for r in out["deliveries"].collect()] == [0.07]
    run = out["locomotion"].orderBy("t").collect()
    assert len(run) == 49 and run[3].v == -3.0 and run[3].t == pytest.approx(0.32)


def test_paired_trials(spark):
    s = Series(("k",), "t", 7.0)
    t = np.arange(0, 80.05, 0.1)
    x = pt.paired_trials(
        signal(spark, t, t), train(spark, [20, 50]), train(spark, [22, 52]), train(spark, [21, 54]), s,
        window=(-5, 20), dt=0.5, normalization="subtract", baseline=(-5, 0),
    )
    rows = x.orderBy("lag_i").collect()
    assert {(r.event_i, r.latency) for r in rows} == {(1, 2.0)} and len(rows) == 51
    assert rows[10].v == pytest.approx(2.75)


def test_lick_window_trials_and_grid(spark):
    s = Series(("k",), "t", 9.0)
    t = np.arange(0, 80, 0.02)
    cues = train(spark, [10, 40]).withColumn("event_i", (F.col("t") / 30).cast("int"))
    x = pt.lick_window_trials(signal(spark, t, np.sin(t)), cues, train(spark, [17, 50.0004]), s)
    assert x.select("event_i").distinct().collect()[0][0] == 1 and x.count() == 1000
    g = {}
    for name, times in (("cue", [10, 40]), ("ensure", [18.1, 48.1]), ("lick", [17, 50.0004])):
        y = pt.event_grid(train(spark, times), cues.filter("event_i = 1"), s, (-5, 15), 0.02)
        g[name] = [r.lag_i for r in y.collect()]
    assert g == {"cue": [250], "ensure": [655], "lick": [750]}


def test_strata_and_first_event(spark, series):
    df = spark.createDataFrame([("a",), (" ",), (None,)], "g string")
    assert [r[0] for r in df.select(stratum("g")).collect()] == ["a", "all", "all"]
    assert [r.t for r in first_event_only(train(spark, [5, 3, 9]), series).collect()] == [3.0]


def test_peri_event_means_of_a_train(spark, series):
    b = spark.createDataFrame([("a", 0.0, 20.0)], "k string, lo double, hi double")
    e = train(spark, [10.0]).withColumn("event_i", F.lit(0)).withColumn("g", F.lit("x"))
    x = peri_event_means(
        train(spark, [9.25, 10.25, 10.75]), e, series, session=[], mouse=["k"], group=["g"],
        window=(-1, 1), dt=0.5, signal_kind="train", bounds=b,
    )
    assert [r["mean"] for r in x.orderBy("lag_i").collect()] == [2.0, 0.0, 2.0, 2.0]


def lagged(v, lags, w):
    out = np.zeros((v.size, w.shape[1]))
    for k, lag in enumerate(lags):
        for t in range(v.size):
            if 0 <= t - lag < v.size:
                out[t] += v[t - lag] * w[k]
    return out


def test_design_equals_dense(spark):
    rng = np.random.default_rng(0)
    v = {k: (rng.uniform(size=40) < 0.15).astype(float) for k in "ab"}
    rows = spark.createDataFrame([(k, i, float(i)) for k in "ab" for i in range(40)], "k string, i int, y double")
    ev = spark.createDataFrame([(k, i, float(x)) for k in "ab" for i, x in enumerate(v[k])], "k string, i int, v double")
    d = designs.build(spark, rows, {"lick": ev}, [designs.Term("lick", (-2.0, 4.0), 4)], ["k"], 0.5)
    b = bs.signed_lags(bs.zero_split(spark, (-2.0, 4.0), 4, 0.5), 0.5).toPandas()
    w = b.pivot(index="lag_i", columns="col", values="w")
    got = d.table.orderBy("k", "i").toPandas()
    for k in "ab":
        want = lagged(v[k], list(w.index), w.to_numpy())
        np.testing.assert_allclose(got[got.k == k][d.columns["lick"]].to_numpy(), want, atol=1e-12)
    assert d.features(["intercept", "lick"])[0] == "one" and d.penalties(["one", "lick_0"]) == [0.0, 1.0]
    with pytest.raises(ValueError, match="unknown model terms"):
        d.features(["cue"])


def test_adaptive_paired_and_ladder(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(k, i, float(rng.normal())) for k in "abc" for i in range(60)], "k string, i int, y double")
    ens = spark.createDataFrame([(k, i, 1.0) for k in "abc" for i in (5, 20, 35, 50)], "k string, i int, v double")
    d = designs.adaptive(spark, rows, ens, ens, ["k"], 1.0, lick_seconds=4, delivery_seconds=6, pre_seconds=2, lick_count=3, delivery_count=3, adaptation=True)
    assert list(d.columns) == ["drift", "lick", "ensure", "first_ensure", "ensure_linear", "ensure_quadratic"]
    base = d.table.filter("k = 'a'").orderBy("i").toPandas()
    np.testing.assert_allclose(base.first_ensure_1[:19], base.ensure_1[:19])
    assert base.first_ensure_1[25:].abs().max() == 0
    np.testing.assert_allclose(base.ensure_linear_1[38:48], 0.5 * base.ensure_1[38:48])
    stats = glm.gram(d.table, ["k"], d.features(), "y")
    x = designs.term_ladder(stats, d, {"drift": ["drift"], "lick": ["drift", "lick"]}, "k", [1.0, 10.0])
    assert x.groupBy("model").count().orderBy("model").collect()[0][1] == 3
    sub = designs.restrict(stats, d.features(), ["drift1", "lick_0"]).filter("k = 'a'").first()
    M = base[["drift1", "lick_0"]].to_numpy()
    np.testing.assert_allclose(np.reshape(sub.xtx, (2, 2)), M.T @ M)
    p = designs.paired(d, "k", "a", ["lick"], "ensure")
    assert list(p.columns) == ["intercept", "condition", "behavior", "behavior_interaction", "delivery", "delivery_interaction"]
    codes = {r.k: r.condition_code for r in p.table.select("k", "condition_code").distinct().collect()}
    assert codes == {"a": -0.5, "b": 0.5, "c": 0.5}


def test_condition_kernels(spark):
    b = bs.raised_cosine(spark, (0.0, 1.0), 3, 0.5)
    c = spark.createDataFrame([(i, 1.0, 2.0) for i in range(3)], "col int, base double, interaction double")
    r = designs.condition_kernels(c, b, []).orderBy("lag_i").collect()
    assert [(q["first"], q["second"], q["difference"]) for q in r] == [(0.0, 2.0, 2.0)] * 3
    z = spark.createDataFrame([(i, 1.0, 2.0, 4.0) for i in range(3)], "col int, base double, linear double, quadratic double")
    k = {r.progress: r.k for r in designs.progress_kernels(z, b).filter("lag_i = 0").collect()}
    assert k == {0.0: 1.0, 0.5: 3.0, 1.0: 7.0}


def test_two_stage(spark):
    rows = spark.createDataFrame([(1.0, float(a), float(b), 2.0 * a + 3.0 * b) for a in range(5) for b in (0, 0, 1)], "one double, a double, b double, y double")
    r = glm.two_stage(rows, ["a"], ["b"], "y", first_rows=F.col("b") == 0).first()
    np.testing.assert_allclose([*r.b_first, *r.b_second], [2.0, 3.0])


def test_fixed_effects(spark):
    rows = [(f"m{i % 4}", "g0" if i % 4 < 2 else "g1", "dry" if i < 8 else "wet", float(i % 4) + (5.0 if i >= 8 else 0)) for i in range(16)]
    df = spark.createDataFrame(rows, "mouse string, grp string, cond string, y double")
    got = {r.term: r for r in glm.fixed_effects(df, "y", ["mouse", "grp", "cond"]).collect()}
    assert got["cond"].partial_r2 == pytest.approx(1.0) and not got["cond"].aliased
    assert got["grp"].aliased and got["mouse"].r2 == pytest.approx(1.0)


def test_calibrate_and_apply(spark):
    times = [round(0.1 * k, 6) for k in range(4, 124)]
    rows, truth = [], [(1000, 3000, 1.0), (2500, 1500, 1.05), (600, 4200, 0.95)]
    for n, (a, b, t0) in enumerate(truth):
        B = decay.component_basis(times, (0.6, 2.0), t0, 0.15, 12.5)
        rows += [(f"s{n}", i, [float(v) for v in B @ [a, b]]) for i in range(4)]
    df = spark.createDataFrame(rows, "session string, i int, counts array<double>")
    c, quality = pl.calibrate(df, "session", times, lifetimes=(0.5, 2.4), sigma=0.16)
    assert c["lifetimes"][1] == pytest.approx(2.0, abs=0.15) and c["t0"] == pytest.approx(1.0, abs=0.05)
    assert quality.filter("t0_offset").count() == 0
    x = pl.apply_calibration(df, {**c, "lifetimes": [0.6, 2.0], "t0": 1.0, "irf_sigma": 0.15}, times, period=12.5)
    r = x.filter("session = 's0'").first()
    np.testing.assert_allclose(r.components, [1000, 3000], rtol=1e-6)
    for change, message in (({"success": False}, "succeed"), ({"pulse_interval": 12.6}, "0.1 %"), ({"lifetime_time": [1.0]}, "bins")):
        with pytest.raises(ContractError, match=message):
            pl.apply_calibration(df, {**c, **change}, times, period=12.5)


def test_batch(spark, tmp_path):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "session_id string")
    done = spark.createDataFrame([("c",)], "session_id string")

    def work(item):
        if item["session_id"] == "b":
            raise ValueError("broken")

    out = batch.run_batch(items, work, done=done, keys=["session_id"], continue_on_error=True)
    assert {r.session_id: r.status for r in out.collect()} == {"a": "processed", "b": "failed", "c": "skipped"}
    with pytest.raises(ContractError, match="broken"):
        batch.run_batch(items, work, keys=["session_id"])

