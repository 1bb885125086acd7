import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.core.checks import ContractError
from eventide.core.series import Series
from eventide.functions import decay
from eventide.functions.solvers import nnls_small
from eventide.operators import align as al
from eventide.operators import basis as bs
from eventide.operators import folds as fo
from eventide.operators import forecast as fc
from eventide.operators import glm
from eventide.operators import lifetime as lt
from eventide.operators import preprocess as pp
from eventide.operators import transfer as tr
from conftest import signal, train


# ------------------------------------------------------------ clocks


def test_clock_fit(spark, series):
    src = np.arange(20) / 5
    m = al.positional_matches(train(spark, src), train(spark, 0.25 + 1.00002 * src), series)
    r = al.clock_fit(m, ["k"]).first()
    assert r.n == 20 and r.drift_ppm == pytest.approx(20, abs=1e-6) and r.rms < 1e-12
    assert r.intercept == pytest.approx(0.25)
    al.require_fit(al.clock_fit(m, ["k"]), 0.2, max_rms_fraction=0.1, max_abs_drift_ppm=100)
    with pytest.raises(ContractError):
        al.require_fit(al.clock_fit(m, ["k"]), 0.2, max_abs_drift_ppm=10)


def test_ordinal_match_with_missing_and_duplicate(spark):
    s = Series(("k",), "t", 1.5)
    full = np.arange(20) / 5
    src, tgt = train(spark, np.delete(full, 8)), train(spark, full + 3.0)
    p = al.median_interval(tgt, s)
    m = al.ordinal_matches(src, tgt, s, al.median_interval(src, s), p)
    assert m.count() == 19
    assert [r.target_i for r in al.unmatched(tgt, m, s, "target_i").collect()] == [8]
    dup = train(spark, sorted([*full, full[5] + 0.02]))
    m = al.ordinal_matches(dup, tgt, s, p, p)
    assert m.count() == 20
    assert [r.source_i for r in al.unmatched(dup, m, s, "source_i").collect()] == [6]
    odd = al.pulse_ordinals(train(spark, [0, 0.2, 0.4, 0.7001]), s, p)
    assert odd.filter("NOT explained").count() == 1
    assert al.long_gaps(src, s, p).count() == 1


# ------------------------------------------------------------ preprocessing


def test_demultiplex(spark, series):
    x = signal(spark, np.arange(40) / 10, np.r_[np.zeros(10), [9, 9, 1, 2, 6, 9, 9], np.zeros(23)])
    p = spark.createDataFrame([("a", 10, 17)], "k string, rise_i bigint, fall_i bigint")
    r = pp.demultiplex(x, p, series, edge=2).first()
    assert r.v == 2.0 and r.t == pytest.approx(1.3)
    assert pp.too_short(p, 4).count() == 1 and pp.too_short(p, 3).count() == 0


def test_pulse_clock(spark, series):
    x = signal(spark, range(100), np.arange(100.0))
    got = pp.pulse_clock(x, train(spark, np.arange(100) / 10), series)
    assert [r.v for r in got.orderBy("pulse_i").limit(3).collect()] == [0.0, -1.0, -2.0] and got.count() == 100
    near = pp.pulse_clock(x, train(spark, np.arange(101) / 10), series, invert=False).orderBy("t").collect()
    np.testing.assert_allclose([r.v for r in near], np.interp(np.linspace(0, 1, 101), np.linspace(0, 1, 100), np.arange(100)), atol=1e-9)
    with pytest.raises(ContractError, match="mismatch"):
        pp.pulse_clock(x, train(spark, range(90)), series)


def test_robust_fit_small_and_large_agree(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in "ab":
        x = rng.uniform(1, 3, 60)
        y = 0.5 + 2 * x + rng.normal(0, 0.05, 60)
        y[:9] += 3
        rows += [(k, float(u), float(v)) for u, v in zip(x, y)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    small = {r.k: (r.b0, r.b1) for r in pp.robust_fit(df, ["k"]).collect()}
    large = {r.k: (r.b0, r.b1) for r in pp.robust_fit(df.filter("k = 'a'"), ["k"], rows_per_task=10, max_iter=6).collect()}
    ref = pp._fit_small(*[np.array([r[i] for r in rows if r[0] == "a"]) for i in (1, 2)], 1.4, 6, 1e-8)
    np.testing.assert_allclose(large["a"], ref, rtol=1e-9)
    for b0, b1 in small.values():
        assert b1 == pytest.approx(2.0, abs=0.1)
    z = pp.delta_f_over_f(df, pp.robust_fit(df, ["k"]), ["k"])
    assert z.filter("dff IS NULL").count() == 0 and pp.fit_quality(z, ["k"]).count() == 2


def test_robust_fit_large_sessions_stay_few_passes(spark, monkeypatch):
    """Ties, outliers and more keys; ranks never go through a distribution of all residuals."""
    rng = np.random.default_rng(8)
    rows = []
    for k in (None, "a", "b"):
        x = rng.integers(1, 5, 400).astype(float)
        y = np.round(3 - 2 * x + rng.normal(0, 0.2, 400), 1)
        y[:40] *= 1e6
        rows += [(k, 1, float(u), float(v)) for u, v in zip(x, y)] + [(k, 1, 2.0, None)]
    df = spark.createDataFrame(rows, "k string, m int, x double, y double").repartition(3)
    monkeypatch.setattr(pp, "percentiles", None)
    monkeypatch.setattr(pp, "_CHUNK", 50)
    monkeypatch.setattr(pp, "_RANKED", 5)
    got = {r.k: (r.b0, r.b1) for r in pp.robust_fit(df, ["k", "m"], rows_per_task=10, max_iter=4).collect()}
    # The join with the sizes leaves out the missing key, as it does for small sessions.
    for k in "ab":
        ref = pp._fit_small(*[np.array([r[i] for r in rows if r[0] == k and r[3] is not None]) for i in (2, 3)], 1.4, 4, 1e-8)
        np.testing.assert_allclose(got[k], ref, rtol=1e-9)


# ------------------------------------------------------------ bases and designs


def test_raised_cosine(spark):
    b = bs.raised_cosine(spark, (0.0, 1.0), 3, 0.25).toPandas().pivot(index="lag_i", columns="col", values="w")
    assert b.shape == (5, 3)
    np.testing.assert_allclose(b[1], [0, 0.5, 1, 0.5, 0], atol=1e-12)
    np.testing.assert_allclose(b.sum(axis=1), 1.0)


def test_zero_split(spark):
    b = bs.zero_split(spark, (-1.0, 2.0), 6, 0.1).toPandas()
    pre, post = b[b.col < 2], b[b.col >= 2]
    assert (pre[pre.lag_t >= 0].w == 0).all() and (post[post.lag_t <= 0].w == 0).all()
    assert post.groupby("col").w.max().min() > 0.5
    with pytest.raises(ValueError):
        bs.zero_split(spark, (-1.0, 2.0), 1, 0.1)


def test_apply_basis_signs(spark):
    v = np.array([0, 1.0, 0, 0, 2.0, 0])
    ev = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "k string, i int, v double")
    w = {-1: 0.5, 0: 1.0, 2: 3.0}
    basis = spark.createDataFrame([(l, 0, x) for l, x in w.items()], "lag_i int, col int, w double")
    n = spark.createDataFrame([("a", 6)], "k string, n int")
    for predictor in (False, True):
        x = bs.apply_basis(ev, basis, ["k"], n, (-1, 2), predictor=predictor).collect()
        got = np.zeros(6)
        for r in x:
            got[r.i] = r.x
        sign = 1 if predictor else -1
        want = [sum(c * v[t + sign * l] for l, c in w.items() if 0 <= t + sign * l < 6) for t in range(6)]
        np.testing.assert_allclose(got, want)


def test_lag_columns_equal_window(spark):
    df = spark.range(45).select(F.lit("a").alias("k"), F.col("id").alias("i"), (F.col("id") * F.col("id")).cast("double").alias("x"))
    got = bs.lag_columns(df, Series(("k",), "i", 7.0), {"x": [0, 3, -2]}, leads={"y": ("x", 4)}, sums={"s": ("x", 1, 3)})
    rows = {r.i: r for r in got.collect()}
    sq = [float(i * i) for i in range(45)]
    for i in range(45):
        r = rows[i]
        assert r.x_lag0 == sq[i] and r.x_lag3 == (sq[i - 3] if i >= 3 else None)
        assert r.x_lead2 == (sq[i + 2] if i + 2 < 45 else None) and r.y == (sq[i + 4] if i + 4 < 45 else None)
        assert r.s == (sum(sq[i + 1 : i + 4]) if i + 3 < 45 else None)


def test_blocked_folds_keep_the_gap(spark):
    sizes = spark.createDataFrame([("a", 20)], "k string, n bigint")
    for r in fo.blocked_folds(sizes, ["k"], 4, gap=2).collect():
        train_rows = [i for i in range(20) if i < r.train_before or i >= r.train_after]
        assert min(abs(i - j) for i in train_rows for j in range(r.test_start, r.test_stop)) > 2


def test_forward_folds_use_the_past(spark):
    rows = spark.range(40).select(F.lit("a").alias("k"), F.col("id").alias("i"), (F.col("id") * 0.5).alias("t"))
    sizes = spark.createDataFrame([("a", 40)], "k string, n bigint")
    x = fo.assign_forward(rows, fo.forward_folds(sizes, ["k"], n_folds=3), ["k"], gap=1.0).toPandas()
    tests = []
    for _, g in x.groupby("fold"):
        te, trn = g[g.role == "test"], g[g.role == "train"]
        assert trn.t.max() < te.t.min() - 1.0
        tests.append(len(te))
    assert tests == [7, 7, 6]


# ------------------------------------------------------------ ridge and forecasts


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(11)
    X = rng.normal(size=(240, 3))
    y = X @ [1.0, -2.0, 0.5] + 0.3 + rng.normal(0, 0.4, 240)
    g = np.repeat(np.arange(6), 40)
    rows = [(int(k), 1.0, *map(float, r), float(v)) for k, r, v in zip(g, X, y)]
    return np.column_stack((np.ones(240), X)), y, g, spark.createDataFrame(rows, "g int, one double, a double, b double, c double, y double")


COLS = ["one", "a", "b", "c"]


def test_gram_and_ridge(regression):
    X, y, g, df = regression
    st = glm.gram(df, [], COLS, "y")
    b = np.array(glm.ridge(st, [], 2.0).first().b)
    np.testing.assert_allclose(b, np.linalg.solve(X.T @ X + 2 * np.eye(4), X.T @ y))
    # The wide path (partial products) gives the same statistics.
    wide = df.select("g", "y", *COLS, *[F.col("a").alias(f"z{i}") for i in range(20)])
    w = glm.gram(wide, ["g"], COLS + [f"z{i}" for i in range(20)], "y").filter("g = 2").first()
    np.testing.assert_allclose(np.reshape(w.xtx, (24, 24))[:4, :4], X[g == 2].T @ X[g == 2])
    assert w.n == 40 and w.yty == pytest.approx(y[g == 2] @ y[g == 2])


def numpy_cv(X, y, g, alphas):
    scale = np.sqrt((X**2).mean(0))
    Z = X / scale
    scores = np.empty((len(alphas), 6))
    for h in range(6):
        tr, te = g != h, g == h
        for i, a in enumerate(alphas):
            b = np.linalg.solve(Z[tr].T @ Z[tr] + a * np.eye(4), Z[tr].T @ y[tr])
            scores[i, h] = 1 - ((y[te] - Z[te] @ b) ** 2).sum() / ((y[te] - y[te].mean()) ** 2).sum()
    a = alphas[int(scores.mean(1).argmax())]
    return scores, a, np.linalg.solve(Z.T @ Z + a * np.eye(4), Z.T @ y) / scale


def test_grouped_cv_equals_rows(regression):
    X, y, g, df = regression
    alphas = [0.01, 1.0, 100.0]
    folds, final = glm.grouped_ridge_cv(glm.gram(df, ["g"], COLS, "y"), "g", alphas)
    scores, best, b = numpy_cv(X, y, g, alphas)
    for r in folds.collect():
        assert r.r2 == pytest.approx(scores[alphas.index(r.alpha), r.g])
    f = final.first()
    assert f.alpha == best
    np.testing.assert_allclose(f.b, b)


def test_nested_and_held_out(regression):
    X, y, g, df = regression
    st = glm.gram(df, ["g"], COLS, "y")
    x = glm.nested_ridge_cv(st, [], "g", [0.1, 10.0]).collect()
    assert len(x) == 6 and all(r.r2 > 0.8 for r in x) and len({r.pooled_r2 for r in x}) == 1
    few = {r.g: (r.alpha, r.r2) for r in glm.held_out_sessions(st, "g", [0.1, 10.0]).collect()}
    assert all(few[r.g][1] == pytest.approx(r.r2, abs=1e-3) for r in x)


def plain_nested(X, y, g, alphas, pen, scale_inner):
    """Every model fitted on rows: per group the chosen penalty, its held-out R2 and SSE."""
    def rms(rows):
        return np.sqrt((X[rows] ** 2).mean(0))

    def fit(rows, scale, a):
        Z = X[rows] / scale
        return np.linalg.solve(Z.T @ Z + a * np.diag(pen), Z.T @ y[rows]) / scale

    def r2(b, rows):
        sse = ((y[rows] - X[rows] @ b) ** 2).sum()
        return 1 - sse / ((y[rows] - y[rows].mean()) ** 2).sum(), sse

    out = {}
    for o in np.unique(g):
        rest = g != o
        means = []
        for a in alphas:
            inner = [rest & (g != h) for h in np.unique(g) if h != o]
            means.append(np.mean([r2(fit(t, rms(t if scale_inner else rest), a), rest & ~t)[0] for t in inner]))
        a = alphas[int(np.argmax(means))]
        out[int(o)] = (a, *r2(fit(rest, rms(rest), a), ~rest))
    return out


@pytest.fixture(scope="module")
def many_units(spark):
    rng = np.random.default_rng(12)
    n, units = 1400, 70
    X = np.column_stack([np.ones(n), rng.normal(size=(n, 2)) * [1, 20]])
    g, model = rng.integers(units, size=n), rng.integers(2, size=n)
    y = X @ [1.0, 0.5, 0.02] + rng.normal(size=n) + 0.3 * g / units
    rows = [(*map(float, X[i]), float(y[i]), int(g[i]), None if model[i] else "m") for i in range(n)]
    return X, y, g, model, spark.createDataFrame(rows, "a double, b double, c double, y double, g int, model string")


@pytest.mark.parametrize("scale_inner", [False, True])
def test_nested_cv_of_many_blocks_equals_rows(many_units, scale_inner):
    X, y, g, model, df = many_units
    alphas, pen = [0.1, 30.0, 300.0], [0.0, 1.0, 1.0]
    st = glm.gram(df, ["model", "g"], ["a", "b", "c"], "y")
    got = glm.nested_ridge_cv(st, ["model"], "g", alphas, penalize=pen, scale_inner=scale_inner).collect()
    for m, name in ((0, "m"), (1, None)):
        own = model == m
        want = plain_nested(X[own], y[own], g[own], alphas, pen, scale_inner)
        rows = {r.g: r for r in got if r.model == name}
        assert rows.keys() == want.keys()
        pooled = 1 - sum(w[2] for w in want.values()) / ((y[own] - y[own].mean()) ** 2).sum()
        for k, (a, r2, _) in want.items():
            assert rows[k].alpha == a and rows[k].r2 == pytest.approx(r2) and rows[k].pooled_r2 == pytest.approx(pooled)


def test_nested_scores_have_their_columns(spark):
    rows = [(float(i % 7), float(i % 7 + i % 2), i % 4, i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "a double, y double, g int, m int")
    st = glm.gram(df, ["m", "g"], ["a"], "y")
    x = glm.nested_ridge_cv(st, ["m"], "g", [0.1, 1.0])
    assert x.columns == ["m", "g", "alpha", "r2", "pooled_r2"] and dict(x.dtypes)["r2"] == "double"
    assert x.count() == 4 and {r.alpha for r in x.collect()} <= {0.1, 1.0}
    held = glm.held_out_sessions(glm.gram(df, ["g"], ["a"], "y"), "g", [0.1, 1.0])
    assert held.columns == ["g", "alpha", "r2"] and held.count() == 4


def test_one_unit_has_no_inner_folds(spark):
    df = spark.createDataFrame([(1.0, float(i), 1) for i in range(5)], "a double, y double, g int")
    assert len(glm.nested_ridge_cv(glm.gram(df, ["g"], ["a"], "y"), [], "g", [0.1, 1.0]).collect()) == 1


def test_wide_and_narrow_statistics_agree(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(300, 11))
    names = [f"x{i}" for i in range(10)]
    df = spark.createDataFrame([(i % 3, *map(float, r)) for i, r in enumerate(X)], "g int, " + ", ".join(f"{c} double" for c in [*names, "y"]))
    wide = {r.g: r for r in glm.gram(df, ["g"], names, "y").collect()}
    narrow = {r.g: r for r in glm.gram(df, ["g"], names[:4], "y").collect()}
    for k in range(3):
        z = X[np.arange(300) % 3 == k]
        np.testing.assert_allclose(np.reshape(wide[k].xtx, (10, 10)), z[:, :10].T @ z[:, :10])
        np.testing.assert_allclose(np.reshape(narrow[k].xtx, (4, 4)), z[:, :4].T @ z[:, :4])
        np.testing.assert_allclose(narrow[k].xty, z[:, :4].T @ z[:, 10])
        assert narrow[k].n == wide[k].n == 100 and narrow[k].sy == pytest.approx(wide[k].sy)


def test_session_ridge_equals_rows(regression):
    X, y, g, df = regression
    cols = {"history_only": ["a"], "cross_modal": ["b", "c"], "combined": ["a", "b", "c"]}
    got = [{(r.g, r.model): (r.alpha, r.r2) for r in fc.session_ridge(df, "g", cols, alphas=(0.1, 10.0)).collect()}]
    assert len(got[0]) == 24
    tr, te, pick = g != 3, g == 3, [1, 2, 3]
    a = got[0][(3, "combined")][0]
    m, sd = X[tr][:, pick].mean(0), X[tr][:, pick].std(0)
    Z, my = (X[:, pick] - m) / sd, y[tr].mean()
    b = np.linalg.solve(Z[tr].T @ Z[tr] + a * np.eye(3), Z[tr].T @ (y[tr] - my))
    want = 1 - ((y[te] - my - Z[te] @ b) ** 2).sum() / ((y[te] - y[te].mean()) ** 2).sum()
    assert got[0][(3, "combined")][1] == pytest.approx(want)


def test_forward_ridge_recovers_history(spark):
    rng = np.random.default_rng(17)
    n = 160
    p = np.zeros(n)
    for i in range(1, n):
        p[i] = 0.9 * p[i - 1] + rng.normal(0, 0.1)
    rows = [("s1", i, i * 0.5, float(p[i]), float(rng.normal())) for i in range(n)]
    sig = spark.createDataFrame(rows, "k string, i bigint, t double, photometry double, locomotion double")
    x, names = fc.feature_table(sig, Series(("k",), "i", 50.0), horizon=0.5, history=1.0, lag_step=0.5, dt=0.5, predictors=("photometry", "locomotion"))
    x = x.withColumn("i", F.col("i") - 2)
    cols = fc.model_columns(names, "photometry")
    out = fc.forward_ridge(x, ["k"], cols, n_folds=2, n_inner=2, gap=2.0).toPandas()
    assert set(out.model) == set(fc.MODELS) and len(out) == 8
    mean = out.groupby("model").r2.mean()
    assert mean["history_only"] > 0.3 > mean["cross_modal"]


def test_zero_horizon_drops_own_present(spark):
    sig = spark.range(30).select(F.lit("a").alias("k"), F.col("id").alias("i"), F.col("id").cast("double").alias("t"), F.rand(1).alias("photometry"), F.rand(2).alias("licking"))
    _, names = fc.feature_table(sig, Series(("k",), "i", 50.0), horizon=0, history=2, lag_step=1, dt=1.0, predictors=("photometry", "licking"))
    assert names == {"photometry": ["photometry_lag1", "photometry_lag2"], "licking": ["licking_lag0", "licking_lag1", "licking_lag2"]}


def test_penalised_models(spark):
    rng = np.random.default_rng(23)
    X = rng.normal(size=(400, 2)) * [2.0, 0.5] + [1.0, 0.0]
    eta = 0.6 * X[:, 0] - 1.5 * X[:, 1] - 0.4
    lo, po = (rng.uniform(size=400) < 1 / (1 + np.exp(-eta))).astype(float), rng.poisson(np.exp(0.3 * eta)).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(a), float(b)) for r, a, b in zip(X, lo, po)], "a double, b double, lo double, po double")
    for family, y, alpha in (("logistic", "lo", 2.0), ("poisson", "po", 0.01)):
        fit = fc.fit_penalised(df, ["a", "b"], y, family, alpha)
        m, sd = X.mean(0), X.std(0)
        Z = np.column_stack((np.ones(400), (X - m) / sd))
        w = np.array([fit["a"] * sd[0], fit["b"] * sd[1]])
        b = np.r_[fit["intercept"] + fit["a"] * m[0] + fit["b"] * m[1], w]
        t = lo if family == "logistic" else po
        mu = 1 / (1 + np.exp(-Z @ b)) if family == "logistic" else np.exp(Z @ b)
        grad = Z.T @ (mu - t) + np.r_[0, w] * (alpha if family == "logistic" else alpha * 400)
        assert np.abs(grad).max() < 1e-4
    assert fc.fit_penalised(df.withColumn("lo", F.lit(1.0)), ["a"], "lo", "logistic", 1.0) is None


def test_uniform_grid(spark):
    b = spark.createDataFrame([("a", 1.0, 25), ("b", 5.0, 3)], "k string, t0 double, n bigint")
    x = fc.uniform_grid(b, ["k"], 0.5, piece=10).toPandas()
    assert x.sort_values("i").groupby("k").i.apply(list).to_dict() == {"a": list(range(25)), "b": [0, 1, 2]}
    assert x[(x.k == "a") & (x.i == 24)].t.iloc[0] == 13.0


# ------------------------------------------------------------ lifetimes

TIMES = np.linspace(0.4, 12.3, 120)
SHAPE = dict(lifetimes=(0.5, 1.8), t0=1.0, sigma=0.15, period=12.5)


def curve_frame(spark, rows, counts="counts"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], f"i int, {counts} array<double>")


def test_mpet(spark):
    df = curve_frame(spark, [[0, 1, 3], [1, 1, 2]])
    x = df.select("i", lt.mpet("counts", F.array(*map(F.lit, [0.0, 1.0, 2.0])), window=(0, 2), t0=0.5).alias("m")).orderBy("i").collect()
    assert [r.m for r in x] == [1.25, 0.75]


def test_no_background_is_identity(spark):
    df = curve_frame(spark, np.arange(12.0).reshape(4, 3))
    x = lt.correct(df, dead_time=25e-9, sampling_frequency=10.0)
    assert all(r.corrected == r.counts for r in x.collect())


def test_correction_formula(spark):
    c, bg, dt, fs, ratio = np.array([5.0, 9.0, 2.0]), np.array([1.0, 0.5, 0.25]), 1e-3, 10.0, 0.03
    true = bg / (1 - bg.sum() * fs * dt)
    eff = 1 - c.sum() * fs * dt
    want = c - true * eff - (c.sum() * fs - true.sum() * eff * fs) * ratio / (fs * 3)
    x = lt.correct(curve_frame(spark, [c]), background=F.array(*map(F.lit, map(float, bg))), dead_time=dt, sampling_frequency=fs, afterpulse_ratio=ratio)
    np.testing.assert_allclose(x.first().corrected, want)


def test_bin_curves(spark):
    df = curve_frame(spark, np.arange(14.0).reshape(2, 7).T)
    x = lt.bin_curves(df, [], 3).orderBy("bin", "group_i").collect()
    assert [r.c for r in x] == [3.0, 12.0, 24.0, 33.0]


def test_moment_lifetime(spark):
    t = np.arange(200) * 0.1
    irf, w = np.exp(-0.5 * ((t - 2) / 0.1) ** 2), np.where(t >= 2, np.exp(-(t - 2) / 1.5), 0)
    df = spark.createDataFrame([([*map(float, w)], [*map(float, irf)])], "w array<double>, h array<double>")
    x = lt.moment_lifetime(df, "w", "h", lt.bin_times(F.size("w"), 0.1)).first()
    assert x.lifetime == pytest.approx(1.45, abs=0.1)


@pytest.mark.parametrize("background", [False, True])
def test_target_fit_recovers_counts(spark, background):
    truth = np.array([[1000, 3000], [2500, 1500]], float)
    B = decay.component_basis(TIMES, (0.5, 1.8), 1.0, 0.15, 12.5)
    flat = np.array([600.0, 240.0]) if background else np.zeros(2)
    rows = truth @ B.T + flat[:, None] / TIMES.size + (0 if background else 12)
    x = lt.fit_target(curve_frame(spark, rows), times=TIMES, fit_background=background, residual_background=0 if background else 12.0, **SHAPE)
    got = x.orderBy("i").collect()
    np.testing.assert_allclose([r.components for r in got], truth, rtol=1e-8)
    np.testing.assert_allclose([r.background_counts for r in got], flat, rtol=1e-6)
    s = lt.component_summaries(x, times=TIMES, **SHAPE).orderBy("i").first()
    assert s.intensity_weighted_lifetime == pytest.approx((1000 * 0.5 + 3000 * 1.8) / 4000)


def test_nnls_is_exact():
    rng = np.random.default_rng(0)
    A, B = rng.normal(size=(30, 3)), rng.normal(size=(30, 50))
    X = nnls_small(A, B)
    G = A.T @ (A @ X.T - B)
    assert (X >= 0).all() and (G > -1e-9).all() and np.abs(G * X.T).max() < 1e-8


def test_decay_and_irf_fits(spark):
    y = 4000 * decay.periodic_exgaussian(TIMES, 2.1, 1.2, 0.15, 12.5) + 5
    r = lt.fit_decays(curve_frame(spark, [y]), times=TIMES).first().fit
    assert r.lifetimes[0] == pytest.approx(2.1, rel=1e-3) and r.t0 == pytest.approx(1.2, abs=1e-2)
    t = np.arange(256) * 0.1
    irf = np.exp(-0.5 * ((t - 3) / 0.3) ** 2)
    w = 80 * decay.convolve_irf(t, irf, 2.6, 0.4) + 2
    df = spark.createDataFrame([([*map(float, w)], [*map(float, irf)])], "w array<double>, h array<double>")
    f = lt.fit_irf(df, times=t, waveform="w", irf="h").first().fit
    assert f.tau == pytest.approx(2.6, rel=1e-2) and f.r_square > 0.9999


def test_global_fit(spark):
    rows = []
    for a, b, t0 in ((1000, 3000, 1.0), (2500, 1500, 1.1), (500, 4000, 0.9)):
        B = decay.component_basis(TIMES, (0.6, 2.0), t0, 0.15, 12.5)
        y = B @ [a, b]
        rows.append(y / y.sum())
    final, p = lt.fit_global(curve_frame(spark, rows), times=TIMES, recording="i", lifetimes=(0.5, 2.4), include_background=False, rounds=30)
    assert p["tau_long"] == pytest.approx(2.0, abs=0.1) and p["tau_short"] == pytest.approx(0.6, abs=0.1)
    assert final.count() == 3


def test_binning_sensitivity(spark):
    c = spark.createDataFrame([(1, 2000.0, 6000.0), (16, 32000.0, 96000.0)], "k int, short double, long double")
    x = lt.binning_sensitivity(c, times=TIMES, n_bootstrap=60, **SHAPE).toPandas().set_index("k")
    assert x.mpet_half_width_ps[1] / x.mpet_half_width_ps[16] == pytest.approx(4, rel=0.4)


def test_typical_counts_are_medians_of_full_groups(spark):
    from eventide.core.series import Series

    rng = np.random.default_rng(17)
    short, long = rng.integers(0, 50, 103).astype(float), rng.integers(0, 9, 103).astype(float)
    short[40], long[7:9] = np.nan, 0.0
    short[7:9] = 0.0
    rows = [("r", i, None if np.isnan(a) else float(a), float(b)) for i, (a, b) in enumerate(zip(short, long))]
    df = spark.createDataFrame(rows, "k_ string, t int, short double, long double")
    got = {r.k: r for r in lt.typical_counts(df, Series(("k_",), "t", 13.0), (1, 2, 10, 200)).collect()}
    for k in (1, 2, 10):
        a, b = (v[:103 // k * k].reshape(-1, k).sum(1) for v in (short, long))
        fine = np.isfinite(a) & (a + b > 0)
        assert (got[k].short, got[k].long) == (np.median(a[fine]), np.median(b[fine]))
    assert set(got) == {1, 2, 10}


def test_markers(spark):
    df = spark.createDataFrame([(0,), (4,), (8,), (2**31 + 4,)], "mark bigint")
    assert [r[0] for r in df.select(lt.markers(df)).collect()] == [False, True, False, True]


def test_gamma_transfer(spark):
    t = np.arange(-5, 30, 0.05)
    drive = ((t >= 0) & (t < 1)).astype(float)
    y = 2.5 * tr.causal(drive, tr.gamma_kernel(t - t[0], 5.0), 0.05)
    df = spark.createDataFrame([("a", float(a), float(b), float(c)) for a, b, c in zip(t, drive, y)], "k string, t double, drive double, response double")
    r = tr.fit_gamma(df, ["k"], [2.0, 5.0, 8.0], orders=(1, 2)).first()
    assert (r.tau, r.order) == (5.0, 1) and r.gain == pytest.approx(2.5, rel=1e-6) and r.r2 > 0.999
    b = tr.fit_biexponential(df.withColumn("response", F.col("drive") * 0), ["k"]).first()
    assert b.success in (True, False)


def test_biexponential(spark):
    t = np.arange(0, 40, 0.2)
    drive = np.exp(-0.5 * ((t - 8) / 1.5) ** 2)
    y = 1.7 * tr.causal(drive, tr.biexponential_kernel(t, 0.8, 6.0, 0.4), 0.2) + 0.3
    df = spark.createDataFrame([("a", float(a), float(b), float(c)) for a, b, c in zip(t, drive, y)], "k string, t double, drive double, response double")
    r = tr.fit_biexponential(df, ["k"]).first()
    assert r.r2 > 0.999 and r.gain == pytest.approx(1.7, rel=0.05) and r.decay_tau == pytest.approx(6.0, rel=0.1)


def test_forward_ridge_visits_rows_once(spark, monkeypatch):
    """Statistics of shared cells equal those of every fold's own rows, and rows aren't repeated per fold."""
    rng = np.random.default_rng(29)
    rows = [(f"s{k}", i, i * 0.5, *map(float, rng.normal(size=2)), float(rng.normal())) for k, n in enumerate((40, 90, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i bigint, t double, a double, b double, y double")
    columns, grid = {"one": ["a"], "combined": ["a", "b"]}, [1e-3, 0.1, 10.0]
    seen = []
    monkeypatch.setattr(fc, "FITTED_ROWS", 50)
    out = fc.forward_ridge(df, ["k"], columns, n_folds=2, n_inner=2, gap=1.0, alphas=grid)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "Explode" not in plan.split("MapInArrow")[0]

    def moments(part):
        z = part[["a", "b", "y"]].to_numpy()
        x, y = z[:, :2], z[:, 2]
        return {"xtx": x.T @ x, "xty": x.T @ y, "sx": x.sum(0), "yty": y @ y, "sy": y.sum(), "n": float(len(z))}

    def folds(n, k):
        first = -(-n // 2)
        size, extra = divmod(n - first, k)
        at = first
        for i in range(k):
            yield i, at, at + size + (i < extra)
            at += size + (i < extra)

    for k, own in df.toPandas().groupby("k"):
        for fold, start, stop in folds(len(own), 2):
            cutoff = own[own.i == start].t - 1.0
            test = own[(own.i >= start) & (own.i < stop)]
            train = own[own.t < cutoff.iloc[0]] if len(cutoff) else own[:0]
            if not len(test) or not len(train):
                continue
            for model, cols in (("one", [0]), ("combined", [0, 1])):
                best = []
                for a in sorted(grid, reverse=True):
                    scores = []
                    for _, lo, hi in folds(len(train), 2):
                        edge = train[train.i == lo].t - 1.0
                        inner = train[train.t < edge.iloc[0]] if len(edge) else train[:0]
                        held = train[(train.i >= lo) & (train.i < hi)]
                        if len(inner) >= 2 and len(held):
                            scores.append(fc.Moments(moments(held), cols).r2(*fc.Moments(moments(inner), cols).ridge(a))[0])
                    best.append(np.nanmean(scores) if np.isfinite(scores).any() else -np.inf)
                alpha = sorted(grid, reverse=True)[int(np.argmax(best))]
                r2, mse = fc.Moments(moments(test), cols).r2(*fc.Moments(moments(train), cols).ridge(alpha))
                seen.append((k, fold, model, alpha, r2, mse, len(test)))
    got = {(r.k, r.fold, r.model): r for r in out.collect() if r.model != "constant"}
    assert len(got) == len(seen) >= 8
    for k, fold, model, alpha, r2, mse, n in seen:
        r = got[k, fold, model]
        assert (r.alpha, r.n_test) == (alpha, n) and r.mse == pytest.approx(mse)
        assert (r.r2 is None) if np.isnan(r2) else r.r2 == pytest.approx(r2)


def test_wide_gram_reads_rows_as_they_come(spark):
    """Missing keys and values, several keys; rows aren't filtered before the sums and never become pandas frames."""
    rng = np.random.default_rng(31)
    names = [f"x{i}" for i in range(9)]
    z = rng.normal(size=(300, 10))
    rows = []
    for i, v in enumerate(z.tolist()):
        v = [None if (i % 11 == 0 and j == 3) else float("nan") if (i % 13 == 0 and j == 9) else x for j, x in enumerate(v)]
        rows.append(([None, "a", "b"][i % 3], [float("nan"), 1.0][i % 2], *v))
    df = spark.createDataFrame(rows, "k string, q double, " + ", ".join(f"{c} double" for c in [*names, "y"])).repartition(4)
    st = glm.gram(df, ["k", "q"], names, "y")
    plan = st._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan and "Filter" not in plan
    got = {(r.k, r.q): r for r in st.collect()}
    assert len(got) == 6
    for (k, q), r in got.items():
        own = [v[2:] for v in rows if v[0] == k and (q is None) == (v[1] != v[1]) and None not in v[2:] and not any(x != x for x in v[2:])]
        x, y = np.array(own)[:, :9], np.array(own)[:, 9]
        assert r.n == len(own) and r.yty == pytest.approx(y @ y) and r.sy == pytest.approx(y.sum())
        assert np.allclose(r.xtx, (x.T @ x).ravel()) and np.allclose(r.xty, x.T @ y) and np.allclose(r.sx, x.sum(0))
    assert glm.gram(df.where("k = 'c'"), ["k"], names, "y").count() == 0
