import numpy as np
import pytest

from eventide.core.series import Series
from eventide.functions import special as sp
from eventide.operators import nulls as nl
from eventide.operators import scores as sc
from eventide.operators import stats as st


def mice(spark, rows):
    return spark.createDataFrame(rows, "mouse string, grp string, cond string, metric string, value double")


def test_student_t():
    # Known quantiles of the t distribution.
    assert sp.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert sp.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, rel=1e-10)
    assert sp.t_quantile(0.975, 1) == pytest.approx(12.706204736432095, rel=1e-9)
    assert sp.t_two_sided(0.0, 3) == pytest.approx(1.0)
    assert np.isnan(sp.t_two_sided(1.0, 0))


def test_exact_rank_tests():
    # Five positive differences: two of 32 sign patterns are as extreme.
    assert sp.signed_rank_p(15, 0, 5, 0, 0) == pytest.approx(2 / 32)
    # 3 against 3, complete separation: 2 of 20 arrangements.
    assert sp.rank_sum_p(9, 3, 3, 0) == pytest.approx(2 / 20)
    assert sp.rank_sum_p(4.5, 3, 3, 0) == pytest.approx(1.0)


def test_rank_sum_exact_equals_enumeration():
    from itertools import combinations

    n1, n2 = 3, 4
    us = [sum(c) - n1 * (n1 + 1) / 2 for c in combinations(range(1, n1 + n2 + 1), n1)]
    for u in range(n1 * n2 + 1):
        big = max(u, n1 * n2 - u)
        want = min(1.0, 2 * np.mean([x >= big for x in us]))
        assert sp.rank_sum_p(u, n1, n2, 0) == pytest.approx(want)


def test_log_ndtr():
    from math import erfc, log, sqrt

    x = np.r_[np.linspace(-36, 8, 300), 0.0]
    want = [log(0.5 * erfc(-v / sqrt(2))) for v in x]
    np.testing.assert_allclose(sp.log_ndtr(x), want, rtol=2e-13, atol=1e-15)
    # Far left tail: -x^2/2 - log(-x) - log(2 pi)/2 to first order.
    far = -60.0
    assert sp.log_ndtr(np.array([far]))[0] == pytest.approx(-1800 - log(60) - 0.5 * log(2 * np.pi) - 1 / 3600, rel=1e-9)


def test_paired_auto(spark):
    rows = [(m, "g", c, "auc", v) for m, a, b in (("M1", 1, 2), ("M2", 2, 4), ("M3", 3, 6)) for c, v in (("A", float(a)), ("B", float(b)))]
    (r,) = st.pairwise_tests(mice(spark, rows)).collect()
    assert (r.test, r.n_pairs, r.level_a, r.difference) == ("paired_t", 3, "A", -2.0)
    t = -2.0 / (1.0 / 3**0.5)
    assert r.statistic == pytest.approx(t) and r.effect_size == pytest.approx(-2.0)
    assert r.p_value == pytest.approx(sp.t_two_sided(t, 2)) and r.p_adjusted_holm == pytest.approx(r.p_value)
    assert r.ci_lower < -2 < r.ci_upper


def test_welch_and_family(spark):
    rows = []
    for metric, shift in (("auc", 0.0), ("peak", 2.0)):
        rows += [("c1", "control", "A", metric, 1.0), ("c2", "control", "A", metric, 2.0)]
        rows += [("t1", "treated", "A", metric, 3.0 + shift), ("t2", "treated", "A", metric, 5.0 + shift)]
    out = st.pairwise_tests(mice(spark, rows)).orderBy("metric").collect()
    assert [r.test for r in out] == ["welch", "welch"] and {r.effect_size_name for r in out} == {"hedges_g"}
    d = (1.5 - 4.0) / np.sqrt((0.5 + 2.0) / 2) * (1 - 3 / 7)
    assert out[0].effect_size == pytest.approx(d)
    ps = sorted(r.p_value for r in out)
    assert sorted(r.p_adjusted_holm for r in out) == pytest.approx([min(1, 2 * ps[0]), max(min(1, 2 * ps[0]), ps[1])])


def test_one_shared_mouse_is_skipped(spark):
    rows = [("M1", "g", "A", "m", 1.0), ("M1", "g", "B", "m", 2.0), ("M2", "g", "A", "m", 1.0), ("M3", "g", "B", "m", 3.0)]
    assert st.pairwise_tests(mice(spark, rows)).count() == 0
    assert st.pairwise_tests(mice(spark, rows), "welch").count() == 1


def test_rank_tests(spark):
    rng = np.random.default_rng(2)
    rows = [(f"M{i}", "g", c, "m", float(v)) for c in "AB" for i, v in enumerate(rng.normal(c == "B", 1, 6))]
    (w,) = st.pairwise_tests(mice(spark, rows), "wilcoxon").collect()
    a = np.array([r[4] for r in rows[:6]]) - np.array([r[4] for r in rows[6:]])
    ranks = np.argsort(np.argsort(np.abs(a))) + 1
    plus, minus = ranks[a > 0].sum(), ranks[a < 0].sum()
    assert w.statistic == min(plus, minus) and w.effect_size == pytest.approx((plus - minus) / 21)
    (u,) = st.pairwise_tests(mice(spark, rows), "mannwhitney").collect()
    x, y = [r[4] for r in rows[:6]], [r[4] for r in rows[6:]]
    assert u.statistic == sum(p > q for p in x for q in y)
    assert u.effect_size == pytest.approx(2 * u.statistic / 36 - 1)


def test_holm_keeps_missing(spark):
    df = spark.createDataFrame([(1, 0.04), (2, 0.01), (3, None), (4, 0.03), (5, 0.03)], "i int, p_value double")
    got = {r.i: r.p_adjusted_holm for r in st.holm(df).collect()}
    assert got[3] is None
    assert [got[i] for i in (2, 4, 5, 1)] == pytest.approx([0.04, 0.09, 0.09, 0.09])


def test_bootstrap_of_pairwise_tests(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(0, 1, 12), rng.normal(1, 1, 12)
    paired = [(f"M{i:02}", "g", c, "m", float(x)) for c, v in (("A", a), ("B", b)) for i, x in enumerate(v)]
    alone = [(f"{c}{i:02}", "g", c, "m", float(x)) for c, v in (("A", a), ("B", b)) for i, x in enumerate(v)]
    for rows, test in ((paired, "paired_t"), (paired, "wilcoxon"), (alone, "welch"), (alone, "mannwhitney")):
        (r,) = st.pairwise_tests(mice(spark, rows), test, n_bootstrap=1500).collect()
        assert r.bootstrap_valid_difference_resamples == r.bootstrap_valid_effect_resamples == r.bootstrap_resamples == 1500
        assert r.holm_family_size == 1
        pick = lambda n: rng.integers(0, n, (4000, n))
        if test in ("paired_t", "wilcoxon"):
            d = (a - b)[pick(12)]
            effect = d.mean(1) / d.std(1, ddof=1)
            diff = d.mean(1)
        else:
            x, y = a[pick(12)], b[pick(12)]
            diff = x.mean(1) - y.mean(1)
            effect = diff / np.sqrt((x.var(1, ddof=1) + y.var(1, ddof=1)) / 2) * (1 - 3 / (4 * 24 - 9))
        if test == "mannwhitney":
            effect = ((x[:, :, None] > y[:, None, :]).mean((1, 2)) + 0.5 * (x[:, :, None] == y[:, None, :]).mean((1, 2))) * 2 - 1
        low, high = np.percentile(diff, (2.5, 97.5))
        assert (r.difference_ci_lower_bootstrap, r.difference_ci_upper_bootstrap) == pytest.approx((low, high), abs=0.15)
        if test != "wilcoxon":
            low, high = np.percentile(effect, (2.5, 97.5))
            assert (r.effect_size_ci_lower_bootstrap, r.effect_size_ci_upper_bootstrap) == pytest.approx((low, high), abs=0.25)
        else:
            assert -1 <= r.effect_size_ci_lower_bootstrap <= r.effect_size <= r.effect_size_ci_upper_bootstrap <= 1


def test_empirical_p(spark):
    obs = spark.createDataFrame([("g", 1000.0)], "grp string, observed_mean double")
    null = spark.createDataFrame([("g", float(v)) for v in range(500)], "grp string, value double")
    r = nl.shuffle_tests(obs, null, ["grp"]).first()
    assert r.p_value == pytest.approx(1 / 501) and r.n_shuffles == 500
    obs = spark.createDataFrame([("g", 10.0)], "grp string, observed_mean double")
    null = spark.createDataFrame([("g", v) for v in (0.0, 1.0, 2.0, None)], "grp string, value double")
    r = nl.shuffle_tests(obs, null, ["grp"]).first()
    assert (r.n_shuffles, r.p_value) == (3, 0.25)
    obs = spark.createDataFrame([("g", 10.0), ("h", 10.0)], "grp string, observed_mean double")
    null = spark.createDataFrame([(k, v) for k, n in (("g", 3), ("h", 9)) for v in range(n)], "grp string, value long")
    got = {r.grp: r for r in nl.shuffle_family(obs, null, ["grp"]).collect()}
    assert [got[k].p_adjusted_holm for k in "gh"] == pytest.approx([0.25, 0.2])
    assert {r.holm_family_size for r in got.values()} == {2}


@pytest.mark.parametrize("method", ["random_onsets", "circular_shift"])
def test_null_onsets(spark, method):
    s = Series(("k",), "t", 10.0)
    times = [12.0, 20.0, 33.0]
    e = spark.createDataFrame([("a", i, t) for i, t in enumerate(times)], "k string, event_i int, t double")
    b = spark.createDataFrame([("a", 10.0, 60.0)], "k string, lo double, hi double")
    args = dict(n_shuffles=20, method=method, exclusion=1.5, seed=3)
    x = nl.null_onsets(e, s, b, **args).collect()
    assert len(x) == 60 and all(10 <= r.t <= 60 for r in x)
    assert all(min(abs(r.t - t) for t in times) >= 1.5 for r in x)
    again = nl.null_onsets(e.repartition(3), s, b, **args).collect()
    assert {(r.shuffle, r.event_i, r.t) for r in x} == {(r.shuffle, r.event_i, r.t) for r in again}
    if method == "circular_shift":
        for k in range(20):
            got = sorted(r.t for r in x if r.shuffle == k)
            gaps = sorted(np.round(np.diff(got + [got[0] + 50]), 9))
            assert gaps == sorted([8.0, 13.0, 29.0])


def test_null_onsets_fill_narrow_gaps(spark):
    # A hundred events a second apart leave 2 ms around each middle.
    s = Series(("k",), "t", 10.0)
    e = spark.createDataFrame([("a", i, float(i)) for i in range(100)], "k string, event_i int, t double")
    b = spark.createDataFrame([("a", 0.0, 99.0)], "k string, lo double, hi double")
    x = nl.null_onsets(e, s, b, n_shuffles=5, exclusion=0.499).collect()
    assert len(x) == 500 and all(r.t is not None and abs(r.t % 1 - 0.5) <= 0.001 + 1e-9 for r in x)
    assert len({int(r.t) for r in x}) > 80
    for method in ("random_onsets", "circular_shift"):
        with pytest.raises(ValueError):
            nl.null_onsets(e.limit(3), s, b, n_shuffles=1, exclusion=99.0, method=method).collect()


def test_bootstrap_interval_covers_the_mean(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(5, 1, 40)
    df = spark.createDataFrame([("g", i, float(x)) for i, x in enumerate(v)], "grp string, mouse int, value double")
    r = st.bootstrap_mean_interval(df, ["grp"], n_resamples=400, seed=1).first()
    se = v.std(ddof=1) / 40**0.5
    assert r.n_resamples == 400
    assert r.lower == pytest.approx(v.mean() - 1.96 * se, abs=0.12) and r.upper == pytest.approx(v.mean() + 1.96 * se, abs=0.12)


def test_binary_scores(spark):
    y = [0, 1, 1, 0, 1, 0, 1, 0, 0, 1]
    p = [0.1, 0.4, 0.35, 0.4, 0.8, 0.2, 0.9, 0.6, 0.35, 0.35]
    df = spark.createDataFrame([("a", float(a), b) for a, b in zip(y, p)], "k string, y double, p double")
    r = sc.binary(df, ["k"], "y", "p").first()
    pos, neg = [b for a, b in zip(y, p) if a], [b for a, b in zip(y, p) if not a]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = [a for a, b in zip(y, p) if b >= t]
        recall = sum(hit) / 5
        ap += (recall - last) * np.mean(hit)
        last = recall
    assert r.roc_auc == pytest.approx(auc) and r.average_precision == pytest.approx(ap)
    assert r.positive_prevalence == 0.5 and r.ap_gain == pytest.approx(ap - 0.5)
    one = df.withColumn("y", df.y * 0 + 1)
    assert sc.binary(one, ["k"], "y", "p").first().roc_auc is None


def test_spearman_and_mad(spark):
    rng = np.random.default_rng(8)
    a, b = np.round(rng.normal(size=60), 1), np.round(rng.normal(size=60), 1)
    df = spark.createDataFrame([("k", float(x), float(y)) for x, y in zip(a, b)], "k string, a double, b double")

    def rank(v):
        return np.array([np.mean(np.flatnonzero(np.sort(v) == x)) for x in v])

    assert st.spearman(df, ["k"], "a", "b").first().rho == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1])
    r = st.mad_noise(df, ["k"], "a").first()
    assert r.noise == pytest.approx(1.4826 * np.median(np.abs(a - np.median(a))))
