"""Candidate models from one table of cross moments against models fitted on rows."""

import numpy as np
import pytest

from eventide.operators import glm
from eventide.plans import sweeps

ALPHAS = [0.1, 20.0]
NAMES = ["one", "drift1", "drift2", "k"]


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(21)
    n = 360
    z = rng.random(n)
    X = np.column_stack([np.ones(n), z, z * z, rng.normal(size=n)])
    g = rng.integers(6, size=n)
    y = 1 + 2 * z + X[:, 3] + rng.normal(size=n)
    df = spark.createDataFrame([(*map(float, r), float(v), int(u)) for r, v, u in zip(X, y, g)],
                               "one double, drift1 double, drift2 double, k double, y double, unit int")
    return X, y, g, glm.gram(df, ["unit"], NAMES, "y")


def plain(X, y, g, cols):
    """Per unit: penalty, mean and standard error of the inner scores, held-out R2."""
    X, pen = X[:, cols], np.diag([0.0 if c == 0 else 1.0 for c in cols])

    def score(train, test, a):
        s = np.sqrt((X[train] ** 2).mean(0))
        Z = X[train] / s
        b = np.linalg.solve(Z.T @ Z + a * pen, Z.T @ y[train]) / s
        return 1 - ((y[test] - X[test] @ b) ** 2).sum() / ((y[test] - y[test].mean()) ** 2).sum()

    out = {}
    for o in range(6):
        inner = {a: np.array([score((g != o) & (g != h), g == h, a) for h in range(6) if h != o]) for a in ALPHAS}
        a = max(ALPHAS, key=lambda v: inner[v].mean())
        out[o] = (a, inner[a].mean(), inner[a].std(ddof=1) / np.sqrt(5), score(g != o, g == o, a))
    return out


def test_drift_ladder_equals_rows(made):
    X, y, g, stats = made
    got = {(r.step, r.unit): r for r in sweeps.drift_ladder(stats, NAMES, ["k"], "unit", ALPHAS).collect()}
    want = [plain(X, y, g, cols) for cols in ([0, 3], [0, 1, 3], [0, 1, 2, 3])]
    for i, step in enumerate(("intercept", "linear", "quadratic")):
        for o in range(6):
            r = got[step, o]
            assert r.alpha == want[i][o][0] and r.r2 == pytest.approx(want[i][o][3])
            assert r.gain == (None if i == 0 else pytest.approx(want[i][o][3] - want[i - 1][o][3]))


def test_one_standard_error_rules(made):
    X, y, g, stats = made
    candidates = [["one", "k"], ["one", "drift1", "k"], ["one", "drift1", "drift2", "k"]]
    scores = sweeps.compare(stats, NAMES, candidates, "unit", ALPHAS)
    want = [plain(X, y, g, [NAMES.index(c) for c in cs]) for cs in candidates]
    rows = {(r.unit, r.candidate): r for r in scores.collect()}
    for (o, c), r in rows.items():
        assert (r.alpha, r.inner_mean, r.inner_se, r.r2) == (want[c][o][0], *map(pytest.approx, want[c][o][1:]))
    r2 = np.array([[w[o][3] for o in range(6)] for w in want])
    loss = r2[r2.mean(1).argmax()] - r2
    fits = loss.mean(1) <= loss.std(1, ddof=1) / np.sqrt(6)
    got = {r.candidate: r for r in sweeps.summary(scores, "unit").collect()}
    assert [got[c].recommended for c in range(3)] == [c == fits.argmax() for c in range(3)]
    assert [got[c].mean_r2 for c in range(3)] == pytest.approx(r2.mean(1).tolist())
    for r in sweeps.one_standard_error(scores, "unit").collect():
        best = max(range(3), key=lambda c: want[c][r.unit][1])
        least = want[best][r.unit][1] - want[best][r.unit][2]
        assert r.candidate == min(c for c in range(3) if want[c][r.unit][1] >= least)


def test_signals_are_not_broadcast(spark):
    from eventide.workload.model_queries import forecast_signals

    x = forecast_signals(spark, "/root/testdata/sf0.001").select("mouse", "i", "licking").where("licking > 0")
    assert x.collect()
    plan = x._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [line for line in plan if "BroadcastHashJoin [mouse" in line and " i#" in line]
