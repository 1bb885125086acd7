"""Batched penalised fits and their nested cross-validation against plain numpy on rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import penalised as pn

COLUMNS = {"history_only": ["a"], "cross_modal": ["b"], "combined": ["a", "b"]}
ALPHAS = (0.01, 3.0, 40.0)
TARGETS = ["photometry", "lick_binary", "lick_count"]


def plain_fit(X, y, family, alpha):
    """Intercept and coefficients on rows as they are; None for a single class."""
    if family == "logistic" and y.min() == y.max():
        return None
    m, sd = X.mean(0), X.std(0)
    sd[sd < 1e-12] = 1
    Z = np.column_stack([np.ones(len(X)), (X - m) / sd])
    pen = np.r_[0.0, np.full(X.shape[1], alpha * (len(X) if family == "poisson" else 1))]
    b = np.zeros(Z.shape[1])
    mu0 = np.clip(y.mean(), 1e-6, None)
    b[0] = {"gaussian": y.mean(), "logistic": np.log(mu0 / (1 - mu0)), "poisson": np.log(mu0)}[family]
    for _ in range(60):
        mu = pn.link(Z @ b, family)
        w = {"gaussian": np.ones(len(y)), "logistic": mu * (1 - mu), "poisson": mu}[family]
        step = np.linalg.solve((Z * w[:, None]).T @ Z + np.diag(pen), Z.T @ (mu - y) + pen * b)
        b = b - np.clip(step, -2, 2)
    raw = b[1:] / sd
    return np.r_[b[0] - raw @ m, raw]


def plain_predict(X, b, family):
    return pn.link(b[0] + X @ b[1:], family)


def plain_score(y, p, family):
    if family == "gaussian":
        return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    if family == "poisson":
        p = np.maximum(p, 1e-7)
        return -2 * np.mean(np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / p), 0) - y + p)
    if y.min() == y.max():
        return np.nan
    p = np.clip(p, 1e-7, 1 - 1e-7)
    total = 0.0
    for t in np.unique(p[y == 1]):
        above = p >= t
        total += ((p == t) & (y == 1)).sum() * y[above].mean()
    return total / (y == 1).sum()


def made(target, n, seed):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 2)) * [1, 5] + [0.3, 2]
    eta = 0.5 * X[:, 0] + 0.1 * X[:, 1] - 0.3
    if target == "photometry":
        return X, eta + rng.normal(size=n)
    if target == "lick_binary":
        return X, (rng.random(n) < 1 / (1 + np.exp(-2 * eta))).astype(float)
    return X, rng.poisson(np.exp(eta)).astype(float)


def best(scores):
    fine = {a: s for a, s in scores.items() if np.isfinite(s)}
    return max(fine, key=lambda a: (fine[a], a))


@pytest.mark.parametrize("target", TARGETS)
def test_sessions_left_out(spark, target):
    X, y = made(target, 240, 3)
    g = np.random.default_rng(4).integers(4, size=240)
    family = pn.FAMILY[target]
    df = spark.createDataFrame([(f"s{k}", *map(float, r), float(v)) for k, r, v in zip(g, X, y)], "session string, a double, b double, y double")
    got = pn.session_models(df, "session", COLUMNS, target, alphas=ALPHAS)
    selected = {(r.session, r.model): r.alpha for r in got.selected.collect()}
    metrics = {(r.session, r.model): r[pn.PRIMARY[family]] for r in got.metrics.collect()}
    coefficients = {(r.session, r.model, r.feature): (r.alpha, r.coefficient) for r in got.coefficients.collect()}
    assert len(selected) == 12 and len(metrics) == 16
    for model, cols in (("history_only", [0]), ("cross_modal", [1]), ("combined", [0, 1])):
        Z, picked = X[:, cols], []
        for o in range(4):
            rest = g != o
            means = {}
            for a in ALPHAS:
                inner = [(rest & (g != h), rest & (g == h)) for h in range(4) if h != o]
                means[a] = np.nanmean([plain_score(y[te], plain_predict(Z[te], plain_fit(Z[tr], y[tr], family, a), family), family)
                                       for tr, te in inner])
            a = best(means)
            picked.append(a)
            assert selected[f"s{o}", model] == a
            p = plain_predict(Z[~rest], plain_fit(Z[rest], y[rest], family, a), family)
            assert metrics[f"s{o}", model] == pytest.approx(plain_score(y[~rest], p, family), rel=1e-6)
        for o in range(4):
            b = plain_fit(Z[g == o], y[g == o], family, np.median(picked))
            for name, v in zip(["intercept", *["ab"[c] for c in cols]], b):
                a, c = coefficients[f"s{o}", model, name]
                assert a == np.median(picked) and c == pytest.approx(v, rel=1e-5, abs=1e-7)
    for o in range(4):
        mean = np.full((g == o).sum(), y[g != o].mean())
        assert metrics[f"s{o}", "constant"] == pytest.approx(plain_score(y[g == o], mean, family), rel=1e-9)


@pytest.mark.parametrize("target", TARGETS)
def test_forward_folds(spark, target):
    X, y = made(target, 150, 9)
    t = np.arange(150) * 0.5
    family, gap = pn.FAMILY[target], 2.2
    rows = [("m", i, float(t[i]), *map(float, X[i]), float(y[i])) for i in range(150)]
    df = spark.createDataFrame(rows + [("n", *r[1:]) for r in rows[:90]], "mouse string, i bigint, t double, a double, b double, y double")
    got = pn.forward_models(df.repartition(5), ["mouse"], COLUMNS, target, gap=gap, n_folds=3, n_inner=2, alphas=ALPHAS)
    selected = {(r.mouse, r.fold, r.model): r.alpha for r in got.selected.collect()}
    metrics = {(r.mouse, r.model): r for r in got.metrics.collect()}
    coefficients = {(r.mouse, r.model, r.feature): r.coefficient for r in got.coefficients.collect()}

    def folds(n, k):
        first = int(np.ceil(n * 0.5))
        for part in np.array_split(np.arange(first, n), k):
            yield np.flatnonzero(t[:n] < t[part[0]] - gap), part

    for mouse, n in (("m", 150), ("n", 90)):
        for model, cols in (("history_only", [0]), ("combined", [0, 1])):
            Z, pred, where, picked = X[:, cols], [], [], []
            for k, (tr, te) in enumerate(folds(n, 3)):
                scores = {}
                for a in ALPHAS:
                    held, p = [], []
                    for i, j in folds(len(tr), 2):
                        held.append(j)
                        p.append(plain_predict(Z[j], plain_fit(Z[i], y[i], family, a), family))
                    scores[a] = plain_score(y[np.concatenate(held)], np.concatenate(p), family)
                a = best(scores)
                assert selected[mouse, k, model] == a
                picked.append(a)
                pred.append(plain_predict(Z[te], plain_fit(Z[tr], y[tr], family, a), family))
                where.append(te)
            want = plain_score(y[np.concatenate(where)], np.concatenate(pred), family)
            assert metrics[mouse, model][pn.PRIMARY[family]] == pytest.approx(want, rel=1e-6)
            assert metrics[mouse, model].n == n - int(np.ceil(n * 0.5))
            b = plain_fit(Z[:n], y[:n], family, np.median(picked))
            for name, v in zip(["intercept", *["ab"[c] for c in cols]], b):
                assert coefficients[mouse, model, name] == pytest.approx(v, rel=1e-5, abs=1e-7)


def test_single_class_has_no_model(spark):
    df = spark.createDataFrame([(0, float(i), 1.0) for i in range(9)], "cell int, a double, y double")
    uses = spark.createDataFrame([(0, 5)], "cell int, problem int")
    problems = spark.createDataFrame([(5, [1.0])], "problem int, alphas array<double>")
    fits = pn.Fits(("a",), "logistic", ((0,),))
    (r,) = pn.fit(df, [], uses, problems, fits).collect()
    assert not r.fitted and r.n == 9


def test_final_fit_runs_only_if_asked_for(spark, monkeypatch):
    asked = []
    plain = pn._final
    monkeypatch.setattr(pn, "_final", lambda *a: asked.append(1) or plain(*a))
    df = spark.createDataFrame([(k % 3, float(k % 7), float(k % 5)) for k in range(60)], "session int, a double, y double")
    got = pn.session_models(df, "session", {"history_only": ["a"]}, "photometry", alphas=(1.0,))
    assert got.metrics.count() == 6 and not asked
    assert got.coefficients.count() == 6 and asked


def test_precisions_without_predictions(spark, monkeypatch):
    """One ranking of a feature gives what rankings of predictions give; only bounded predictions need those."""
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(200, 2)), 1)
    y = (rng.random(200) < 1 / (1 + np.exp(-x[:, 0] + x[:, 1]))).astype(float)
    rows = spark.createDataFrame([(int(k % 2), *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, y))], "cell int, a double, b double, y double")
    fits = pn.Fits(("a", "b"), "logistic", ((0,), (0,), (1,), (1,), (0, 1)))
    coef = [0.1, 0.7, 0.0, -0.2, -1.5, 0.0, 0.3, 0.0, -0.4, 0.0, 0.0, 0.0, 0.2, 0.5, -0.5]
    steep = [c * 30 for c in coef]
    fitted = spark.createDataFrame([(1, True, coef), (2, True, steep)], "problem int, fitted boolean, coef array<double>")
    tests = spark.createDataFrame([(p, c, 10 * p + c) for p in (1, 2) for c in (0, 1)], "problem int, cell int, outer int")
    want = {(r.outer, r.cell, r.choice): r.score for r in pn.scored(
        pn.predictions(rows, [], tests, fitted, fits), ["outer", "cell", "choice"], "logistic").collect()}
    ranked = []
    plain = pn.predictions
    monkeypatch.setattr(pn, "predictions", lambda rows, keys, tests, *a: ranked.append({(r.problem, r.choice) for r in tests.collect()}) or plain(rows, keys, tests, *a))
    got = {(r.outer, r.cell, r.choice): r.score for r in pn._precisions(rows, tests, fitted, fits).collect()}
    assert len(got) == 20 and got == {k: pytest.approx(v, rel=1e-12) for k, v in want.items()}
    assert {p for p in ranked[0] if p[0] == 1} == {(1, 4)} and (2, 0) in ranked[0]
