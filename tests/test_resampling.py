import hashlib

import numpy as np
import pytest

from eventide.functions import hashed
from eventide.operators import stats as st


@pytest.mark.parametrize("prefix, n", [("3|control|early", 123), ("", 11), ("x" * 60, 12)])
def test_grids_of_draws_equal_single_ones(prefix, n):
    for first, at in hashed.indices(prefix, n, 8, 103):
        for b, row in enumerate(at.tolist(), first):
            u = [int(hashlib.md5(f"{prefix}|{b}|{i}".encode()).hexdigest()[:12], 16) / 2**48 for i in range(n)]
            assert row == [min(int(x * n), n - 1) for x in u]


def test_resamples_need_no_join(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(m, g, c, "auc", float(rng.integers(-3, 4))) for g in ("g", "h") for m in range(40 * (g == "h"), 40 * (g == "h") + 30) for c in ("A", "B")]
    mice = spark.createDataFrame(rows, "mouse bigint, grp string, cond string, metric string, value double").cache()
    missing = mice.union(spark.createDataFrame([(99, "g", "A", "auc", None)], mice.schema))

    def all_():
        means = st.bootstrap_mean_interval(missing, ["grp", "cond", "metric"], n_resamples=50, seed=3).toPandas()
        tests = [st.pairwise_tests(mice, t, n_bootstrap=50).toPandas() for t in ("auto", "wilcoxon", "mannwhitney")]
        return [x.sort_values(list(x.columns[:6])).reset_index(drop=True) for x in (means, *tests)]

    # Many members: the same resamples from the join.
    monkeypatch.setattr(st, "GATHERED", 2)
    joined = all_()
    monkeypatch.undo()
    called = []
    monkeypatch.setattr(st, "_joined_means", lambda *a: called.append(a))
    monkeypatch.setattr(st, "_joined_comparisons", lambda *a: called.append(a))
    for a, b in zip(all_(), joined):
        assert len(a) and list(a.columns) == list(b.columns)
        for c in a:
            if a[c].dtype == float:
                np.testing.assert_allclose(a[c], b[c], rtol=1e-9, atol=1e-12)
            else:
                assert a[c].tolist() == b[c].tolist()
    assert not called


@pytest.mark.parametrize("length", [44, 50, 52, 53, 56, 58, 60, 63, 64, 118, 121, 128])
def test_long_labels_are_hashed_side_by_side(monkeypatch, length):
    prefix, md5 = "y" * length, hashlib.md5
    # 6 to 14 and 98 to 112: numbers of other lengths within one call.
    want = {b: [min(int(int(md5(f"{prefix}|{b}|{i}".encode()).hexdigest()[:12], 16) / 2**48 * 103), 102) for i in range(103)]
            for b in (*range(6, 14), *range(98, 112))}
    monkeypatch.setattr(hashlib, "md5", None)  # no label is hashed on its own
    for span in ((6, 14), (98, 112)):
        got = {b: row for first, at in hashed.indices(prefix, 103, *span) for b, row in enumerate(at.tolist(), first)}
        assert got == {b: want[b] for b in range(*span)}


def test_rank_sums_of_resamples():
    rng = np.random.default_rng(5)
    for sizes in (rng.normal(size=40), rng.integers(0, 6, 40).astype(float), np.full(40, np.nan), np.where(rng.random(40) < 0.2, np.nan, rng.integers(0, 9, 40))):
        counted, chosen = rng.random(40) < 0.5, [rng.integers(0, 40, 40) for _ in range(5)]
        some, every = st._rank_effects(sizes, chosen, counted)
        for r, at in enumerate(chosen):
            x, own = sizes[at], counted[at] & np.isfinite(sizes[at])
            rank = np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
            assert some[r] == rank[own].sum() and every[r] == rank[np.isfinite(x)].sum()
