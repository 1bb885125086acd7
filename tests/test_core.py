"""Blocked scans and ranks equal plain windows whatever the block width."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.core.checks import ContractError, require_series
from eventide.core.lineage import cut
from eventide.core.ranks import average_rank, distribution, percentiles
from eventide.core.series import Series, asof, halo_rows, index_rows, running, runs, shift, suggest_width

WIDTHS = [0.7, 5.0, 1e6, None]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    # One key holds a third of all rows.
    for key, n in (("hot", 300), ("b", 200), ("c", 200), ("d", 200)):
        t = np.sort(rng.uniform(-20, 40, n))
        data += [(key, float(a), float(v) if v > 0.1 else None) for a, v in zip(t, rng.uniform(0, 1, n))]
    return cut(spark.createDataFrame(data, "k string, t double, v double"))


def same(a, b):
    a, b = a.toPandas(), b.toPandas()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a = a[cols].sort_values(["k", "t"]).reset_index(drop=True)
    b = b[cols].sort_values(["k", "t"]).reset_index(drop=True)
    assert len(a) == len(b)
    for c in cols:
        if a[c].dtype.kind in "fi":
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=0, atol=1e-12)
        else:
            assert a[c].tolist() == b[c].tolist()


@pytest.mark.parametrize("width", WIDTHS)
def test_shift_equals_lag_and_lead(rows, width):
    w = Window.partitionBy("k").orderBy("t")
    got = shift(rows, Series(("k",), "t", width), back={"pv": "v", "pt": "t"}, ahead={"nv": "v"})
    want = rows.select("*", F.lag("v").over(w).alias("pv"), F.lag("t").over(w).alias("pt"), F.lead("v").over(w).alias("nv"))
    same(got, want)


@pytest.mark.parametrize("width", WIDTHS)
def test_running_and_index(rows, width):
    s = Series(("k",), "t", width)
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumn("z", F.coalesce("v", F.lit(0.0)))
    got = index_rows(running(x, s, {"c": "z"}, {"m": "z"}), s)
    want = x.select("*", F.sum("z").over(w).alias("c"), F.max("z").over(w).alias("m"), (F.count("*").over(w) - 1).alias("i"))
    same(got, want)


@pytest.mark.parametrize("width", WIDTHS)
def test_runs(rows, width):
    w = Window.partitionBy("k").orderBy("t")
    got = runs(rows, Series(("k",), "t", width), "t - _b > 0.2D", before={"_b": "t"}, run="r", position="p")
    flag = F.when(F.col("t") - F.lag("t").over(w) <= 0.2, 0).otherwise(1)
    want = rows.withColumn("f", flag).select(
        "k", "t", "v",
        F.sum("f").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("r"),
        F.row_number().over(w).alias("p"),
    )
    same(got, want)


@pytest.mark.parametrize("width", [0.7, 9.0, 1e6])
@pytest.mark.parametrize("inclusive", [True, False])
def test_asof_equals_numpy(spark, rows, width, inclusive):
    rng = np.random.default_rng(5)
    src = rows.toPandas()
    q = [("hot", float(t)) for t in rng.uniform(-25, 45, 50)]
    q += [("hot", float(t)) for t in src[src.k == "hot"].t[:20]] + [("none", 1.0)]
    queries = spark.createDataFrame(q, "k string, t double")
    got = asof(
        queries, rows, Series(("k",), "t", width), back={"bt": "t", "bv": "v"}, ahead={"at": "t"},
        totals={"n": "1L"}, back_inclusive=inclusive, ahead_inclusive=inclusive,
    ).collect()
    assert len(got) == len(q)
    for r in got:
        s = src[src.k == r.k].sort_values("t")
        before = s[s.t <= r.t] if inclusive else s[s.t < r.t]
        after = s[s.t >= r.t] if inclusive else s[s.t > r.t]
        assert r.bt == (before.t.iloc[-1] if len(before) else None)
        if len(before):
            v = before.v.iloc[-1]
            assert (r.bv is None and np.isnan(v)) or r.bv == v
        assert r["at"] == (after.t.iloc[0] if len(after) else None)
        assert r.n == len(before)


def test_halo_rows_cover_frames(spark):
    df = spark.range(53).select(F.lit("a").alias("k"), F.col("id").alias("i"), F.col("id").cast("double").alias("v"))
    h = halo_rows(df, Series(("k",), "i", 10.0), 3, 2)
    w = Window.partitionBy("k", "_block").orderBy("i")
    x = h.select("*", F.lag("v", 3).over(w).alias("p"), F.lead("v", 2).over(w).alias("n")).filter("_own")
    got = {r.i: (r.p, r.n) for r in x.collect()}
    assert len(got) == 53
    for i, (p, n) in got.items():
        assert p == (i - 3 if i >= 3 else None) and n == (i + 2 if i + 2 < 53 else None)
    with pytest.raises(ValueError):
        halo_rows(df, Series(("k",), "i", 2.0), 3, 0)


def test_percentiles_and_ranks(spark):
    rng = np.random.default_rng(1)
    groups = {
        "a": rng.normal(0, 1e-4, 101), "b": np.round(rng.normal(0, 2, 200)),
        "c": np.r_[rng.lognormal(3, 4, 77), -5.0, 0.0], "one": np.array([3.0]),
    }
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    got = percentiles(df, ["k"], "v", {"q10": 0.1, "q50": 0.5, "q975": 0.975}).toPandas().set_index("k")
    for k, vs in groups.items():
        np.testing.assert_allclose(got.loc[k, ["q10", "q50", "q975"]].astype(float), np.percentile(vs, [10, 50, 97.5]))
    r = distribution(df, ["k"], "v").select("k", "v", average_rank().alias("r")).toPandas()
    for k, vs in groups.items():
        want = {v: np.mean(np.flatnonzero(np.sort(vs) == v)) + 1 for v in vs}
        for _, row in r[r.k == k].iterrows():
            assert row.r == want[row.v]


def test_contracts_and_width(spark, rows):
    s = Series(("k",), "t", 2.0)
    require_series(rows, s)
    bad = spark.createDataFrame([("a", 1.0), ("a", 1.0)], "k string, t double")
    with pytest.raises(ContractError, match="strictly increasing"):
        require_series(bad, s)
    with pytest.raises(ContractError, match="lacks columns"):
        require_series(bad.drop("t"), s)
    wide = suggest_width(rows, ["k"], "t", coarse=10.0, target_rows=1000)
    fine = suggest_width(rows, ["k"], "t", coarse=10.0, target_rows=5)
    assert fine < 10.0 < wide


def test_asof_never_broadcasts_exploded_queries(spark):
    """A long grid comes from two rows, which adaptive execution takes for the size of the grid."""
    from eventide.operators.forecast import uniform_grid

    bounds = spark.createDataFrame([("a", 0.0, 200_000), ("b", 0.0, 200_000)], "k string, t0 double, n bigint")
    s = Series(("k",), "t", 1000.0)
    samples = spark.createDataFrame([("a", float(t), 1.0) for t in range(0, 200_000, 100)], "k string, t double, v double")
    x = asof(uniform_grid(bounds, ["k"], 1.0), samples, s, back={"b": "v"}).select("k", "i")
    rows = x.groupBy("k").count()
    assert {tuple(r) for r in rows.collect()} == {("a", 200_000), ("b", 200_000)}
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
