"""Hypothesis tests on mouse-level rows: sums in SQL, tail areas in Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from eventide.core.lineage import cut, small_batches
from eventide.core.ranks import average_rank, distribution
from eventide.core.series import Series, running
from eventide.functions.hashed import index_below, indices, label
from eventide.functions.special import mann_whitney_p, t_p_value, t_ppf_975, wilcoxon_p


def holm(df: DataFrame, p: str = "p_value", out: str = "p_adjusted_holm") -> DataFrame:
    """Holm step-down over all rows with a p-value; missing values stay missing.

    Equal p-values share the adjusted value of the first of them, so the
    running maximum runs over distinct values.
    """
    d = distribution(df, [], p).withColumn(
        "_adj", F.least(F.lit(1.0), (F.col("n") - F.col("below")) * F.col(p))
    )
    d = running(d.select(p, "_adj"), Series((), p, None), maxima={out: "_adj"})
    known = df.filter(F.col(p).isNotNull()).join(d.select(p, out), p)
    missing = df.filter(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double"))
    return known.select(*df.columns, out).unionByName(missing)


def level_stats(mice: DataFrame, keys: list[str]) -> DataFrame:
    return mice.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("s2")
    )


def level_pairs(levels: DataFrame, stratum: list[str], level: str) -> DataFrame:
    """Two levels side by side, ``a`` before ``b``; one row per comparison."""
    a = levels.select(
        *stratum, F.col(level).alias("level_a"), *[F.col(c).alias(f"{c}_a") for c in ("n", "m", "s2")]
    )
    b = levels.select(
        *stratum, F.col(level).alias("level_b"), *[F.col(c).alias(f"{c}_b") for c in ("n", "m", "s2")]
    )
    return a.join(b, stratum).filter("level_a < level_b")


def welch(pairs: DataFrame) -> DataFrame:
    """Welch t, Welch-Satterthwaite df and Hedges g from ``n, m, s2`` of a and b."""
    va, vb = F.col("s2_a") / F.col("n_a"), F.col("s2_b") / F.col("n_b")
    n = F.col("n_a") + F.col("n_b")
    diff = F.col("m_a") - F.col("m_b")
    pooled = F.sqrt(
        ((F.col("n_a") - 1) * F.col("s2_a") + (F.col("n_b") - 1) * F.col("s2_b")) / (n - 2)
    )
    return (
        pairs.filter("n_a >= 2 AND n_b >= 2")
        .withColumn("difference", diff)
        .withColumn("se", F.sqrt(va + vb))
        .withColumn("statistic", F.when(F.col("se") > 0, diff / F.col("se")))
        .withColumn(
            "df",
            F.when(
                va + vb > 0,
                (va + vb) * (va + vb)
                / (va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1)),
            ),
        )
        .withColumn("effect_size", F.when(pooled > 0, diff / pooled) * (1 - 3 / (4 * n - 9)))
    )


def paired_stats(mice: DataFrame, stratum: list[str], level: str, mouse: str = "mouse") -> DataFrame:
    """Differences of mice measured at two levels: n, mean, sd, t and Cohen dz."""
    a = mice.select(*stratum, mouse, F.col(level).alias("level_a"), F.col("value").alias("_a"))
    b = mice.select(*stratum, mouse, F.col(level).alias("level_b"), F.col("value").alias("_b"))
    d = a.join(b, [*stratum, mouse]).filter("level_a < level_b")
    d = d.withColumn("_d", F.col("_a") - F.col("_b"))
    g = d.groupBy(*stratum, "level_a", "level_b").agg(
        F.count("_d").alias("n_pairs"),
        F.avg("_d").alias("difference"),
        F.stddev_samp("_d").alias("sd"),
    )
    se = F.col("sd") / F.sqrt("n_pairs")
    return (
        g.withColumn("se", se)
        .withColumn("statistic", F.when(F.col("se") > 0, F.col("difference") / F.col("se")))
        .withColumn("effect_size", F.when(F.col("sd") > 0, F.col("difference") / F.col("sd")))
    )


def pair_differences(
    mice: DataFrame, stratum: list[str], level: str, mouse: str = "mouse"
) -> DataFrame:
    a = mice.select(*stratum, mouse, F.col(level).alias("level_a"), F.col("value").alias("_a"))
    b = mice.select(*stratum, mouse, F.col(level).alias("level_b"), F.col("value").alias("_b"))
    d = a.join(b, [*stratum, mouse]).filter("level_a < level_b")
    return d.select(*stratum, "level_a", "level_b", mouse, (F.col("_a") - F.col("_b")).alias("d"))


def signed_rank(differences: DataFrame, keys: list[str], value: str = "d") -> DataFrame:
    """Wilcoxon signed-rank sums and rank-biserial effect, zeros dropped."""
    nonzero = differences.filter(F.col(value) != 0).withColumn("_abs", F.abs(F.col(value)))
    d = distribution(
        nonzero, keys, "_abs", weights={"pos": F.when(F.col(value) > 0, 1).otherwise(0)}
    )
    rank, neg = average_rank(), F.col("cnt") - F.col("pos")
    sums = d.groupBy(*keys).agg(
        F.sum(F.col("pos") * rank).alias("w_plus"),
        F.sum(neg * rank).alias("w_minus"),
        F.sum("cnt").alias("n_nonzero"),
        F.sum((F.pow("cnt", F.lit(3)) - F.col("cnt"))).alias("ties"),
    )
    total = differences.groupBy(*keys).agg(
        F.count(value).alias("n_pairs"),
        F.sum((F.col(value) == 0).cast("bigint")).alias("zeros"),
        F.avg(value).alias("difference"),
    )
    out = total.join(sums, keys, "left").fillna(
        {"w_plus": 0.0, "w_minus": 0.0, "n_nonzero": 0, "ties": 0.0}
    )
    both = F.col("w_plus") + F.col("w_minus")
    return out.withColumn("statistic", F.least("w_plus", "w_minus")).withColumn(
        "effect_size",
        F.when(both > 0, (F.col("w_plus") - F.col("w_minus")) / both).otherwise(0.0),
    )


def rank_sum(mice: DataFrame, keys: list[str], in_first: Column, value: str = "value") -> DataFrame:
    """Mann-Whitney U of the first sample and its rank-biserial effect."""
    d = distribution(
        mice.withColumn("_first", in_first.cast("int")), keys, value,
        weights={"first": F.col("_first")},
    )
    g = d.groupBy(*keys).agg(
        F.sum("first").alias("n_a"),
        F.sum(F.col("cnt") - F.col("first")).alias("n_b"),
        F.sum(F.col("first") * average_rank()).alias("rank_sum_a"),
        F.sum(F.pow("cnt", F.lit(3)) - F.col("cnt")).alias("ties"),
    )
    u = F.col("rank_sum_a") - F.col("n_a") * (F.col("n_a") + 1) / 2
    return g.withColumn("u", u).withColumn(
        "effect_size",
        F.when(F.col("n_a") * F.col("n_b") > 0, 2 * F.col("u") / (F.col("n_a") * F.col("n_b")) - 1),
    )


def _with_t(tests: DataFrame, df: str) -> DataFrame:
    margin = t_ppf_975(F.col(df).cast("double")) * F.col("se")
    return (
        tests.withColumn("p_value", t_p_value(F.col("statistic"), F.col(df).cast("double")))
        .withColumn("_margin", margin)
        .withColumn("ci_lower", F.col("difference") - F.col("_margin"))
        .withColumn("ci_upper", F.col("difference") + F.col("_margin"))
    )


_RESULT = [
    "comparison", "stratum", "metric", "level_a", "level_b", "test", "n_a", "n_b", "n_pairs",
    "mean_a", "mean_b", "difference", "effect_size", "effect_size_name", "ci_lower", "ci_upper",
    "statistic", "p_value",
]


def _compare(
    mice: DataFrame, comparison: str, stratum: str, level: str, test: str, paired_allowed: bool
) -> DataFrame:
    by = [stratum, "metric"]
    pairs = level_pairs(level_stats(mice, [*by, level]), by, level)
    shared = paired_stats(mice, by, level)
    both = [*by, "level_a", "level_b"]
    outputs = []
    independent = test in ("auto", "welch", "mannwhitney") or not paired_allowed
    paired = paired_allowed and test in ("auto", "paired_t", "wilcoxon")

    def finish(df: DataFrame, name: str, effect: str) -> DataFrame:
        return df.select(
            F.lit(comparison).alias("comparison"),
            F.col(stratum).alias("stratum"),
            "metric", "level_a", "level_b",
            F.lit(name).alias("test"),
            F.col("n_a").cast("bigint").alias("n_a"),
            F.col("n_b").cast("bigint").alias("n_b"),
            F.col("n_pairs").cast("bigint").alias("n_pairs"),
            F.col("m_a").alias("mean_a"),
            F.col("m_b").alias("mean_b"),
            "difference", "effect_size",
            F.lit(effect).alias("effect_size_name"),
            "ci_lower", "ci_upper", "statistic", "p_value",
        )

    if paired:
        enough = shared.filter("n_pairs >= 2").withColumn("_df", F.col("n_pairs") - 1)
        x = _with_t(enough, "_df")
        name, effect = "paired_t", "cohen_dz"
        if test == "wilcoxon":
            name, effect = "wilcoxon", "rank_biserial"
            w = signed_rank(pair_differences(mice, by, level), both).select(
                *both,
                F.col("statistic").alias("_w"),
                F.col("effect_size").alias("_e"),
                wilcoxon_p("w_plus", "w_minus", "n_nonzero", "ties", "zeros").alias("_p"),
            )
            x = x.drop("statistic", "effect_size", "p_value").join(w, both)
            x = x.withColumnsRenamed({"_w": "statistic", "_e": "effect_size", "_p": "p_value"})
        # Means of the paired mice only.
        a = mice.select(*by, "mouse", F.col(level).alias("level_a"), F.col("value").alias("_a"))
        b = mice.select(*by, "mouse", F.col(level).alias("level_b"), F.col("value").alias("_b"))
        means = (
            a.join(b, [*by, "mouse"]).filter("level_a < level_b").groupBy(*both)
            .agg(F.avg("_a").alias("m_a"), F.avg("_b").alias("m_b"))
        )
        x = x.join(means, both).withColumns(
            {"n_a": F.col("n_pairs"), "n_b": F.col("n_pairs")}
        )
        outputs.append(finish(x, name, effect))
    if independent:
        usable = pairs
        if test == "auto" and paired_allowed:
            usable = pairs.join(shared.filter("n_pairs >= 1").select(*both), both, "left_anti")
        x = _with_t(welch(usable).withColumn("n_pairs", F.lit(0)), "df")
        name, effect = "welch", "hedges_g"
        if test == "mannwhitney":
            name, effect = "mannwhitney", "rank_biserial"
            chosen = x.select(*both)
            first = mice.withColumnRenamed(level, "level_a").join(chosen, [*by, "level_a"])
            second = mice.withColumnRenamed(level, "level_b").join(chosen, [*by, "level_b"])
            rows = first.select(*both, "value", F.lit(1).alias("_in_a")).unionByName(
                second.select(*both, "value", F.lit(0).alias("_in_a"))
            )
            r = rank_sum(rows, both, F.col("_in_a"))
            r = r.select(
                *both, F.col("u").alias("_u"), F.col("effect_size").alias("_e"),
                mann_whitney_p("u", "n_a", "n_b", "ties").alias("_p"),
            )
            x = x.drop("statistic", "effect_size", "p_value").join(r, both)
            x = x.withColumnsRenamed({"_u": "statistic", "_e": "effect_size", "_p": "p_value"})
        outputs.append(finish(x, name, effect))
    out = outputs[0]
    for other in outputs[1:]:
        out = out.unionByName(other)
    return out


def pairwise_tests(
    mice: DataFrame, test: str = "auto", *, n_bootstrap: int = 5000, bootstrap_seed: int = 0
) -> DataFrame:
    """All condition pairs within groups and group pairs within conditions.

    ``mice``: grp, cond, metric, mouse, value.  ``auto`` pairs mice when at
    least two are shared, skips when exactly one is, and falls back to Welch.
    Percentile intervals of difference and effect size come from resampled mice
    (pairs stay together).  One Holm family over all rows.
    """
    if test not in ("auto", "paired_t", "wilcoxon", "welch", "mannwhitney"):
        raise ValueError(f"unknown test: {test}")
    rows = cut(mice.select("grp", "cond", "metric", "mouse", "value"))
    out = _compare(rows, "condition_within_group", "grp", "cond", test, True)
    if test not in ("paired_t", "wilcoxon"):
        out = out.unionByName(
            _compare(rows, "group_within_condition", "cond", "grp", test, False)
        )
    tests = cut(out.select(*_RESULT))
    intervals = bootstrap_pairwise(tests, rows, n_resamples=n_bootstrap, seed=bootstrap_seed)
    return holm_family(tests.join(intervals, _IDENTITY, "left"), "all_pairwise_comparisons_in_run")


def holm_family(tests: DataFrame, family: str, p: str = "p_value") -> DataFrame:
    """Holm over all rows, with the family's name and its number of valid tests."""
    adjusted = cut(holm(cut(tests), p))
    size = adjusted.agg(F.count_if(F.col(p).isNotNull() & ~F.isnan(F.col(p))).alias("holm_family_size"))
    return adjusted.withColumn("holm_family", F.lit(family)).join(F.broadcast(size))  # one row


_IDENTITY = ["comparison", "stratum", "metric", "level_a", "level_b", "test"]


#: Drawn members that a task holds at a time.
HELD = 1 << 20
#: Members of a side that one task may hold, and tasks that share the resamples of one group.
GATHERED, SHARES = 1 << 20, 64


def _shared_out(groups: DataFrame, n_resamples: int) -> DataFrame:
    """``groups`` once per share of the resamples ``_first .. _last - 1``, spread over the cores."""
    shares = min(SHARES, n_resamples)
    ends = [n_resamples * k // shares for k in range(shares + 1)]
    ranges = F.array(*[F.struct(F.lit(a).alias("_first"), F.lit(b).alias("_last")) for a, b in zip(ends, ends[1:])])
    tasks = 4 * groups.sparkSession.sparkContext.defaultParallelism
    return groups.withColumn("_s", F.explode(ranges)).select("*", "_s._first", "_s._last").drop("_s").repartition(
        tasks, *[c for c in groups.columns if not c.startswith("_v")], "_first")


def _values(column: pa.ChunkedArray, row: int) -> np.ndarray:
    """A row's list; missing numbers are NaN."""
    return np.asarray(column[row].values.to_numpy(zero_copy_only=False), float)


def _missing(column: pa.Array, row: int) -> np.ndarray:
    return column[row].values.is_null().to_numpy(zero_copy_only=False)


def _variance(x: np.ndarray) -> np.ndarray:
    """Sample variance by row: NaN for one value, exactly 0 for equal ones."""
    n = x.shape[1]
    if n < 2:
        return np.full(len(x), np.nan)
    moved = x - x[:, :1]  # all 0 where a row's values are equal
    total = moved.sum(axis=1)
    return np.maximum(np.einsum("ij,ij->i", moved, moved) - total * total / n, 0.0) / (n - 1)


def _rank_effects(sizes: np.ndarray, chosen: list[np.ndarray], counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per resample the sum of average ranks of ``counted`` members and of all; NaN sizes have no rank.

    ``chosen`` has the members of each resample, numbers into ``sizes``.
    """
    order = np.argsort(sizes, kind="stable")
    order = order[np.isfinite(sizes[order])]
    own, counted = sizes[order], counted[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][:len(own)])
    some, every = np.zeros(len(chosen)), np.zeros(len(chosen))
    for r, members in enumerate(chosen):
        n = np.bincount(members, minlength=len(sizes))[order]
        cnt, part = n, n * counted
        if len(first) < len(own):
            cnt, part = np.add.reduceat(n, first), np.add.reduceat(part, first)
        twice = 2 * np.cumsum(cnt) - cnt + 1  # twice the average rank, a whole number
        every[r], some[r] = (cnt * twice).sum() / 2, (part * twice).sum() / 2
    return some, every


def _resampled_comparisons(members: DataFrame, n_resamples: int, seed: int) -> DataFrame:
    """Comparison, _difference and _effect of every resample; a row per comparison goes to its tasks."""
    def side(name: str) -> Column:
        own = F.collect_list(F.when(F.col("side") == name, F.struct("mouse", "value")))
        return F.transform(F.sort_array(own), lambda m: m["value"]).alias(f"_v{name}")

    labels = [F.col(c) for c in ("comparison", "stratum", "level_a", "level_b", "metric")]
    groups = members.groupBy(*_IDENTITY).agg(*[side(x) for x in "abd"])
    groups = _shared_out(groups.withColumn("_label", label(seed, *labels)), n_resamples)
    out = pa.schema([*[(c, pa.string()) for c in _IDENTITY], ("_difference", pa.float64()), ("_effect", pa.float64())])

    def paired(test: str, x: np.ndarray, start: str, first: int, last: int):
        size = np.where(x != 0, np.abs(x), np.nan)
        for _, at in indices(start + "|d", len(x), first, last):
            drawn = x[at]
            mean = drawn.mean(axis=1)
            if test == "wilcoxon":
                plus, every = _rank_effects(size, list(at), x > 0)
                yield mean, np.where(every > 0, (2 * plus - every) / every, 0.0)
            else:
                sd = np.sqrt(_variance(drawn))
                yield mean, np.where(sd > 0, mean / sd, np.nan)

    def independent(test: str, a: np.ndarray, b: np.ndarray, start: str, first: int, last: int):
        na, nb = len(a), len(b)
        both, in_a = np.concatenate([a, b]), np.arange(na + nb) < na
        # A matrix of either side at a time, as many resamples of each.
        step = max(1, HELD // (na + nb))
        for at in range(first, last, step):
            until = min(last, at + step)
            ia, ib = (np.concatenate([m for _, m in indices(f"{start}|{s}", n, at, until)]) for s, n in (("a", na), ("b", nb)))
            xa, xb = a[ia], b[ib]
            gap = xa.mean(axis=1) - xb.mean(axis=1)
            if test == "mannwhitney":
                ranks, _ = _rank_effects(both, [np.concatenate([i, na + j]) for i, j in zip(ia, ib)], in_a)
                yield gap, 2 * (ranks - na * (na + 1) / 2) / (na * nb) - 1
            else:
                pooled = np.sqrt(((na - 1) * _variance(xa) + (nb - 1) * _variance(xb)) / max(na + nb - 2, 1))
                yield gap, np.where(pooled > 0, gap / pooled * (1 - 3 / (4 * (na + nb) - 9)), np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(invalid="ignore", divide="ignore"):
            for batch in batches:
                for r, row in enumerate(batch.drop_columns(["_va", "_vb", "_vd"]).to_pylist()):
                    a, b, d = (_values(batch[f"_v{x}"], r) for x in "abd")
                    span = row["_label"], row["_first"], row["_last"]
                    if len(d):
                        found = paired(row["test"], d, *span)
                    elif len(a) and len(b):
                        found = independent(row["test"], a, b, *span)
                    else:
                        continue
                    for difference, effect in found:
                        same = [pa.array([row[c]] * len(difference), pa.string()) for c in _IDENTITY]
                        numbers = [pa.array(v, pa.float64(), from_pandas=True) for v in (difference, effect)]
                        yield pa.RecordBatch.from_arrays([*same, *numbers], schema=out)

    with small_batches(members.sparkSession):
        return cut(groups.mapInArrow(run, ", ".join([f"{c} string" for c in _IDENTITY] + ["_difference double", "_effect double"])))


def bootstrap_pairwise(
    tests: DataFrame, mice: DataFrame, *, n_resamples: int = 5000, seed: int = 0
) -> DataFrame:
    """Intervals of difference and effect size per comparison in ``tests``.

    Slot j of resample b takes the member with a hashed index; both sides of an
    independent comparison are drawn on their own.  Comparisons whose sides have at most
    ``GATHERED`` members are resampled in tasks that share out the resamples; for larger
    ones the same resamples are an equi join.
    """
    parts = []
    for comparison, stratum, level in (
        ("condition_within_group", "grp", "cond"), ("group_within_condition", "cond", "grp"),
    ):
        own = tests.filter(F.col("comparison") == comparison).select(*_IDENTITY)
        m = mice.filter(F.col("value").isNotNull())
        sides = [
            own.join(m.select(F.col(stratum).alias("stratum"), F.col(level).alias(f"level_{x}"), "metric",
                              "mouse", "value"), ["stratum", f"level_{x}", "metric"])
            .select(*_IDENTITY, F.lit(x).alias("side"), "mouse", "value")
            for x in "ab"
        ]
        parts += sides
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = cut(rows)
    paired = F.col("test").isin("paired_t", "wilcoxon")
    in_a, in_b = F.col("side") == "a", F.col("side") == "b"
    differences = rows.filter(paired).groupBy(*_IDENTITY, "mouse").agg(
        F.max(F.when(in_a, F.col("value"))).alias("_x"), F.max(F.when(in_b, F.col("value"))).alias("_y")
    ).filter("_x is not null and _y is not null").select(
        *_IDENTITY, F.lit("d").alias("side"), "mouse", (F.col("_x") - F.col("_y")).alias("value"))
    members = rows.filter(~paired).unionByName(differences)
    members = cut(members)
    sizes = members.groupBy(*_IDENTITY, "side").count()
    many = cut(sizes.filter(F.col("count") > GATHERED).select(*_IDENTITY).distinct())
    values = _resampled_comparisons(members.join(F.broadcast(many), _IDENTITY, "left_anti"), n_resamples, seed)
    if not many.isEmpty():
        rest = members.join(F.broadcast(many), _IDENTITY)
        values = values.unionByName(_joined_comparisons(rest, n_resamples, seed))
    ends = F.array(F.lit(0.025), F.lit(0.975))
    # One value per resample, a parameter: the built-in percentile is bounded.
    q = values.groupBy(*_IDENTITY).agg(
        F.percentile("_difference", ends).alias("_d"), F.percentile("_effect", ends).alias("_e"),
        F.count("_difference").alias("bootstrap_valid_difference_resamples"),
        F.count("_effect").alias("bootstrap_valid_effect_resamples"),
    )
    return q.select(
        *_IDENTITY,
        F.col("_d")[0].alias("difference_ci_lower_bootstrap"), F.col("_d")[1].alias("difference_ci_upper_bootstrap"),
        F.col("_e")[0].alias("effect_size_ci_lower_bootstrap"), F.col("_e")[1].alias("effect_size_ci_upper_bootstrap"),
        F.lit(n_resamples).alias("bootstrap_resamples"), "bootstrap_valid_difference_resamples",
        "bootstrap_valid_effect_resamples", F.lit(seed).alias("bootstrap_seed"),
    )


def _joined_comparisons(members: DataFrame, n_resamples: int, seed: int) -> DataFrame:
    """Comparison, _difference and _effect of every resample, drawn by a join."""
    place = Window.partitionBy(*_IDENTITY, "side").orderBy("mouse")
    members = cut(members.withColumns({
        "_slot": F.row_number().over(place) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*_IDENTITY, "side")),
    }))
    slots = members.drop("value", "mouse").withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))))
    labels = [F.col(c) for c in ("comparison", "stratum", "level_a", "level_b", "metric", "side", "_b", "_slot")]
    slots = slots.withColumn("_at", index_below(F.col("_n"), seed, *labels)).drop("_slot")
    chosen = members.select(*_IDENTITY, "side", F.col("_slot").cast("bigint").alias("_at"), "value")
    drawn = slots.join(chosen, [*_IDENTITY, "side", "_at"])
    draw = [*_IDENTITY, "_b"]
    # Average ranks: of all values for Mann-Whitney, of non-zero sizes for Wilcoxon.
    size = F.when(F.col("test") == "mannwhitney", F.col("value")).when(F.col("value") != 0, F.abs("value"))
    ranked = drawn.withColumn("_size", size)
    ties = Window.partitionBy(*draw, "_size")
    rank = F.rank().over(Window.partitionBy(*draw).orderBy(F.col("_size").asc_nulls_last()))
    by_rank = F.col("test").isin("wilcoxon", "mannwhitney") & F.col("_size").isNotNull()
    ranked = ranked.withColumn("_rank", F.when(by_rank, rank + (F.count(F.lit(1)).over(ties) - 1) / 2))

    def over(side, f):
        return f(F.when(F.col("side") == side, F.col("value")))

    g = ranked.groupBy(*draw).agg(
        over("d", F.avg).alias("d"), over("d", F.stddev_samp).alias("sd"),
        over("a", F.avg).alias("ma"), over("b", F.avg).alias("mb"),
        over("a", F.count).alias("na"), over("b", F.count).alias("nb"),
        over("a", F.var_samp).alias("va"), over("b", F.var_samp).alias("vb"),
        F.sum(F.when(F.col("side") == "a", F.col("_rank"))).alias("ra"),
        F.sum(F.when(F.col("value") > 0, F.col("_rank"))).alias("plus"), F.sum("_rank").alias("all"),
    )
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    gap = F.col("ma") - F.col("mb")
    small = 1 - 3 / (4 * (F.col("na") + F.col("nb")) - 9)
    u = F.col("ra") - F.col("na") * (F.col("na") + 1) / 2
    effect = (
        F.when(F.col("test") == "paired_t", F.when(F.col("sd") > 0, F.col("d") / F.col("sd")))
        .when(F.col("test") == "wilcoxon", F.coalesce((2 * F.coalesce("plus", F.lit(0.0)) - F.col("all")) / F.col("all"), F.lit(0.0)))
        .when(F.col("test") == "mannwhitney", 2 * u / (F.col("na") * F.col("nb")) - 1)
        .otherwise(F.when(pooled > 0, gap / pooled * small))
    )
    return g.select(*_IDENTITY, F.coalesce("d", gap).alias("_difference"), effect.alias("_effect"))


def bootstrap_mean_interval(
    values: DataFrame,
    keys: list[str],
    *,
    n_resamples: int = 5000,
    seed: int = 0,
    value: str = "value",
    order: str = "mouse",
) -> DataFrame:
    """Percentile interval of resampled means.

    Slot j of resample b takes the member with a hashed index.  Groups of at most
    ``GATHERED`` members are resampled in tasks that share out the resamples; for larger
    ones the same resamples are an equi join on (group, index), and none is gathered.
    """
    rows = cut(values.select(*keys, order, value))
    n = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))

    def of_size(fits: Column) -> DataFrame:
        return rows.join(F.broadcast(n.filter(fits).select(*keys)), keys)  # a row per group

    means = _resampled_means(of_size(F.col("_n") <= GATHERED), keys, n_resamples, seed, value, order)
    if not n.filter(F.col("_n") > GATHERED).isEmpty():
        means = means.unionByName(_joined_means(of_size(F.col("_n") > GATHERED), n, keys, n_resamples, seed, value, order))
    # One row per resample, a parameter: the built-in percentile is bounded.
    q = F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy(*keys).agg(q.alias("_q"), F.count("_m").alias("n_resamples")).select(
        *keys, F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"), "n_resamples"
    )


def _resampled_means(
    rows: DataFrame, keys: list[str], n_resamples: int, seed: int, value: str, order: str
) -> DataFrame:
    """keys and the mean ``_m`` of every resample; a row per group goes to its tasks."""
    members = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))))
    groups = rows.groupBy(*keys).agg(F.transform(members, lambda m: m["v"]).alias("_v"))
    groups = _shared_out(groups.withColumn("_label", label(seed, *[F.col(k) for k in keys])), n_resamples)
    result = StructType([*[groups.schema[k] for k in keys], StructField("_m", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, (start, first, last) in enumerate(zip(*(batch[c].to_pylist() for c in ("_label", "_first", "_last")))):
                x = _values(batch["_v"], r)
                known = ~_missing(batch["_v"], r)
                for _, at in indices(start, len(x), first, last):
                    n = known[at].sum(axis=1)
                    total = np.where(known, x, 0.0)[at].sum(axis=1)
                    mean = [t / c if c else None for t, c in zip(total.tolist(), n.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [*[batch[k].take(pa.array([r] * len(mean))) for k in keys], pa.array(mean, pa.float64())],
                        names=[*keys, "_m"])

    with small_batches(rows.sparkSession):
        return cut(groups.mapInArrow(run, result))


def _joined_means(
    rows: DataFrame, n: DataFrame, keys: list[str], n_resamples: int, seed: int, value: str, order: str
) -> DataFrame:
    """keys and the mean ``_m`` of every resample, drawn by a join."""
    from eventide.core.series import index_rows

    members = index_rows(rows, Series(tuple(keys), order, None), "_i")
    slots = members.join(n, keys).select(
        *keys, F.col("_i").alias("_slot"), "_n",
        F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))).alias("_b"),
    )
    slots = slots.withColumn(
        "_i", index_below(F.col("_n"), seed, *[F.col(k) for k in keys], F.col("_b"), F.col("_slot"))
    )
    return (
        slots.join(members.select(*keys, "_i", value), [*keys, "_i"])
        .groupBy(*keys, "_b")
        .agg(F.avg(value).alias("_m"))
        .drop("_b")
    )


def mean_t_interval(mice: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, SEM and half width of the 95 % t interval (NULL below two mice)."""
    g = mice.groupBy(*keys).agg(
        F.avg("value").alias("mean"),
        (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("sem"),
        F.count("value").alias("n"),
    )
    return g.withColumn(
        "half_width",
        F.when(F.col("n") > 1, t_ppf_975((F.col("n") - 1).cast("double")) * F.col("sem")),
    )


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Spearman correlation: Pearson of average ranks."""
    x = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ra = distribution(x, keys, a).select(*keys, a, average_rank().alias("_ra"))
    rb = distribution(x, keys, b).select(*keys, b, average_rank().alias("_rb"))
    return (
        x.join(ra, [*keys, a])
        .join(rb, [*keys, b])
        .groupBy(*keys)
        .agg(F.corr("_ra", "_rb").alias("rho"), F.count(F.lit(1)).alias("n"))
    )


def mad_noise(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """1.4826 times the median absolute deviation."""
    from eventide.core.ranks import percentiles

    med = percentiles(df, keys, value, {"med": 0.5}).drop("n")
    dev = df.join(med, keys).withColumn("_dev", F.abs(F.col(value) - F.col("med")))
    mad = percentiles(dev, keys, "_dev", {"mad": 0.5})
    return mad.join(med, keys).select(*keys, "med", (1.4826 * F.col("mad")).alias("noise"))
