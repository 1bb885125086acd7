"""Exact ranks and percentiles of groups of any size.

Equal values are merged first (``groupBy(keys, value)`` combines map-side and
spreads a hot group over all partitions), the distinct values are cut into
cells, and a running count inside cells plus a summary per cell yields the
number of smaller values.  No group is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.core.lineage import cut
from eventide.core.series import BLOCK, Series, with_block

#: Accuracy of the sketch that narrows a percentile down.
SKETCH = 10_000


def distribution(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    width: float | None = None,
    weights: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Cumulative distribution: ``keys, value, cnt, below, n`` per distinct value.

    ``weights`` adds further sums ``w`` with their ``below_w`` and ``n_w``.
    NULL values are left out.
    """
    keys = list(keys)
    weights = dict(weights or {})
    names = ["cnt", *weights]
    s = Series(tuple(keys), value, width)
    merged = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("cnt"), *[F.sum(e).alias(o) for o, e in weights.items()])
    )
    b = with_block(merged, s)
    before = Window.partitionBy(*keys, BLOCK).orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1
    )
    cells = b.groupBy(*keys, BLOCK).agg(*[F.sum(c).alias(f"_c_{c}") for c in names])
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    cells = cells.select(
        *keys,
        BLOCK,
        *[F.sum(f"_c_{c}").over(earlier).alias(f"_p_{c}") for c in names],
        *[F.sum(f"_c_{c}").over(whole).alias(f"_n_{c}") for c in names],
    )
    local = b.withColumns({f"_l_{c}": F.sum(c).over(before) for c in names})

    def label(prefix: str, c: str) -> str:
        return prefix if c == "cnt" else f"{prefix}_{c}"

    return local.join(cells, [*keys, BLOCK]).select(
        *keys,
        value,
        *names,
        *[
            (F.coalesce(f"_l_{c}", F.lit(0)) + F.coalesce(f"_p_{c}", F.lit(0))).alias(
                label("below", c)
            )
            for c in names
        ],
        *[F.col(f"_n_{c}").alias(label("n", c)) for c in names],
    )


def at_positions(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    positions: Mapping[str, str],
    *,
    width: float | None = None,
) -> DataFrame:
    """Values at fractional zero-based positions of the sorted group.

    A position is a SQL expression of the group size ``n``; between two ranks
    the value is interpolated linearly.
    """
    d = distribution(df, keys, value, width=width)

    def at(k: str) -> str:
        return f"max(IF(below <= {k} AND {k} < below + cnt, {value}, NULL))"

    g = d.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.expr(f"{at(f'floor({p})')} AS _lo_{o}") for o, p in positions.items()],
        *[F.expr(f"{at(f'ceil({p})')} AS _hi_{o}") for o, p in positions.items()],
    )
    return g.selectExpr(
        *keys,
        "n",
        *[
            f"_lo_{o} + (_hi_{o} - _lo_{o}) * (({p}) - floor({p})) AS {o}"
            for o, p in positions.items()
        ],
    )


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    *,
    width: float | None = None,
) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group."""
    positions = {o: f"{float(p)!r}D * (n - 1)" for o, p in probabilities.items()}
    return at_positions(df, keys, value, positions, width=width)


def percentile_of_few_groups(
    df: DataFrame, keys: Sequence[str], value: str, out: str, p: float, also: Sequence[Column] = (),
) -> DataFrame:
    """Exact percentile of a table of many rows and few groups (a row per group is broadcast): keys, out and ``also``.

    The table is read twice and not shuffled, so it need not be written either.  The first time a sketch
    with a known error of rank names two ends around the percentile, and the aggregates ``also`` are made;
    the second time what lies below the ends is counted, and only the values between them are ranked.
    """
    keys = list(keys)
    ends = F.percentile_approx(value, [max(0.0, p - 3 / SKETCH), min(1.0, p + 3 / SKETCH)], SKETCH)
    first = cut(df.groupBy(*keys).agg(*also, F.count(value).alias("_all"), ends.alias("_e")))
    ends = first.select(*keys, "_all", F.col("_e")[0].alias("_from"), F.col("_e")[1].alias("_to"))
    known = df.filter(F.col(value).isNotNull()).select(*keys, value)
    # One pass: values between the ends with their numbers, and NULL with the number of those below.
    own = F.when(F.col(value) >= F.col("_from"), F.col(value)).alias(value)
    placed = cut(known.join(F.broadcast(ends), keys).filter(F.col(value) <= F.col("_to")).groupBy(*keys, "_all", own).agg(
        F.count(F.lit(1)).alias("_w")))
    less = placed.filter(F.col(value).isNull()).select(*keys, F.col("_w").alias("_less"))
    inside = distribution(placed, keys, value, weights={"_w": F.col("_w")}).select(*keys, value, "_w", "below__w")
    d = inside.join(F.broadcast(ends.select(*keys, "_all")), keys).join(F.broadcast(less), keys, "left").withColumn(
        "_before", F.col("below__w") + F.coalesce("_less", F.lit(0)))
    position = f"({float(p)!r}D * (_all - 1))"

    def at(k: str) -> str:
        return f"max(IF(_before <= {k} AND {k} < _before + _w, {value}, NULL))"

    found = cut(d.groupBy(*keys, "_all").agg(
        F.expr(f"{at(f'floor{position}')} AS _lo"), F.expr(f"{at(f'ceil{position}')} AS _hi")))
    if not found.filter("_lo IS NULL OR _hi IS NULL").isEmpty():  # outside the ends
        found = percentiles(df, keys, value, {out: p}).select(*keys, out)
    else:
        found = found.selectExpr(*keys, f"_lo + (_hi - _lo) * ({position} - floor{position}) AS {out}")
    return first.drop("_all", "_e").join(F.broadcast(found), keys, "left")


def average_rank() -> Column:
    """Average rank (1-based) of a value in a ``distribution`` table."""
    return F.col("below") + (F.col("cnt") + 1) / 2.0
