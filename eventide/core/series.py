"""Ordered series that are cut into time blocks.

A window over one whole series puts that series into one task, which fails as
soon as one subject holds a large share of all rows.  Every ordered operator in
this package therefore works on *blocks*: rows are hash partitioned on
``(keys, block)`` with ``block = floor(t / width)``, the window runs inside a
block, and what has to cross a block border (the previous row, a running total,
the last known sample) travels through a summary with one row per block.  The
rows are shuffled once, the summaries are small and pre-aggregated map-side.

The block width changes the cost of a plan and never its result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "_block"
_QUERY = "_is_query"


@dataclass(frozen=True)
class Series:
    """Layout of a table of ordered series.

    ``keys`` identify one series, ``t`` orders its rows (strictly increasing
    within a series) and ``width`` is the block width in units of ``t``.  A
    width of ``None`` cuts the axis into logarithmic cells, which needs no
    knowledge of the value range.
    """

    keys: tuple[str, ...]
    t: str = "t"
    width: float | None = 3600.0

    def with_keys(self, *keys: str) -> Series:
        return replace(self, keys=tuple(keys))

    def block_sql(self) -> str:
        if self.width is None:
            # log1p is semi-monotonic, so cells never overlap.
            return (
                f"CAST(signum({self.t}) * floor(log1p(abs({self.t}) * 1e9D) * 6000D) AS BIGINT)"
            )
        return f"CAST(floor({self.t} / {float(self.width)!r}D) AS BIGINT)"


def suggest_width(
    df: DataFrame,
    keys: Sequence[str],
    t: str = "t",
    *,
    coarse: float = 3600.0,
    target_rows: int = 1_000_000,
) -> float:
    """Block width that keeps the densest block near ``target_rows`` rows.

    One column-pruned aggregation; a single number reaches the driver.
    """
    cells = df.groupBy(*keys, F.floor(F.col(t) / F.lit(coarse)).alias("_c")).count()
    row = cells.agg(F.max("count").alias("m")).first()
    densest = int(row["m"] or 1)
    return coarse * max(target_rows / densest, 1e-6)


def with_block(df: DataFrame, s: Series) -> DataFrame:
    return df.selectExpr("*", f"{s.block_sql()} AS {BLOCK}")


def _inside(s: Series, order: str) -> str:
    return f"PARTITION BY {', '.join([*s.keys, BLOCK])} ORDER BY {order}"


def _across(s: Series, *, descending: bool = False) -> str:
    keys = f"PARTITION BY {', '.join(s.keys)} " if s.keys else ""
    return f"{keys}ORDER BY {BLOCK} {'DESC' if descending else 'ASC'}"


UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
EARLIER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _summary(blocked: DataFrame, s: Series, aggregates: list[str], carried: list[str]) -> DataFrame:
    """One row per block, then what every block takes over from the others."""
    keys = [*s.keys, BLOCK]
    parts = blocked.groupBy(*keys).agg(*[F.expr(a) for a in aggregates])
    return parts.selectExpr(*keys, *carried)


def shift(
    df: DataFrame,
    s: Series,
    *,
    back: Mapping[str, str] | None = None,
    ahead: Mapping[str, str] | None = None,
) -> DataFrame:
    """Value of the neighbouring row: ``{new column: source column}``.

    Equals ``lag`` / ``lead`` over the whole series.
    """
    back, ahead = dict(back or {}), dict(ahead or {})
    b = with_block(df, s)
    w, over = _inside(s, s.t), _across(s)
    edges = _summary(
        b,
        s,
        [f"max_by({c}, {s.t}) AS _b_{o}" for o, c in back.items()]
        + [f"min_by({c}, {s.t}) AS _a_{o}" for o, c in ahead.items()],
        [f"lag(_b_{o}) OVER ({over}) AS _b_{o}" for o in back]
        + [f"lead(_a_{o}) OVER ({over}) AS _a_{o}" for o in ahead],
    )
    local = b.selectExpr(
        "*",
        *[f"lag({c}) OVER ({w}) AS _lb_{o}" for o, c in back.items()],
        *[f"lead({c}) OVER ({w}) AS _la_{o}" for o, c in ahead.items()],
        *([f"lag({s.t}) OVER ({w}) IS NULL AS _first"] if back else []),
        *([f"lead({s.t}) OVER ({w}) IS NULL AS _last"] if ahead else []),
    )
    kept = [c for c in df.columns if c not in back and c not in ahead]
    return local.join(edges, [*s.keys, BLOCK]).selectExpr(
        *kept,
        *[f"IF(_first, _b_{o}, _lb_{o}) AS {o}" for o in back],
        *[f"IF(_last, _a_{o}, _la_{o}) AS {o}" for o in ahead],
    )


def running(
    df: DataFrame,
    s: Series,
    sums: Mapping[str, str] | None = None,
    maxima: Mapping[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums / maxima of SQL expressions over the whole series."""
    sums, maxima = dict(sums or {}), dict(maxima or {})
    b = with_block(df, s)
    w, over = f"{_inside(s, s.t)} {UPTO}", f"{_across(s)} {EARLIER}"
    parts = _summary(
        b,
        s,
        [f"sum({e}) AS _p_{o}" for o, e in sums.items()]
        + [f"max({e}) AS _p_{o}" for o, e in maxima.items()],
        [f"sum(_p_{o}) OVER ({over}) AS _p_{o}" for o in sums]
        + [f"max(_p_{o}) OVER ({over}) AS _p_{o}" for o in maxima],
    )
    local = b.selectExpr(
        "*",
        *[f"sum({e}) OVER ({w}) AS _s_{o}" for o, e in sums.items()],
        *[f"max({e}) OVER ({w}) AS _s_{o}" for o, e in maxima.items()],
    )
    kept = [c for c in df.columns if c not in sums and c not in maxima]
    return local.join(parts, [*s.keys, BLOCK]).selectExpr(
        *kept,
        *[f"_s_{o} + coalesce(_p_{o}, 0) AS {o}" for o in sums],
        *[f"greatest(_s_{o}, _p_{o}) AS {o}" for o in maxima],
    )


def runs(
    df: DataFrame,
    s: Series,
    starts: str,
    *,
    before: Mapping[str, str],
    using: Sequence[str] = (),
    run: str = "_run",
    position: str = "_pos",
) -> DataFrame:
    """Number the runs of a series: a run starts where ``starts`` holds.

    ``starts`` is a SQL condition on the row and on the previous row, whose
    columns appear under the names of ``before`` (``{name: column}``); the
    first row always starts a run.  ``using`` lists further columns of the row
    in the condition.  Adds the 1-based run number and row position.

    Flags, lags and counts share one summary, so the rows are scanned once.
    """
    before = dict(before)
    w, over = _inside(s, s.t), _across(s)
    lagged = with_block(df, s).selectExpr(
        "*",
        *[f"lag({c}) OVER ({w}) AS {o}" for o, c in before.items()],
        f"row_number() OVER ({w}) AS _rn",
    )
    local = lagged.selectExpr(
        *df.columns,
        BLOCK,
        "_rn",
        f"sum(IF(_rn > 1 AND coalesce({starts}, true), 1L, 0L)) OVER ({w} {UPTO}) AS _inner",
    )
    keys = [*s.keys, BLOCK]
    current = sorted({*using, s.t})
    parts = local.groupBy(*keys).agg(
        F.max("_inner").alias("_inner"),
        F.count("*").alias("_n"),
        *[F.expr(f"min_by({c}, {s.t}) AS _cur_{c}") for c in current if c != s.t],
        F.expr(f"min({s.t}) AS _cur_{s.t}"),
        *[F.expr(f"max_by({c}, {s.t}) AS _last_{o}") for o, c in before.items()],
    )
    parts = parts.selectExpr(
        *keys,
        "_inner",
        "_n",
        *[f"_cur_{c} AS {c}" for c in current],
        *[f"lag(_last_{o}) OVER ({over}) AS {o}" for o in before],
    ).selectExpr(*keys, "_n", "_inner", f"IF(coalesce({starts}, true), 1L, 0L) AS _opens")
    parts = parts.selectExpr(
        *keys,
        "_opens",
        f"coalesce(sum(_inner + _opens) OVER ({over} {EARLIER}), 0L) AS _runs_before",
        f"coalesce(sum(_n) OVER ({over} {EARLIER}), 0L) AS _rows_before",
    )
    return local.join(parts, keys).selectExpr(
        *df.columns,
        f"_runs_before + _opens + _inner AS {run}",
        f"_rows_before + _rn AS {position}",
    )


def index_rows(df: DataFrame, s: Series, out: str = "i") -> DataFrame:
    """Zero-based position of every row in its series."""
    kept = [c for c in df.columns if c != out]
    return running(df, s, {"_pos": "1L"}).selectExpr(*kept, f"_pos - 1 AS {out}")


def asof(
    queries: DataFrame,
    samples: DataFrame,
    s: Series,
    *,
    back: Mapping[str, str] | None = None,
    ahead: Mapping[str, str] | None = None,
    totals: Mapping[str, str] | None = None,
    back_inclusive: bool = True,
    ahead_inclusive: bool = True,
) -> DataFrame:
    """Attach the neighbouring samples of every query point.

    ``back`` takes columns from the last sample at or before the query time,
    ``ahead`` from the first one at or after it, ``totals`` sums a SQL
    expression over all samples up to the query time (with the bound of
    ``back``).  Work is linear in queries plus samples, whatever the density of
    either side: both are laid into one table, cut in blocks and scanned; no
    pair is formed.
    """
    back, ahead, totals = dict(back or {}), dict(ahead or {}), dict(totals or {})
    keys = [*s.keys, BLOCK]
    bc, ac = sorted(set(back.values())), sorted(set(ahead.values()))
    right = samples.selectExpr(
        *s.keys,
        s.t,
        *[f"{c} AS _v_{c}" for c in sorted({*bc, *ac})],
        *[f"{e} AS _x_{o}" for o, e in totals.items()],
        f"0 AS {_QUERY}",
    )
    both = queries.selectExpr("*", f"1 AS {_QUERY}").unionByName(right, allowMissingColumns=True)
    b = with_block(both, s)

    at = f"IF({_QUERY} = 0, {s.t}, NULL)"
    aggregates, carried, local, results = [], [], [], []
    made = {*back, *ahead, *totals}
    if back:
        tie = "ASC" if back_inclusive else "DESC"
        w = f"{_inside(s, f'{s.t} ASC, {_QUERY} {tie}')} {UPTO}"
        aggregates += [f"max({at}) AS _bt"] + [f"max_by(_v_{c}, {at}) AS _b_{c}" for c in bc]
        row = ", ".join(["_bt AS _t", *[f"_b_{c} AS {c}" for c in bc]])
        carried.append(
            f"last(IF(_bt IS NULL, NULL, struct({row})), true) "
            f"OVER ({_across(s)} {EARLIER}) AS _back"
        )
        row = ", ".join([f"{s.t} AS _t", *[f"_v_{c} AS {c}" for c in bc]])
        local.append(f"last(IF({_QUERY} = 0, struct({row}), NULL), true) OVER ({w}) AS _lback")
        results += [f"coalesce(_lback, _back).{c} AS {o}" for o, c in back.items()]
    if ahead:
        tie = "ASC" if ahead_inclusive else "DESC"
        w = f"{_inside(s, f'{s.t} DESC, {_QUERY} {tie}')} {UPTO}"
        aggregates += [f"min({at}) AS _at"] + [f"min_by(_v_{c}, {at}) AS _a_{c}" for c in ac]
        row = ", ".join(["_at AS _t", *[f"_a_{c} AS {c}" for c in ac]])
        carried.append(
            f"last(IF(_at IS NULL, NULL, struct({row})), true) "
            f"OVER ({_across(s, descending=True)} {EARLIER}) AS _ahead"
        )
        row = ", ".join([f"{s.t} AS _t", *[f"_v_{c} AS {c}" for c in ac]])
        local.append(f"last(IF({_QUERY} = 0, struct({row}), NULL), true) OVER ({w}) AS _lahead")
        results += [f"coalesce(_lahead, _ahead).{c} AS {o}" for o, c in ahead.items()]
    if totals:
        tie = "ASC" if back_inclusive else "DESC"
        w = f"{_inside(s, f'{s.t} ASC, {_QUERY} {tie}')} {UPTO}"
        aggregates += [f"sum(_x_{o}) AS _p_{o}" for o in totals]
        carried += [f"sum(_p_{o}) OVER ({_across(s)} {EARLIER}) AS _p_{o}" for o in totals]
        local += [f"sum(_x_{o}) OVER ({w}) AS _l_{o}" for o in totals]
        results += [f"coalesce(_l_{o}, 0) + coalesce(_p_{o}, 0) AS {o}" for o in totals]
    parts = _summary(b, s, aggregates, carried)
    kept = [c for c in queries.columns if c not in made]
    scanned = b.selectExpr(*kept, *([BLOCK] if BLOCK not in kept else []), _QUERY, *local)
    # Rows exploded above a small exchange look small to adaptive execution; they must not be broadcast.
    return (
        scanned.filter(f"{_QUERY} = 1").join(parts.hint("merge"), keys).selectExpr(*kept, *results)
    )


def halo_rows(df: DataFrame, s: Series, before: int, after: int) -> DataFrame:
    """Row blocks that also hold a fixed number of neighbours.

    ``s.t`` must be the zero-based row index.  Adds ``_block`` and ``_own``;
    rows near a border are copied to the adjoining block with ``_own`` false,
    so a frame of at most ``before`` / ``after`` rows can be evaluated inside
    the block.  The width has to be at least as large as the halo.
    """
    width = int(s.width)
    if before > width or after > width:
        raise ValueError("the block width must not be smaller than the halo")
    i = F.col(s.t)
    home = F.floor(i / width).cast("bigint")
    offset = F.pmod(i, F.lit(width))
    nxt = F.when(offset >= width - before, home + 1) if before else F.lit(None).cast("bigint")
    prv = F.when(offset < after, home - 1) if after else F.lit(None).cast("bigint")
    return (
        df.withColumn(BLOCK, F.explode(F.array_compact(F.array(home, nxt, prv))))
        .withColumn("_own", F.col(BLOCK) == home)
    )
