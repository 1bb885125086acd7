"""Session manifests: CSV scans with loud checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.core.checks import ContractError, require_columns, require_none, require_rows

REQUIRED = ("mouse", "date", "run")
EDITOR_COLUMNS = ("mouse", "date", "run", "group", "condition", "channel")
# Columns of the lifetime manifests.
LIFETIME_COMMON = ("mouse", "date", "run", "group", "condition")
LIFETIME_PATHS = {
    "fluopulse": ("doric_path", "nidaq_path", "running_path"),
    "iflip3": ("iflip_path", "background_path", "nidaq_path", "running_path"),
}


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV as trimmed text; byte-order mark dropped, blank rows removed."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    if not raw.columns:
        raise ContractError("manifest is missing a header row")
    names = [c.lstrip("﻿").strip() for c in raw.columns]
    t = raw.toDF(*names)
    t = t.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in names])
    filled = F.lit(False)
    for c in names:
        filled = filled | (F.col(f"`{c}`") != "")
    return t.filter(filled)


def normalise(rows: DataFrame) -> DataFrame:
    """Trim keys, cast run; ``date`` stays text so leading zeros survive."""
    require_columns(rows, REQUIRED, "session manifest")
    t = rows.withColumns({c: F.trim(F.col(c).cast("string")) for c in ("mouse", "date")})
    return t.withColumn("run", F.expr("try_cast(trim(CAST(run AS STRING)) AS INT)"))


def invalid(rows: DataFrame) -> DataFrame:
    """Rows with an empty key or a run that is not a non-negative integer."""
    return normalise(rows).filter(
        (F.coalesce("mouse", F.lit("")) == "")
        | (F.coalesce("date", F.lit("")) == "")
        | F.col("run").isNull()
        | (F.col("run") < 0)
    )


def duplicates(rows: DataFrame, *, fold_case: bool = False) -> DataFrame:
    """Sessions that occur more than once, with their number of rows."""
    mouse = F.lower("mouse") if fold_case else F.col("mouse")
    return (
        normalise(rows)
        .groupBy(mouse.alias("mouse"), "date", "run")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )


def load(spark: SparkSession, path: str) -> DataFrame:
    rows = read_text_table(spark, path)
    require_columns(rows, REQUIRED, "session manifest")
    require_rows(rows, "session manifest contains no sessions")
    require_none(invalid(rows), "session manifest has an invalid row")
    require_none(duplicates(rows), "session manifest contains a duplicate session")
    return normalise(rows)


def load_lifetime(spark: SparkSession, path: str, workflow: str) -> DataFrame:
    """Lifetime manifest: six-digit dates, mouse unique whatever its case."""
    if workflow not in LIFETIME_PATHS:
        raise ContractError(f"unknown workflow: {workflow}")
    rows = read_text_table(spark, path)
    require_rows(rows, "lifetime manifest contains no sessions")
    require_none(invalid(rows), "lifetime manifest has an invalid row")
    require_none(rows.filter(~F.col("date").rlike("^[0-9]{6}$")), "dates must have six digits")
    require_none(duplicates(rows, fold_case=True), "lifetime manifest contains a duplicate session")
    wanted = (*LIFETIME_COMMON, *LIFETIME_PATHS[workflow])
    have = normalise(rows)
    return have.select(*[F.col(c) if c in have.columns else F.lit("").alias(c) for c in wanted])


def channel(column: Column | str = "channel") -> Column:
    """Channel 1 or 2; blank means 1, anything else NULL."""
    c = F.trim((F.col(column) if isinstance(column, str) else column).cast("string"))
    number = c.try_cast("int")
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(1)).when(number.isin(1, 2), number)


def editor_rows(rows: DataFrame) -> DataFrame:
    """Rows of the manifest editor: six columns, channel 1 or 2."""
    t = normalise(rows)
    t = t.select(*[F.col(c) if c in t.columns else F.lit("").alias(c) for c in EDITOR_COLUMNS])
    require_none(invalid(t), "manifest has an invalid row")
    require_none(duplicates(t), "manifest contains a duplicate session")
    t = t.withColumn("channel", channel())
    require_none(t.filter("channel IS NULL"), "channel must be 1 or 2")
    return t


def select_sessions(rows: DataFrame, *, group: str | None = None, condition: str | None = None) -> DataFrame:
    """Case-folded, trimmed equality on group and condition."""
    for column, wanted in (("group", group), ("condition", condition)):
        if wanted is not None:
            rows = rows.filter(F.lower(F.trim(F.col(f"`{column}`"))) == wanted.strip().lower())
    return rows


def require_one_group(rows: DataFrame) -> None:
    """A mouse may belong to one group only."""
    bad = rows.groupBy("mouse").agg(F.countDistinct("group").alias("n")).filter("n > 1")
    require_none(bad, "a mouse belongs to several groups")
