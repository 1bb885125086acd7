"""Writers of canonical and exported tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Columns that queries filter on; rows lie in their order, so file statistics skip the others.
_SORTED = {"signals": ["signal"], "events": ["event"], "intervals": ["name"]}


def write_sessions(tables: dict[str, DataFrame], root: str) -> None:
    """Canonical tables as Parquet, one partition per session; a session is replaced as a whole.

    ``overwrite`` with dynamic partitions replaces the sessions that are written and no others;
    Spark's commit protocol makes each table appear whole.  A session that is in one of the
    tables and has no rows (signals, events, intervals) in another loses its old ones there.
    """
    written = None
    for name, df in tables.items():
        order = ["session_id", *[c for c in _SORTED.get(name, []) if c in df.columns]]
        # Rebalanced, so a session of very many rows is written by several tasks.
        (df.hint("rebalance", "session_id").sortWithinPartitions(*order).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(f"{root}/{name}"))
        ids = df.select("session_id").distinct()
        written = ids if written is None else written.unionByName(ids)
    if len(tables) > 1:
        written = written.distinct()
        for name, df in tables.items():
            _remove(df.sparkSession, f"{root}/{name}", written.join(df.select("session_id").distinct(), "session_id", "left_anti"))


def _remove(spark, folder: str, sessions: DataFrame) -> None:
    """Delete the partitions of sessions without rows; one number or name at a time reaches the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    quoted = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for row in sessions.toLocalIterator():
        part = path(folder, "session_id=" + quoted.escapePathName(str(row["session_id"])))
        if files.exists(part):
            files.delete(part, True)


def pending(manifest: DataFrame, done: DataFrame, keys: list[str], *, overwrite: bool = False) -> DataFrame:
    """Sessions still to process (skip existing results unless overwritten)."""
    return manifest if overwrite else manifest.join(done.select(*keys).distinct(), keys, "left_anti")


def blank_missing(df: DataFrame) -> DataFrame:
    """Non-finite numbers become blank cells of a CSV."""
    def clean(f):
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() in ("double", "float"):
            return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(f.name)
        return c

    return df.select(*[clean(f) for f in df.schema])


def write_csv(df: DataFrame, path: str, *, compression: str | None = None) -> None:
    writer = blank_missing(df).write.mode("overwrite").option("header", True).option("nullValue", "")
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)


def wide_traces(mouse_traces: DataFrame, columns: list[str]) -> DataFrame:
    """One row per time point, one column per ``group__condition__mouse``."""
    label = F.concat_ws("__", "grp", "cond", F.col("mouse").cast("string"))
    return (
        mouse_traces.withColumn("_c", label).groupBy("rel_t").pivot("_c", columns).agg(F.max("v"))
    )


def saved_traces(spark, root: str) -> DataFrame:
    """Exported time courses below a root; blank cells are missing values."""
    return (
        spark.read.option("header", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv").option("inferSchema", False).csv(root)
    )


def trace_conflicts(traces: DataFrame, identity: list[str], session: list[str]) -> DataFrame:
    """Sessions exported twice with different values (equal copies are fine)."""
    v = F.col("value").cast("double")
    g = traces.groupBy(*identity, *session, "time_s").agg(
        F.min(v).alias("_a"), F.max(v).alias("_b"), F.count(F.lit(1)).alias("_n")
    )
    close = F.abs(F.col("_a") - F.col("_b")) <= 1e-10 + 1e-8 * F.abs("_b")
    return g.filter((F.col("_n") > 1) & ~F.coalesce(close, F.lit(True)))


def one_identity(traces: DataFrame, identity: list[str]) -> DataFrame:
    """Distinct analysis settings of the exports; more than one is an error."""
    return traces.select(*identity).distinct()
