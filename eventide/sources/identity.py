"""Session identity and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File-name patterns of the recorders (date is YYMMDD).
PATTERNS = {
    "date_first": r"^([0-9]{6})_(.+)_run([0-9]+)_[0-9]+\.doric$",
    "mouse_first": r"^(.+)_([0-9]{6})_run([0-9]+)_[0-9]+\.doric$",
    "iflip": r"^(.+)_([0-9]{6})_?([0-9]{3})\.iFLiP3$",
    "nidaq": r"^(.+)-([0-9]{6})-([0-9]{3})-(?:nidaq|running)\.mat$",
}


def file_name(path: Column | str) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(p, r"([^/\\]+)$", 1)


def identity(path: Column | str) -> Column:
    """Struct ``mouse, date, run`` parsed from a file name, NULL if unknown."""
    name = file_name(path)

    def parts(kind: str, mouse: int, date: int) -> Column:
        p = PATTERNS[kind]
        return F.when(
            F.regexp_extract(name, p, 0) != "",
            F.struct(
                F.regexp_extract(name, p, mouse).alias("mouse"),
                F.regexp_extract(name, p, date).alias("date"),
                F.regexp_extract(name, p, 3).cast("int").alias("run"),
            ),
        )

    return F.coalesce(
        parts("date_first", 2, 1), parts("mouse_first", 1, 2), parts("iflip", 1, 2), parts("nidaq", 1, 2)
    )


def session_id(mouse: Column, date: Column, run: Column) -> Column:
    return F.format_string("%s_%s_run%03d", mouse, date, run.cast("int"))


def nidaq_path(root: str, mouse: Column, date: Column, run: Column, kind: str = "nidaq") -> Column:
    return F.format_string(
        f"{root}/%s/%s_%s/%s-%s-%03d-{kind}.mat", mouse, mouse, date, mouse, date, run.cast("int")
    )


def iflip_path(root: str, mouse: Column, date: Column, run: Column, *, legacy: bool = False) -> Column:
    joint = "" if legacy else "_"
    return F.format_string(
        f"{root}/%s/%s_%s/%s_%s{joint}%03d.iFLiP3", mouse, mouse, date, mouse, date, run.cast("int")
    )


def discover(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files below a root with their parsed identity; no content is read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", "modificationTime", "length")
    )
    return files.withColumn("identity", identity("path")).select(
        "path", "modificationTime", "length", "identity.mouse", "identity.date", "identity.run"
    )


def candidates(files: DataFrame) -> DataFrame:
    """Number of files per session; ambiguous ones are reported, never picked."""
    return files.groupBy("mouse", "date", "run").agg(
        F.count(F.lit(1)).alias("n_files"), F.min("path").alias("first_path")
    ).withColumn("ambiguous", F.col("n_files") > 1)


# Digital channel names after removal of other characters.
CHANNEL_ALIASES = {
    "campulse": "sync", "camera": "sync", "synch": "sync", "sync": "sync",
    "lickevent": "licking", "lick": "licking", "licking": "licking",
    "ensuredelivery": "ensure", "ensure": "ensure", "solenoid": "ensure",
}


def semantic_channel(username: Column | str, dataset: Column | str) -> Column:
    """Canonical channel name; unknown names keep their text or dataset name."""
    u = F.col(username) if isinstance(username, str) else username
    d = F.col(dataset) if isinstance(dataset, str) else dataset
    key = F.regexp_replace(F.lower(u), "[^a-z0-9]+", "")
    table = F.create_map(*[F.lit(v) for kv in CHANNEL_ALIASES.items() for v in kv])
    return F.coalesce(F.try_element_at(table, key), F.nullif(F.trim(u), F.lit("")), d)


def safe_label(text: Column | str) -> Column:
    """File-name safe label."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.regexp_replace(F.trim(t), "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")
