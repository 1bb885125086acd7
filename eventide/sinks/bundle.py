"""Publication bundles: declared tables with checksums.

Tables are written by Spark as gzip CSV parts; the manifest keeps a row count
and the SHA-256 of every part, computed where the parts lie.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.core.checks import ContractError, duplicates, require_none
from eventide.sinks.tables import blank_missing
from eventide.sources.sessions import safe_relative

VERSION = "1.0"


def checksums(spark: SparkSession, root: str) -> DataFrame:
    """``file, sha256, bytes`` of every data part below a bundle root."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv.gz").load(root)
    )
    prefix = os.path.abspath(root).rstrip("/") + "/"
    name = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{prefix}", "")
    return files.select(
        name.alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")
    )


class Bundle:
    def __init__(self, spark: SparkSession, root: str, *, title: str):
        self.spark, self.root = spark, root
        self.manifest: dict = {"schema_version": VERSION, "title": title, "tables": {}, "figures": {}}

    def add_table(
        self, name: str, df: DataFrame, *, columns: list[str], description: str,
        units: dict[str, str] | None = None, primary_key: tuple[str, ...] = (),
    ) -> None:
        name = safe_relative(name)
        if name in self.manifest["tables"]:
            raise ContractError(f"bundle path already exists: {name}")
        extra = sorted(set(df.columns) - set(columns))
        if extra:
            raise ContractError(f"table contains undeclared columns: {extra}")
        if primary_key:
            require_none(duplicates(df, list(primary_key)), f"primary key of {name} is not unique")
        kept = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
        target = f"{self.root}/{name}"
        (
            blank_missing(kept).write.mode("overwrite").option("header", True)
            .option("compression", "gzip").csv(target)
        )
        self.manifest["tables"][name] = {
            "columns": columns, "units": units or {}, "primary_key": list(primary_key),
            "description": description, "rows": self._rows(target),
        }

    def _rows(self, target: str) -> int:
        return self.spark.read.option("header", True).csv(target).count()

    def add_figure(self, panel: str, *, title: str, sources: list[str], command: str) -> None:
        missing = [s for s in sources if s not in self.manifest["tables"]]
        if missing:
            raise ContractError(f"figure sources are not in the bundle: {missing}")
        self.manifest["figures"][panel] = {"title": title, "sources": sources, "command": command}

    def finalize(self) -> dict:
        """Write the manifest and a checksum table; the table stays distributed."""
        checksums(self.spark, self.root).write.mode("overwrite").parquet(f"{self.root}/_checksums")
        with open(f"{self.root}/manifest.json", "w", encoding="utf-8") as f:
            json.dump(self.manifest, f, indent=2, sort_keys=True)
        return self.manifest


def validate(spark: SparkSession, root: str) -> DataFrame:
    """All problems of a bundle as rows ``problem, item`` (empty when valid)."""
    with open(f"{root}/manifest.json", encoding="utf-8") as f:
        manifest = json.load(f)
    declared = spark.read.parquet(f"{root}/_checksums")
    actual = checksums(spark, root).withColumnsRenamed({"sha256": "_sha", "bytes": "_bytes"})
    both = declared.join(actual, "file", "full_outer")
    problem = (
        F.when(F.col("_sha").isNull(), "missing file")
        .when(F.col("sha256").isNull(), "undeclared file")
        .when(F.col("sha256") != F.col("_sha"), "checksum differs")
        .when(F.col("bytes") != F.col("_bytes"), "size differs")
    )
    out = both.select(problem.alias("problem"), F.col("file").alias("item")).filter("problem IS NOT NULL")
    rows = []
    if manifest.get("schema_version") != VERSION:
        rows.append(("unsupported version", "manifest.json"))
    for name, info in manifest["tables"].items():
        if not out.filter(F.col("item").startswith(f"{name}/")).isEmpty():
            continue
        table = spark.read.option("header", True).csv(f"{root}/{name}")
        if table.columns != info["columns"]:
            rows.append(("header differs", name))
        elif table.count() != info["rows"]:
            rows.append(("row count differs", name))
    for panel, info in manifest["figures"].items():
        rows += [("unknown figure source", f"{panel}: {s}") for s in info["sources"] if s not in manifest["tables"]]
    if rows:
        out = out.unionByName(spark.createDataFrame(rows, "problem string, item string"))
    return out
