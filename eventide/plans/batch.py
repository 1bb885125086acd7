"""Batch runs over session lists with a status row per session."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from eventide.core.checks import ContractError
from eventide.core.lineage import cut


def run_batch(
    items: DataFrame,
    process: Callable[[dict], None],
    *,
    done: DataFrame | None = None,
    keys: list[str],
    overwrite: bool = False,
    continue_on_error: bool = False,
) -> DataFrame:
    """Call ``process`` for every row in tasks; status processed/skipped/failed.

    Rows present in ``done`` are skipped unless overwritten.  Without
    ``continue_on_error`` the first failure raises after the run, with its
    session named.
    """
    todo, skipped = items, None
    if done is not None and not overwrite:
        finished = done.select(*keys).distinct()
        todo = items.join(finished, keys, "left_anti")
        skipped = items.join(finished, keys, "left_semi")
    schema = StructType(
        [items.schema[k] for k in keys]
        + [StructField("status", StringType()), StructField("message", StringType())]
    )

    def work(batches):
        for pdf in batches:
            rows = []
            for item in pdf.to_dict("records"):
                try:
                    process(item)
                    rows.append([*[item[k] for k in keys], "processed", None])
                except Exception as error:
                    rows.append([*[item[k] for k in keys], "failed", f"{type(error).__name__}: {error}"])
            yield pd.DataFrame(rows, columns=schema.names)

    # The work has side effects, so its result is stored once.
    out = cut(todo.mapInPandas(work, schema))
    if skipped is not None:
        out = out.unionByName(
            skipped.select(*keys, F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("message"))
        )
    if not continue_on_error:
        bad = out.filter("status = 'failed'").limit(1).collect()
        if bad:
            raise ContractError(f"session failed: {bad[0].asDict()}")
    return out
