"""Small helpers on frames: inputs with missing or clashing columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.core.lineage import small_batches  # noqa: F401


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns and no others, cast to the given types.

    Extra input columns can't clash with the names that an operator adds.
    """
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in kinds.items()])


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of the id's decimal text; a missing id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8"))


#: Arrow types of result columns by their Spark names.
ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
    "binary": pa.binary(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()),
}

Rows = Iterator[tuple]

#: Rows of a batch that are Python objects at a time.
TAKEN = 256


def map_rows(df: DataFrame, fn: Callable[[Rows], Rows], size: int = 4096, **kinds: str) -> DataFrame:
    """Run ``fn`` over the rows of each partition, as tuples, in Arrow batches.

    ``kinds`` names the result columns and their types.  Results leave in batches
    of at most ``size`` rows, so neither side is held whole.
    """
    schema = pa.schema([(c, ARROW[k]) for c, k in kinds.items()])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = (row for b in batches for at in range(0, b.num_rows, TAKEN)
                 for row in zip(*(c.to_pylist() for c in b.slice(at, TAKEN).columns)))
        held = []
        for row in fn(taken):
            held.append(row)
            if len(held) >= size:
                yield batch(held)
                held = []
        yield batch(held)

    return df.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
