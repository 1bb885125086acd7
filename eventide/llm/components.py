"""Connected components of an edge table, by alternating star operations.

Large stars join every larger neighbour of a node to the smallest neighbour; small
stars join the smaller ones.  After few rounds (logarithmic in the longest path)
every node is joined to the smallest node of its component.  A round is two
aggregations with map-side combining and two joins on a node, which adaptive
execution splits where a node has very many edges; no component is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.core.lineage import cut


def _large_stars(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written, so that the join below has a shuffle of its own, whose hot node can be split.
    least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
    return (both.where("b > a").join(least, "a")
            .select(F.col("m").alias("a"), "b").where("a <> b").distinct())


def _small_stars(edges: DataFrame) -> DataFrame:
    """``edges`` have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b")
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of all nodes that have an edge.

    ``edges`` has two columns of one orderable type.  Rows with a null, loops and
    repeated edges are allowed and change nothing.
    """
    a, b = edges.columns
    state = cut(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
                .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(state)
    while before[0]:
        state = cut(_small_stars(_large_stars(state)))
        after = mark(state)
        if after == before:
            break
        before = after
    nodes = state.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.unionByName(state.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
