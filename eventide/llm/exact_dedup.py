"""Exact duplicates by skew-safe combining.

Three stages, each of which compares whole contents and not digests alone:

1. *locally*: equal texts of one input partition become one row (the map-side
   half of the first aggregation);
2. *salted digest groups*: rows meet on (digest, content, salt), where the salt
   is taken from the input partition, so that a text held by a third of all rows
   reaches every reducer as at most one row per input partition, and several
   reducers share it;
3. *globally*: the winners of the salts meet on (digest, content).

Texts therefore cross the network once per input partition and salt that hold
them, however many copies there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.core.lineage import cut
from eventide.llm.columns import fresh, only

SALTS = 8


def normalised(text: Column) -> Column:
    """White space runs become one space; a missing text counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def sha256_digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def text_classes(docs: DataFrame, salts: int = SALTS, digest=sha256_digest) -> DataFrame:
    """One row per distinct text: digest, body, keep_id and group_size.

    ``digest`` may collide: contents are part of every grouping key.
    """
    rows = docs.select(
        "doc_id", normalised(F.col("text")).alias("body"),
        (F.spark_partition_id() % salts).alias("salt"),
    ).withColumn("digest", digest(F.col("body")))
    salted = rows.groupBy("digest", "body", "salt").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy("digest", "body").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, salts: int = SALTS, digest=sha256_digest) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``.

    ``docs`` has doc_id and text; other columns are ignored, whatever their names.
    A null text equals an empty one.  Of equal texts the smallest doc_id stays
    (a null doc_id never wins over a number); rows that repeat a doc_id are
    reported each, and all of the kept id count as kept.  No rows give no rows.
    """
    docs = only(docs, doc_id="bigint", text="string")
    by_digest = cut(text_classes(docs, salts, digest).groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"), F.first("keep_id").alias("keep_id"),
        F.first("group_size").alias("group_size")))
    ids = docs.withColumn("body", normalised(F.col("text"))).select(
        "doc_id", digest(F.col("body")).alias("digest"),
        sha256_digest(F.col("body")).alias("text_sha256"), "body")
    out = ids.drop("body").join(by_digest.where("texts = 1").drop("texts"), "digest")
    shared = by_digest.where("texts > 1").select("digest")
    if not shared.isEmpty():
        # Different texts of one digest are told apart by their contents.
        body = normalised(F.col("text"))
        unclear = docs.join(shared, digest(body) == shared["digest"], "left_semi")
        more = (ids.join(shared, "digest", "left_semi")
                .join(text_classes(unclear, salts, digest), ["digest", "body"]))
        out = out.unionByName(more.drop("body"))
    return out.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first_of_equal_texts(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for every different text, with all its columns: that of the smallest doc_id.

    A null text equals an empty one.  Rows that repeat doc_id and text become one, a row without
    doc_id stays where no equal text has one; columns may have any names.  No rows give none.
    """
    id_, sha, own = fresh(docs, "id", "sha", "own")
    kept = exact_dedup(docs).where("kept").select(
        F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)).distinct()
    rows = docs.withColumn(own, sha256_digest(normalised(F.col("text").cast("string"))))
    return (rows.join(kept, rows["doc_id"].eqNullSafe(kept[id_]) & (rows[own] == kept[sha]), "left_semi")
            .dropDuplicates(["doc_id", own]).select(docs.columns))
