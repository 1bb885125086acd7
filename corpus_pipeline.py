"""A training corpus from raw documents: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir).  All but the last return rows with the columns
of ``docs``; the last returns the pieces of the packed windows.

All stages take rows with nulls in any column, empty and very long texts, repeated rows, no
rows at all and further columns of any name, which they keep.  What becomes of such rows stands
at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from eventide.core.lineage import cut, small_batches
from eventide.llm import exact_dedup, ngram_join, packing, substring_dedup, toxicity
from eventide.llm.columns import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, doesn't reject.

    A null or empty text is scored as a text without words; without labels nothing is toxic.
    Repeated rows are judged each; a row without language by the threshold of unknown ones.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text: the smallest doc_id.

    Null and empty texts are equal and one of them stays; rows that repeat doc_id and text become
    one.  A row without doc_id stays only where no equal text has one.
    """
    return exact_dedup.keep_first_of_equal_texts(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similar sets of five-word shingles link: the smallest doc_id.

    Texts without words link with nothing and stay, rows without doc_id too.
    """
    return ngram_join.one_of_each_class(docs, words=5, num=80, den=100)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has.

    Rows without doc_id or text stay as they are; rows of which nothing is left go.
    """
    return substring_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of at most 2048 tokens; a null or empty text is its end mark alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("packing", pack),
]

#: The classifier and the tokenizer can't be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with small_batches(spark):
            docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
