"""Forecast scores as aggregates over predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.core.ranks import distribution

CLIP = 1e-7


def continuous(df: DataFrame, keys: list[str], y: str, prediction: str) -> DataFrame:
    e = F.col(y) - F.col(prediction)
    g = df.groupBy(*keys).agg(
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.var_pop(y).alias("_v"),
        F.count(F.lit(1)).alias("n"),
    )
    return g.select(
        *keys, F.when(F.col("_v") > 0, 1 - F.col("mse") / F.col("_v")).alias("r2"), "mse", "mae", "n"
    )


def binary(df: DataFrame, keys: list[str], y: str, prediction: str) -> DataFrame:
    """Average precision, prevalence, gain, ROC AUC and log loss.

    Ranks come from the distribution of distinct scores, so a single huge group
    is never sorted in one task.
    """
    x = df.withColumn("_p", F.greatest(F.least(F.col(prediction), F.lit(1 - CLIP)), F.lit(CLIP)))
    x = x.withColumn("_y", F.col(y).cast("double"))
    loss = -(F.col("_y") * F.ln("_p") + (1 - F.col("_y")) * F.ln(1 - F.col("_p")))
    base = x.groupBy(*keys).agg(
        F.avg("_y").alias("positive_prevalence"), F.avg(loss).alias("log_loss"),
        F.count(F.lit(1)).alias("n"),
    )
    d = distribution(x, keys, "_p", weights={"pos": F.col("_y")})
    # Counting from the top: rows and positives at or above each score.
    above = F.col("n") - F.col("below")
    tp = F.col("n_pos") - F.col("below_pos")
    rank = F.col("below") + (F.col("cnt") + 1) / 2.0
    g = d.groupBy(*keys).agg(
        F.sum(F.col("pos") * tp / above).alias("_ap"),
        F.sum(F.col("pos") * rank).alias("_ranks"),
        F.max("n_pos").alias("_n1"),
        F.max("n").alias("_n"),
    )
    n1, n0 = F.col("_n1"), F.col("_n") - F.col("_n1")
    both = (n1 > 0) & (n0 > 0)
    g = g.select(
        *keys,
        F.when(both, F.col("_ap") / n1).alias("average_precision"),
        F.when(both, (F.col("_ranks") - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("roc_auc"),
    )
    return base.join(g, keys).withColumn(
        "ap_gain", F.col("average_precision") - F.col("positive_prevalence")
    )


def poisson(df: DataFrame, keys: list[str], y: str, prediction: str) -> DataFrame:
    mu = F.greatest(F.col(prediction), F.lit(CLIP))
    v = F.col(y)
    term = F.when(v > 0, v * F.ln(v / mu)).otherwise(0.0)
    g = df.groupBy(*keys).agg(
        F.avg(2 * (term - v + mu)).alias("poisson_deviance"),
        F.avg(F.abs(v - mu)).alias("mae"),
        F.count(F.lit(1)).alias("n"),
    )
    return g.withColumn("negative_poisson_deviance", -F.col("poisson_deviance"))
