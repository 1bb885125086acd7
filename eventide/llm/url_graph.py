"""URL verdicts by rules and, where no rule fits, by trust spread over host links.

Two personalised PageRanks run over the graph of hosts: trust starts at hosts
whose pages rules allow and follows links; distrust starts at hosts whose pages
rules block and follows links backwards, from a bad host to those that link to it.
A host whose distrust exceeds ``ratio`` times its trust is blocked.  DataFrame
functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.core.lineage import cut
from eventide.llm.columns import only

DAMPING = 0.85
STEPS = 24
STEPS_PER_TABLE = 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?i)(?:href|src|action)\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s<>]+)"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none fits.

    ``rules`` is a parameter list; every rule is one branch of an expression.
    """
    longest_first = sorted(rules, key=lambda r: (-len(r.host + r.path), r))
    branches = [
        F.when(((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path)),
               F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in longest_first
    ]
    return F.coalesce(*branches) if branches else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst and w of links between different hosts; the w of a src add up to 1."""
    targets = F.array_distinct(F.transform(
        F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1)),
        lambda h: F.translate(h, UPPER, LOWER)))
    links = (pages.select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
             .where("src <> '' and dst <> '' and src <> dst")
             .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))
    total = links.groupBy("src").agg(F.sum("n").alias("total"))
    return links.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("w"))


def spread(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """host, trust and distrust after ``steps`` steps.

    ``seeds`` has host, trust and distrust.  Both ranks step together: a row of the
    state is (kind, host, score).  State tables are written every few steps, which
    bounds the lineage; a lost executor costs those steps at most.
    """
    backwards = links.groupBy("dst").agg(F.sum("w").alias("total"))
    reverse = links.join(backwards, "dst").select(
        F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"),
        (F.col("w") / F.col("total")).alias("w"))
    edges = cut(links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"),
                             F.col("dst").alias("to"), "w").unionByName(reverse))
    start = cut(seeds.select("host", F.explode(F.create_map(
        F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("kind", "score"))
        .where("score > 0").select("kind", "host", "score"))
    base = start.withColumn("score", F.col("score") * (1 - damping))
    state = base
    if not edges.isEmpty():
        for step in range(1, steps + 1):
            moved = state.join(edges, ["kind", "host"]).select(
                "kind", F.col("to").alias("host"), (F.col("score") * F.col("w") * damping).alias("score"))
            state = base.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score"))
            if step % STEPS_PER_TABLE == 0:
                state = cut(state)
    return state.groupBy("host").agg(*[
        F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k)
        for k in ("trust", "distrust")])


def judge(pages: DataFrame, rules: Sequence[Rule], ratio: float = 1.0, damping: float = DAMPING,
          steps: int = STEPS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every row of ``pages``.

    ``pages`` has page_id, url and html; other columns are ignored.  A url that is
    null or has no ``://`` has an empty host and path, fits no rule and is allowed,
    as is a host that neither trust nor distrust reaches.  Rows that repeat a page_id
    are judged each; no rows give no rows.
    """
    pages = only(pages, page_id="bigint", url="string", html="string").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = pages.withColumn("found", rule_for(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("said"))
    seeds = (ruled.where("host <> ''").groupBy("host").agg(
        F.avg((F.coalesce("said", F.lit("")) == "allow").cast("double")).alias("trust"),
        F.avg((F.coalesce("said", F.lit("")) == "block").cast("double")).alias("distrust")))
    scores = spread(seeds, host_links(pages), damping, steps)
    zero = F.lit(0.0)
    return ruled.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("said", F.when(
            F.round(F.coalesce("distrust", zero), 12) > F.round(F.coalesce("trust", zero) * ratio, 12), "block",
        ).otherwise("allow")).alias("verdict"),
        F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"))
