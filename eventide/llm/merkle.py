"""Merkle manifest of a table: a root, and for every row a proof that it is part of it.

The rows of a source, by id, are the leaves of the source's tree; the roots of the sources,
by name, are the leaves of the tree above.  Every run of ``FANOUT`` nodes has a parent.

1. Leaves are hashed once; only digests travel from there on.  A range partitioning by source
   and id and the counts of its partitions give every leaf its place in its tree.
2. Aligned partitions of ``FANOUT ** LEVELS`` leaves hash their own subtree.
3. Butterfly exchange: in round r the partitions whose numbers agree but for digit r (base
   ``FANOUT``) swap the roots of what they have hashed so far, at most ``FANOUT`` rows to a
   group, and each of them hashes the parent.  After the last round every partition knows the
   root and all siblings on its way there, so nothing has to be sent down again.  Where the
   last partitions of a tree don't fill a subtree, they serve the numbers that don't exist.
4. Roots of the sources run through the same exchange, one partition each.
5. Every partition rebuilds its subtree, joins the siblings above it, and proves its leaves.

No step holds more than a partition, a group of ``FANOUT`` rows, or one text.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.core.lineage import cut
from eventide.llm.columns import crc32_of_id, only

FANOUT, LEVELS = 16, 3
#: Columns of a leaf, in the order in which they are hashed.
FIELDS = {"doc_id": "bigint", "source": "string", "lang": "string", "n_chars": "bigint", "text": "string"}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    parts = [field(changed.get(name, F.col(name))) for name in FIELDS]
    return F.unhex(F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256))


def leaves(documents: DataFrame) -> DataFrame:
    """doc_id, source, leaf and seen: the digest of the row and that of the row as it is found later.

    Rows whose id's crc32 is divisible by five are found with A-Z of the text lower-cased; a
    missing id counts as the empty text there.
    """
    lowered = F.translate("text", _UPPER, _UPPER.lower())
    tampered = crc32_of_id(F.col("doc_id")) % 5 == 0
    return only(documents, **FIELDS).select(
        "doc_id", "source", leaf_digest().alias("leaf"),
        F.when(tampered & (lowered != F.col("text")), leaf_digest(text=lowered)).alias("changed"),
    ).select("doc_id", "source", "leaf", F.coalesce("changed", "leaf").alias("seen"))


def placed(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with place (from 0, by ``order``, nulls first) and size of the tree.

    Rows are partitioned by range of tree, order and a draw, so equal rows of any number are
    spread; a window sees the rows of one tree in one partition only.
    """
    by = [F.col(c).asc_nulls_first() for c in (tree, *order, "_draw")]
    parted = cut(rows.withColumn("_draw", F.rand(11)).repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    counts = parted.groupBy(tree, "_part").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(tree)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(tree).alias("_tree"), F.col("_part").alias("_at"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias("size"))
    inside = Window.partitionBy(tree, "_part").orderBy(*by[1:])
    numbered = parted.withColumn("_i", F.row_number().over(inside))
    return numbered.join(starts, numbered[tree].eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_at"))).select(
        *rows.columns, (F.col("_i") - 1 + F.col("_start")).alias("place"), "size")


def parent(nodes: list[bytes]) -> bytes:
    return sha256("".join([n.hex() for n in nodes]).encode()).digest()


def levels(nodes: list[bytes], most: int, single: bool) -> list[list[bytes]]:
    """The nodes, their parents, and so on for ``most`` levels, or to one node if ``single``."""
    out = [nodes]
    while len(out) <= most and not (single and len(out[-1]) == 1):
        last = out[-1]
        out.append([parent(last[i:i + FANOUT]) for i in range(0, len(last), FANOUT)])
    return out


_PATH = "array<struct<at: int, run: array<binary>>>"


def exchange(parts: DataFrame, most: int) -> DataFrame:
    """tree, part, root and path of every partition, by rounds of swaps between ``FANOUT`` of them.

    ``parts`` has tree, part (numbers from 0), parts (how many the tree has) and node; ``most``
    is the largest of these counts.  path lists per round the run of nodes that hash to the
    next ancestor and the place of the own one.
    """
    state = parts.select("tree", "part", "parts", "node", F.lit(None).cast(_PATH).alias("path"))
    state = state.withColumn("path", F.coalesce("path", F.array().cast(_PATH)))
    step = 1
    while step < most:
        open_ = F.col("parts") > step
        digit = F.floor(F.col("part") / step) % FANOUT
        own = state.where(open_).select(
            "tree", (F.col("part") - digit * step).alias("meets"), digit.cast("int").alias("at"), "node", F.lit(True).alias("own"),
            "part", "parts", "path")
        # The last subtree may lack members; those that it has send in their place.
        head = F.col("parts") - 1 - (F.col("parts") - 1) % step
        filled = F.col("parts") - head
        absent = F.expr(f"explode(filter(sequence(part - head, {step - 1}L, filled), x -> x >= filled))") if step > 1 else None
        sent = own
        if absent is not None:
            stand_in = (state.where(open_ & (F.col("part") >= head)).withColumns({"head": head, "filled": filled, "d": digit})
                        .select("tree", "d", "node", "head", "parts", absent.alias("low"))
                        .select("tree", (F.col("head") + F.col("low") - F.col("d") * step).alias("meets"),
                                F.col("d").cast("int").alias("at"), "node", F.lit(False).alias("own"),
                                F.lit(None).cast("bigint").alias("part"), "parts", F.lit(None).cast(_PATH).alias("path")))
            sent = own.unionByName(stand_in)
        met = sent.groupBy("tree", "meets").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("at", "node"))), lambda x: x["node"]).alias("run"),
            F.collect_list(F.when(F.col("own"), F.struct("part", "parts", "at", "path"))).alias("members"))
        hashed = F.unhex(F.sha2(F.encode(F.concat_ws("", F.transform("run", lambda x: F.lower(F.hex(x)))), "UTF-8"), 256))
        moved = met.select("tree", hashed.alias("node"), "run", F.explode("members").alias("m")).select(
            "tree", "m.part", "m.parts", "node",
            F.concat("m.path", F.array(F.struct(F.col("m.at").alias("at"), "run"))).alias("path"))
        state = cut(moved.unionByName(state.where(~open_)))
        step *= FANOUT
    return state.select("tree", "part", F.col("node").alias("root"), "path")


def _prove(rows: pa.Table, paths: pa.Table, deep: int) -> pa.Table:
    rows = rows.sort_by("place")
    leaf, seen = rows.column("leaf").to_pylist(), rows.column("seen").to_pylist()
    above = paths.to_pylist()[0]
    tree = levels(leaf, deep, single=rows.column("size")[0].as_py() <= FANOUT ** deep)
    text = [[n.hex() for n in level] for level in tree[:-1]]
    # Above the partition every leaf has the same siblings: one text, and what stands left and right.
    upper = []
    for step in above["path"]:
        run = [n.hex() for n in step["run"]]
        upper.append(("".join(run[:step["at"]]), "".join(run[step["at"] + 1:])))
    upper_siblings = "".join(a + b for a, b in upper)
    root = above["root"]
    proofs, folded = [], []
    for i, found in enumerate(seen):
        siblings, node, at = [], found, i
        for level in text:
            first = at - at % FANOUT
            left, right = "".join(level[first:at]), "".join(level[at + 1:first + FANOUT])
            siblings += (left, right)
            node = sha256(f"{left}{node.hex()}{right}".encode()).digest()
            at //= FANOUT
        for left, right in upper:
            node = sha256(f"{left}{node.hex()}{right}".encode()).digest()
        proofs.append(sha256(("".join(siblings) + upper_siblings).encode()).hexdigest())
        folded.append(node)
    n = rows.num_rows
    return pa.table({
        "doc_id": rows.column("doc_id"), "leaf": [x.hex() for x in leaf], "subroot": [above["subroot"].hex()] * n,
        "root": [root.hex()] * n, "proof_sha256": proofs, "folded_root": [x.hex() for x in folded],
        "verified": [x == root for x in folded]}, schema=_PROVED)


_PROVED = pa.schema([("doc_id", pa.int64())] + [(c, pa.string()) for c in (
    "leaf", "subroot", "root", "proof_sha256", "folded_root")] + [("verified", pa.bool_())])


def _subtree(rows: pa.Table, deep: int) -> pa.Table:
    rows = rows.sort_by("place")
    size = rows.column("size")[0].as_py()
    node = levels(rows.column("leaf").to_pylist(), deep, single=size <= FANOUT ** deep)[-1][0]
    return pa.table(
        {"tree": rows.column("tree")[:1], "part": rows.column("part")[:1], "parts": [-(-size // FANOUT ** deep)], "node": [node]},
        schema=pa.schema([("tree", pa.int64()), ("part", pa.int64()), ("parts", pa.int64()), ("node", pa.binary())]))


def manifest(documents: DataFrame, deep: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    ``documents`` has doc_id, source, lang, n_chars and text, any of them null; other columns
    are ignored.  A missing id comes first; rows of one source and id are ordered by their
    digests, equal rows are leaves of their own.  A missing source is a source.  Without
    siblings (one row in one source) the proof is the digest of the empty text and the leaf is
    the root.  No rows give none.  ``deep`` is the height of a partition's subtree; it changes
    the work, never the result.
    """
    hashed = cut(leaves(documents))
    ranked = placed(hashed, "source", "doc_id", "leaf", "seen")
    sources = placed(hashed.groupBy("source").agg(F.lit(0).cast("bigint").alias("one")), "one", "source").select(
        F.col("source").alias("_source"), F.col("place").alias("tree"), F.col("size").alias("trees"))
    sources = cut(sources)
    at = cut(ranked.join(sources.select("_source", "tree"), F.col("source").eqNullSafe(F.col("_source"))).select(
        "tree", F.floor(F.col("place") / FANOUT ** deep).alias("part"), "place", "size", "doc_id", "leaf", "seen"))
    nodes = cut(at.select("tree", "part", "place", "size", "leaf").groupBy("tree", "part").applyInArrow(
        lambda rows: _subtree(rows, deep), "tree bigint, part bigint, parts bigint, node binary"))
    most = nodes.agg(F.max("parts")).first()[0] or 0
    inner = exchange(nodes, most)
    tops = inner.where("part = 0").join(sources.select("tree", "trees"), "tree").select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("part"), F.col("trees").alias("parts"), F.col("root").alias("node"))
    trees = sources.agg(F.max("trees")).first()[0] or 0
    outer = exchange(tops, trees).select(F.col("part").alias("tree"), F.col("root").alias("top"), F.col("path").alias("rest"))
    paths = inner.join(outer, "tree").select(
        "tree", "part", F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("path", "rest").alias("path"))
    return at.groupBy("tree", "part").cogroup(paths.groupBy("tree", "part")).applyInArrow(
        lambda rows, above: _prove(rows, above, deep),
        "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
