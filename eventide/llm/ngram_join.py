"""Join of documents whose sets of word n-grams have a high Jaccard similarity.

1. Equal sets become one representative (the smallest doc_id).
2. MinHash keys lead representatives that may be similar into cells: whoever
   shares a key with another is in its cell.  A pair at the threshold shares no key
   with a probability of 6e-9, more similar ones with less.
3. Cells are cut into size bands, bands into blocks of bounded rows and bytes, and
   two blocks that may hold a linked pair meet in a tile: blocks of one band or of
   neighbouring bands, as linked sets differ in size by the threshold at most.
4. In a tile, hashed bitmaps bound every overlap from above by counting bits; what
   the bound leaves is intersected exactly as sorted arrays.  A tile returns one row
   per member: its number of links and the smallest member it is connected to.
   Pairs never leave the tile.
5. Components of those rows are the components of all links.

Every pair of representatives of a cell meets in at most one tile, so link counts
add up.  No limits on group sizes: a large group is more tiles, not a larger one.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.core.lineage import cut
from eventide.llm.columns import Rows, fresh, map_rows, only
from eventide.llm.components import components
from eventide.llm.minhash import Bands
from eventide.llm.words import shingle_set

BANDS, ROWS = 40, 6
#: Rows and set elements of a block; a tile has two blocks.
BLOCK_ROWS, BLOCK_VALUES = 512, 1_000_000
#: Bits of a bitmap: twice the largest set of the tile, within these bounds.
LEAST_BITS, MOST_BITS = 256, 8192


def set_digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, digest of the set and, once per task and set, its keys."""

    def run(texts: Rows) -> Rows:
        family, seen = Bands(bands, rows), set()
        for doc_id, text in texts:
            values = shingle_set(text, words)
            digest = set_digest(values)
            keys = None
            if len(values) and digest not in seen:
                seen.add(digest)
                keys = family.keys(values)
            yield doc_id, len(values), digest, keys

    return map_rows(docs.select("doc_id", "text"), run, doc_id="bigint", n_shingles="bigint",
                    digest="binary", keys="array<bigint>")


def cells(sets: DataFrame) -> DataFrame:
    """rep and cell of representatives that share a key with another."""
    keyed = sets.select("rep", F.explode("keys").alias("key"))
    first = keyed.groupBy("key").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n"))
    met = (keyed.join(cut(first.where("n > 1").select("key", "least")), "key")
           .where("rep <> least").select("least", "rep").distinct())
    return components(met).select(F.col("node").alias("rep"), F.col("component").alias("cell"))


def tiles(members: DataFrame, num: int, den: int) -> DataFrame:
    """Members with the tiles they belong to and whether as first or second block.

    ``members`` has rep, n and cell.  Linked sets of sizes n <= m have
    m <= n * den / num, so their bands are equal or neighbours.
    """
    ratio = math.log(den / num) * (1 + 1e-9)
    whole = members.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("size"))
    banded = members.join(whole, "cell").withColumn(
        "band", F.when((F.col("rows") <= BLOCK_ROWS) & (F.col("size") <= BLOCK_VALUES), 0)
        .otherwise(F.floor(F.log("n") / ratio))).drop("rows", "size")
    blocks = cut(banded.groupBy("cell", "band").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_VALUES)).alias("blocks")))
    near = (blocks.alias("x").join(blocks.alias("y"), "cell", "left")
            .where("abs(x.band - y.band) = 1")
            .groupBy("cell", F.col("x.band").alias("band")).agg(
                F.max(F.when(F.expr("y.band > x.band"), F.col("y.blocks"))).alias("above"),
                F.max(F.when(F.expr("y.band < x.band"), F.col("y.blocks"))).alias("below")))
    sized = blocks.join(near, ["cell", "band"], "left")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))

    def up_to(n):
        return F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(
            F.array().cast("array<bigint>"))

    def tile(low, i, high, j, side):
        return F.struct(low.alias("low"), i.alias("i"), high.alias("high"), j.alias("j"),
                        F.lit(side).alias("side"))

    band = F.col("band")
    return (banded.join(sized, ["cell", "band"]).withColumn("own", own).select(
        "rep", "digest", "copies", "cell", F.explode(F.concat(
            F.transform(up_to(F.col("blocks")), lambda j: F.when(
                j >= F.col("own"), tile(band, F.col("own"), band, j, 0)).otherwise(
                    tile(band, j, band, F.col("own"), 1))),
            F.transform(up_to(F.col("above")), lambda j: tile(band, F.col("own"), band + 1, j, 0)),
            F.transform(up_to(F.col("below")), lambda j: tile(band - 1, j, band, F.col("own"), 1)),
        )).alias("t"))
        .select("rep", "digest", "copies", "t.side",
                F.xxhash64("cell", "t.low", "t.i", "t.high", "t.j").alias("tile")))


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> np.ndarray:
    """Pairs (positions in left, in right) of sets with den * |x & y| >= num * |x | y|.

    Bit counts first: each bit that only x has stands for an element of x outside y,
    so |x & y| is at most |x| less the bits that x has and y has not.
    """
    size = np.array([len(s) for s in sets], np.int64)
    bits = int(min(MOST_BITS, max(LEAST_BITS, 1 << (2 * int(size.max())).bit_length())))
    maps = np.zeros((len(sets), bits), bool)
    for row, s in zip(maps, sets):
        row[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    packed = np.packbits(maps, axis=1).view(np.uint64)
    found = []
    ny = size[right]
    step = max(1, (1 << 21) // max(1, len(right) * packed.shape[1]))
    for at in range(0, len(left), step):
        rows = left[at:at + step]
        x, y = packed[rows][:, None, :], packed[right][None, :, :]
        nx = size[rows][:, None]
        most = np.minimum(nx - np.bitwise_count(x & ~y).sum(axis=2, dtype=np.int64),
                          ny - np.bitwise_count(y & ~x).sum(axis=2, dtype=np.int64))
        i, j = np.nonzero((den + num) * most >= num * (nx + ny))
        found.append(np.stack([i + at, j], 1))
    pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    a, b = left[pairs[:, 0]], right[pairs[:, 1]]
    ok = a != b
    pairs, a, b = pairs[ok], a[ok], b[ok]
    if not len(pairs):
        return pairs
    shared = _intersections(sets, a, b)
    return pairs[(den + num) * shared >= num * (size[a] + size[b])]


def _intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the exact intersections of pairs of sorted arrays."""
    if len(a) <= 8 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    # Many pairs: one sort of all arrays together finds the values that several share;
    # counting common ones is then a product of membership columns.
    used = np.unique(np.concatenate([a, b]))
    values = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    start = np.r_[True, values[1:] != values[:-1]]
    rank = np.cumsum(start) - 1
    often = np.bincount(rank) > 1
    column = np.cumsum(often) - 1
    keep = often[rank]
    rank, owner = column[rank[keep]], owner[keep]
    total = np.zeros((len(used), len(used)), np.float32)
    width = 4096
    edge = np.searchsorted(rank, np.arange(0, (int(rank[-1]) if len(rank) else 0) + width + 1, width))
    for k, (lo, hi) in enumerate(zip(edge[:-1], edge[1:])):
        if hi > lo:
            member = np.zeros((len(used), width), np.float32)
            member[owner[lo:hi], rank[lo:hi] - k * width] = 1
            total += member @ member.T
    at = np.full(len(sets), -1)
    at[used] = np.arange(len(used))
    return total[at[a], at[b]].astype(np.int64)


def _least_connected(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    label = label.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        if (label == before).all():
            return label


def link_tile(group: pa.Table, num: int, den: int) -> pa.Table:
    """One row per linked member of a tile: rep, links (documents) and the least connected rep."""
    group = group.sort_by([("rep", "ascending"), ("values", "ascending")])
    packed = group.column("values").to_pylist()
    rep = group.column("rep").to_numpy()
    new = [i for i in range(len(rep)) if i == 0 or rep[i] != rep[i - 1] or packed[i] != packed[i - 1]]
    rep, side, copies = rep[new], group.column("side").to_numpy()[new], group.column("copies").to_numpy()[new]
    sets = [np.frombuffer(packed[i], np.uint64) for i in new]
    left = np.flatnonzero(side == 0)
    two = (side == 1).any()
    right = np.flatnonzero(side == 1) if two else left
    pairs = overlaps(sets, left, right, num, den) if len(left) and len(right) else np.empty((0, 2), np.int64)
    a, b = left[pairs[:, 0]], right[pairs[:, 1]]
    links = np.zeros(len(rep), np.int64)
    np.add.at(links, a, copies[b])
    if two:
        np.add.at(links, b, copies[a])
    at = np.flatnonzero(links)
    label = _least_connected(len(rep), a, b, np.arange(len(rep)))
    return pa.table({"rep": rep[at], "links": links[at], "least": rep[label[at]]},
                    schema=pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("least", pa.int64())]))


def ngram_join(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row of ``docs``.

    Documents link when den * |x & y| >= num * |x | y| for their sets of distinct
    ``words``-word shingles; fewer words are one shingle, and a text that is null or
    has no words has an empty set that links with nothing.  ``docs`` has doc_id and
    text; other columns are ignored.  n_links counts linked rows, equal sets included.
    Rows that repeat a doc_id are reported each, and are one node of the components;
    rows without doc_id have the component of their set, or none.  No rows give none.
    """
    docs = only(docs, doc_id="bigint", text="string")
    signed = cut(signatures(docs, words))
    sets = cut(signed.where("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"),
        F.first("n_shingles").alias("n"), F.first("keys", ignorenulls=True).alias("keys")))
    known = sets.where("rep is not null")
    members = known.select("rep", "digest", "n", "copies").join(cells(known), "rep")
    placed = cut(tiles(members, num, den))
    wanted = placed.groupBy("rep", "digest").agg(
        F.first("copies").alias("copies"), F.collect_list(F.struct("tile", "side")).alias("tiles"))
    # A shuffle join at every size: the number of representatives grows with the input.
    texts = docs.join(wanted.hint("merge"), docs["doc_id"] == wanted["rep"]).select("rep", "digest", "copies", "tiles", "text")

    def arrays(rows: Rows) -> Rows:
        for rep, digest, copies, where, text in rows:
            values = shingle_set(text, words)
            if set_digest(values) == digest:
                packed = values.tobytes()
                for t in where:
                    yield t["tile"], t["side"], rep, copies, packed

    valued = map_rows(texts, arrays, 64, tile="bigint", side="int", rep="bigint", copies="bigint", values="binary")
    linked = cut(valued.groupBy("tile").applyInArrow(
        lambda t: link_tile(t, num, den), "rep bigint, links bigint, least bigint"))
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(linked.select("rep", "least").where("rep <> least"))
    classes = cut(sets.select("digest", "rep", "copies").join(links, "rep", "left")
                  .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
                  .select("digest", F.coalesce("component", "rep").alias("component"),
                          (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    return signed.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"))


def one_of_each_class(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Rows of ``docs`` whose doc_id is the smallest of its component, with all their columns.

    Null and empty texts link with nothing and stay, as do rows without doc_id; rows that repeat
    a doc_id stay or go together.  No rows give none.
    """
    (id_,) = fresh(docs, "id")
    gone = ngram_join(docs, words, num, den).where("component_id <> doc_id").select(
        F.col("doc_id").alias(id_)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[id_], "left_anti")
