"""Near-duplicate vectors by a pruned flat graph over overlapping cluster shards.

1. Equal vectors of one label become one representative; unusable ones (null, zero,
   with null or non-finite components) link with nothing.
2. A label above ``SHARD`` vectors is split by centroids, drawn per shard from a bounded
   hash-ordered sample, and split again while a part is above it.  A vector goes to every
   part that a vector within the threshold's angle may share with it, so no linked pair
   is parted.  Where that doesn't at least halve the pairs (dense groups, one direction,
   no clusters), the shard stays whole and all its pairs are compared exactly, in tiles of
   two blocks of at most about ``BLOCK`` vectors, in place of steps 3 to 5.
3. Each smaller shard builds neighbour lists with robust pruning: a neighbour is dropped where
   one already kept lies closer to it by the factor ``ALPHA``.
4. The lists of a vector from all its shards are united.
5. Each of these shards searches for every member from the shard's medoid: greedily until the
   beam holds nothing new, then through all vectors above the threshold reached so far.
   Every pair that is reported has its cosine computed in double precision.  A pair
   counts in the first shard that both share, so links are counted once.
6. Components of the links give the classes.

``recall`` measures the links found against brute force on given queries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.core.lineage import cut
from eventide.llm.columns import Rows, map_rows, only
from eventide.llm.components import components

THRESHOLD = 0.93
SHARD, OVERLAP, SPLIT = 1500, 3, 64
#: Parts of a split are this much smaller than a shard on average, so few are split again.
ROOM = 1.8
SAMPLE_PER_CENTROID = 24
#: Vectors of a block, and numbers of one where vectors are long.
BLOCK, BLOCK_NUMBERS = 4096, 1 << 21
DEGREE, CANDIDATES, ALPHA, BEAM, MARGIN = 12, 32, 1.2, 16, 0.05


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (array<double>) and whether the vector can link."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return only(vectors, vec_id="bigint", embedding="array<double>", label="bigint").withColumn("v", v).select(
        "vec_id", "label", "v",
        F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
                   & ~bad & (norm > 0), F.lit(False)).alias("ok"))


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _centroids(sample: list[list[float]], count: int) -> list[float]:
    """``count`` centroids of a sample by few rounds of spherical k-means, flattened."""
    x = unit(np.array(sorted(sample), np.float64))  # whatever order the rows came in
    count = min(count, len(x))
    c = x[np.arange(count) * len(x) // count].copy()
    for _ in range(6):
        near = (x @ c.T).argmax(axis=1)
        for k in range(count):
            own = x[near == k]
            if len(own) and np.linalg.norm(own.sum(axis=0)) > 0:
                c[k] = unit(own.sum(axis=0, keepdims=True))[0]
    return c.ravel().tolist()


def halo(x: np.ndarray, centres: np.ndarray, threshold: float) -> list[np.ndarray]:
    """Cells of every unit vector, so that two vectors of cosine >= threshold share one.

    The middle of such a pair lies in some cell, and each of the two is at most half the
    pair's angle away from it: a vector goes to the cell of its nearest centre and to
    all whose border with that cell lies within half the angle of the threshold.
    """
    near = x @ centres.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    behind = near[np.arange(len(x)), home][:, None] - near
    inside = behind <= math.sqrt(max(0.0, (1 - threshold) / 2)) * apart[home] + 1e-7
    return [np.flatnonzero(row) for row in inside]


def shards(reps: DataFrame, size: int = SHARD, overlap: int = OVERLAP, split: int = SPLIT,
           threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """rep, v, shard and blocks: every pair of ``threshold`` in at least one common shard.

    ``reps`` has rep, label and v.  Each round splits the shards above ``size`` into at
    most ``split`` cells; a round looks at the counts of shards and cells only.  A split
    stands if it makes at most ``overlap`` rows of one and halves the pairs to compare, so
    rounds end.  Other shards (dense groups, one direction, no direction at all) stay
    whole: blocks is how many bounded blocks they are compared in, 0 for shards up to
    ``size``.
    """
    current = reps.select("rep", "v", F.xxhash64("label", F.size("v")).alias("shard"))
    done = None
    step = 0
    while True:
        counts = cut(current.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")))
        large = counts.where(F.col("n") > size)
        small = current.join(counts.where(F.col("n") <= size), "shard").select(
            "rep", "v", "shard", F.lit(0).cast("bigint").alias("blocks"))
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return done
        wanted = large.select(
            "shard", F.least(F.lit(split), F.ceil(F.col("n") * overlap * ROOM / size)).cast("int").alias("k"), "n",
            F.ceil(F.col("n") / F.least(F.lit(block), F.greatest(F.lit(1), F.lit(BLOCK_NUMBERS) / F.col("dim")))).alias("blocks"))
        # A bounded sample of every large shard: the rows with the smallest hashes.
        chance = F.col("k") * SAMPLE_PER_CENTROID * 2 / F.col("n")
        drawn = (current.join(wanted, "shard")
                 .where(F.pmod(F.xxhash64("rep", F.lit(step)), F.lit(1 << 20)) < chance * (1 << 20))
                 .select("shard", "k", "v"))

        def centres(rows: pa.Table) -> pa.Table:
            k = rows.column("k")[0].as_py()
            flat = _centroids(rows.column("v").to_pylist(), k)
            return pa.table({"shard": [rows.column("shard")[0].as_py()], "centres": [flat]},
                            schema=pa.schema([("shard", pa.int64()), ("centres", pa.list_(pa.float64()))]))

        fitted = drawn.groupBy("shard").applyInArrow(centres, "shard bigint, centres array<double>")
        # Vectors meet their shard's centres in bounded groups.
        fitted = fitted.join(wanted, "shard").select(
            "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("group"), "centres")
        met = current.join(wanted, "shard").select(
            "rep", "v", "shard", F.pmod(F.xxhash64("rep", F.lit("group")), F.col("blocks")).alias("group"))

        def assign(rows: pa.Table, fit: pa.Table) -> pa.Table:
            rep, v = _members(rows)
            parts = [[0]] * len(rep)
            if len(rep) and fit.num_rows:
                c = np.array(fit.column("centres")[0].as_py()).reshape(-1, v.shape[1])
                parts = halo(unit(v), c, threshold)
            return pa.table({"rep": rep, "v": rows.column("v"), "shard": rows.column("shard"), "parts": parts},
                            schema=pa.schema([("rep", pa.int64()), ("v", pa.list_(pa.float64())),
                                              ("shard", pa.int64()), ("parts", pa.list_(pa.int32()))]))

        moved = cut(met.groupBy("shard", "group").cogroup(fitted.groupBy("shard", "group")).applyInArrow(
            assign, "rep bigint, v array<double>, shard bigint, parts array<int>"))
        step += 1
        cells = moved.select("shard", F.explode("parts").alias("part")).groupBy("shard", "part").agg(
            F.count(F.lit(1)).cast("double").alias("m"))
        gains = cells.groupBy("shard").agg(F.sum("m").alias("rows"), F.sum(F.col("m") * F.col("m")).alias("pairs"))
        fate = cut(gains.join(wanted, "shard").select("shard", "blocks", (
            (F.col("rows") <= overlap * F.col("n")) & (2 * F.col("pairs") <= F.col("n").cast("double") * F.col("n"))
        ).alias("stands")))
        judged = moved.join(fate, "shard")
        done = done.unionByName(judged.where("not stands").select("rep", "v", "shard", "blocks"))
        current = judged.where("stands").select("rep", "v", "shard", F.explode("parts").alias("part")).select(
            "rep", "v", F.xxhash64("shard", "part", F.lit(step)).alias("shard"))


def pruned(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> np.ndarray:
    """Neighbour lists of unit vectors by robust pruning, -1 where a list is shorter.

    Candidates of a node are its nearest; they are taken nearest first, and each takes
    out those that lie closer to it, by the factor, than to the node.
    """
    n = len(x)
    out = np.full((n, degree), -1, np.int64)
    most = min(candidates, n - 1)
    if most <= 0:
        return out
    for at in range(0, n, 256):
        rows = np.arange(at, min(n, at + 256))
        s = x[rows] @ x.T
        s[np.arange(len(rows)), rows] = -np.inf
        near = np.argpartition(-s, most - 1, axis=1)[:, :most]
        own = np.take_along_axis(s, near, axis=1)
        order = np.argsort(-own, axis=1, kind="stable")
        near, own = np.take_along_axis(near, order, axis=1), np.take_along_axis(own, order, axis=1)
        far = np.sqrt(np.maximum(0, 2 - 2 * own))
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("rad,rbd->rab", x[near], x[near])))
        open_ = np.ones(near.shape, bool)
        filled = np.zeros(len(rows), np.int64)
        for _ in range(degree):
            has = open_.any(axis=1)
            if not has.any():
                break
            pick = open_.argmax(axis=1)
            r = np.flatnonzero(has)
            out[rows[r], filled[r]] = near[r, pick[r]]
            filled[r] += 1
            gone = alpha * between[r, pick[r]] <= far[r]
            gone[np.arange(len(r)), pick[r]] = True
            open_[r] &= ~gone
    return out


def _with_reverse(lists: np.ndarray) -> list[np.ndarray]:
    """Each list with the nodes that list the node."""
    a = np.repeat(np.arange(len(lists)), lists.shape[1])
    b = lists.ravel()
    ok = b >= 0
    a, b = a[ok], b[ok]
    both = np.unique(np.concatenate([np.stack([a, b], 1), np.stack([b, a], 1)]), axis=0)
    edge = np.searchsorted(both[:, 0], np.arange(len(lists) + 1))
    return [both[i:j, 1] for i, j in zip(edge[:-1], edge[1:])]


def search(x: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, threshold: float,
           beam: int = BEAM) -> list[np.ndarray]:
    """Per query node the other nodes found with cosine >= threshold.

    Starts at the medoid.  Each round opens the unopened nodes of the beam; once a node
    above the threshold is known, every such node is opened too, until none is left.
    """
    n = len(x)
    degree = np.array([len(a) for a in lists], np.int64)
    first = np.concatenate([[0], np.cumsum(degree)])
    ends = np.concatenate(lists) if len(lists) and first[-1] else np.empty(0, np.int64)
    medoid = int((x @ x.sum(axis=0)).argmax())
    # Nodes that the medoid doesn't reach (graphs of several parts) are entered through
    # their part's first node.
    part, starts = np.arange(n), np.repeat(np.arange(n), degree)
    while True:
        before = part.copy()
        np.minimum.at(part, starts, before[ends])
        np.minimum.at(part, ends, before[starts])
        if (part == before).all():
            break
    entries = np.unique(np.r_[medoid, part[part == np.arange(n)]])
    k = min(beam, n)
    found = []
    for at in range(0, len(queries), 128):
        q = queries[at:at + 128]
        sims = np.full((len(q), n), -np.inf)  # of nodes seen
        opened = np.zeros((len(q), n), bool)
        sims[:, entries] = x[q] @ x[entries].T
        active = np.arange(len(q))
        while len(active):
            own = sims[active]
            floor = np.partition(own, n - k, axis=1)[:, n - k, None]
            # A margin below the threshold keeps the way to a link open.
            todo = (own > -np.inf) & ~opened[active] & ((own >= floor) | (own >= threshold - MARGIN))
            row, node = np.nonzero(todo)
            active, row = active[np.unique(row)], active[row]
            opened[row, node] = True
            size = degree[node]
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            next_ = ends[np.repeat(first[node], size) + place]
            row = np.repeat(row, size)
            new = np.flatnonzero(sims[row, next_] == -np.inf)
            pair = np.unique(row[new] * n + next_[new])
            row, next_ = pair // n, pair % n
            sims[row, next_] = np.einsum("ij,ij->i", x[q[row]], x[next_])
        hit = sims >= threshold - 1e-9
        hit[np.arange(len(q)), q] = False
        found += [np.flatnonzero(h) for h in hit]
    return found


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def _members(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    flat = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return rows.column("rep").to_numpy(), flat.reshape(rows.num_rows, -1) if rows.num_rows else np.empty((0, 0))


def graph(placed: DataFrame) -> DataFrame:
    """rep and near: neighbour lists, united over the shards of a vector."""

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rep")
        rep, v = _members(rows)
        lists = _with_reverse(pruned(unit(v)))
        return pa.table({"rep": rep, "near": [rep[a].tolist() for a in lists]},
                        schema=pa.schema([("rep", pa.int64()), ("near", pa.list_(pa.int64()))]))

    lists = placed.groupBy("shard").applyInArrow(build, "rep bigint, near array<bigint>")
    return lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def found_links(placed: DataFrame, united: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rep, links (rows linked through other vectors) and least (a smaller connected rep, or itself).

    ``placed`` has homes, all shards of a vector, besides the columns of ``shards``.
    """
    ready = placed.join(united, "rep")

    def look(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rep")
        rep, v = _members(rows)
        shard = rows.column("shard")[0].as_py()
        copies = rows.column("copies").to_numpy()
        homes = [set(h) for h in rows.column("homes").to_pylist()]
        x = unit(v)
        near = []
        for own in rows.column("near").to_pylist():
            at = np.searchsorted(rep, own)
            at = at[at < len(rep)]
            near.append(at[np.isin(rep[at], own)])
        label = np.arange(len(rep))
        links = np.zeros(len(rep), np.int64)
        pairs = []
        for i, hits in enumerate(search(x, near, np.arange(len(rep)), threshold)):
            if len(hits):
                a = np.full(len(hits), i)
                pairs.append(np.stack([np.minimum(a, hits), np.maximum(a, hits)], 1))
        if pairs:
            pairs = np.unique(np.concatenate(pairs), axis=0)
            sure = _cosine(v[pairs[:, 0]], v[pairs[:, 1]]) >= threshold
            first = np.array([min(homes[i] & homes[j]) == shard for i, j in pairs])
            pairs = pairs[sure & first]
            a, b = pairs[:, 0], pairs[:, 1]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            while True:
                before = label.copy()
                np.minimum.at(label, a, before[b])
                np.minimum.at(label, b, before[a])
                if (label == before).all():
                    break
        at = np.flatnonzero(links)
        return pa.table({"rep": rep[at], "links": links[at], "least": rep[label[at]]},
                        schema=pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("least", pa.int64())]))

    return ready.groupBy("shard").applyInArrow(look, "rep bigint, links bigint, least bigint")


def _packed(rows: pa.Table) -> pa.Table:
    """One row of a block; the vectors in single precision where that is exact."""
    rep, v = _members(rows)
    homes = rows.column("homes").combine_chunks()
    single = v.astype(np.float32)
    exact = bool((single == v).all())
    return pa.table({
        "shard": rows.column("shard")[:1], "blocks": rows.column("blocks")[:1], "block": rows.column("block")[:1],
        "dim": [v.shape[1]], "single": [exact], "rep": [rep.tobytes()], "v": [(single if exact else v).tobytes()],
        "copies": [rows.column("copies").to_numpy().tobytes()],
        "homes": [homes.flatten().to_numpy(zero_copy_only=False).tobytes()],
        "sizes": [homes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64).tobytes()]}, schema=_PACKED)


_PACKED = pa.schema([("shard", pa.int64()), ("blocks", pa.int64()), ("block", pa.int64()), ("dim", pa.int64()),
                     ("single", pa.bool_()), ("rep", pa.binary()), ("v", pa.binary()), ("copies", pa.binary()),
                     ("homes", pa.binary()), ("sizes", pa.binary())])


def _lower_homes(shard: int, blocks: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Per block, which of the shards below ``shard`` hold a vector, as 0 and 1."""
    known = np.unique(np.concatenate([h for h, _ in blocks]))
    known = known[known < shard]
    out = []
    for homes, sizes in blocks:
        m = np.zeros((len(sizes), len(known)), np.float32)
        row = np.repeat(np.arange(len(sizes)), sizes)
        m[row[homes < shard], np.searchsorted(known, homes[homes < shard])] = 1
        out.append(m)
    return out


def _joined(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component numbers of the rows and columns of a matrix of links, each node visited once."""
    left, right = np.full(hits.shape[0], -1), np.full(hits.shape[1], -1)
    for seed in np.flatnonzero(hits.any(axis=1)):
        if left[seed] >= 0:
            continue
        rows = np.array([seed])
        while len(rows):
            left[rows] = seed
            cols = np.flatnonzero(hits[rows].any(axis=0) & (right < 0))
            right[cols] = seed
            rows = np.flatnonzero(hits[:, cols].any(axis=1) & (left < 0)) if len(cols) else cols
    return left, right


def tile_links(placed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links as ``found_links`` gives them, of shards that are compared in blocks.

    Two blocks make a tile, a block with itself another; each tile compares all its pairs.
    Blocks travel as one row each, and links are counted in the tile.
    """
    schema = ("shard bigint, blocks bigint, block bigint, dim bigint, single boolean, rep binary, v binary, "
              "copies binary, homes binary, sizes binary")
    packed = placed.withColumn("block", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks"))).groupBy(
        "shard", "block").applyInArrow(_packed, schema)
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    tiles = packed.select("*", other.alias("other")).select(
        "*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def look(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block").to_pylist()
        out = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("least", pa.int64())])
        alone = rows[0]["low"] == rows[0]["high"]
        if len(rows) == 1 and not alone:  # the other block is empty
            return out.empty_table()
        shard = rows[0]["shard"]
        rep = [np.frombuffer(r["rep"], np.int64) for r in rows]
        v = [np.frombuffer(r["v"], np.float32 if r["single"] else np.float64).astype(np.float64).reshape(-1, r["dim"])
             for r in rows]
        copies = [np.frombuffer(r["copies"], np.int64) for r in rows]
        lower = _lower_homes(shard, [(np.frombuffer(r["homes"], np.int64), np.frombuffer(r["sizes"], np.int64))
                                     for r in rows])
        x = [unit(m).astype(np.float32) for m in v]
        b = len(rows) - 1
        hits = np.zeros((len(rep[0]), len(rep[b])), bool)
        near = 2e-7 * (v[0].shape[1] + 8)  # rounding of single precision
        for at in range(0, len(hits), 512):
            sims = x[0][at:at + 512] @ x[b].T
            hit = sims >= threshold + near
            i, j = np.nonzero((sims >= threshold - near) & ~hit)
            for some in range(0, len(i), 1 << 16):
                p, q = i[some:some + (1 << 16)], j[some:some + (1 << 16)]
                hit[p, q] = _cosine(v[0][at + p], v[b][q]) >= threshold
            if lower[0].shape[1]:
                hit &= lower[0][at:at + 512] @ lower[b].T == 0
            hits[at:at + 512] = hit
        if alone:
            np.fill_diagonal(hits, False)
        left, right = _joined(hits)
        ids, parts = [rep[0]], [left]
        links = [np.array([copies[b][h].sum() for h in hits], np.int64)]
        if not alone:
            ids.append(rep[b])
            parts.append(right)
            links.append(np.array([copies[0][h].sum() for h in hits.T], np.int64))
        ids, parts, links = np.concatenate(ids), np.concatenate(parts), np.concatenate(links)
        ids, parts, links = ids[links > 0], parts[links > 0], links[links > 0]
        _, part = np.unique(parts, return_inverse=True)
        smallest = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(smallest, part, ids)
        return pa.table({"rep": ids, "links": links, "least": smallest[part]}, schema=out)

    return tiles.groupBy("shard", "low", "high").applyInArrow(look, "rep bigint, links bigint, least bigint")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, size: int = SHARD,
                    overlap: int = OVERLAP, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``.

    ``vectors`` has vec_id, embedding and label; other columns are ignored.  Vectors
    link when labels are equal and not null and the cosine is at least ``threshold``.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without vec_id, link with nothing and are their own component.  Vectors of different
    lengths don't link.  Rows that repeat a vec_id are reported each.  No rows give none.
    """
    rows = cut(usable(vectors).withColumn("key", F.when(F.col("ok"), F.sha2(F.to_json(F.struct("label", "v")), 256))))
    reps = cut(rows.where("ok").groupBy("key", "label", "v").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    split = cut(shards(reps, size, overlap, threshold=threshold, block=block))
    homes = split.groupBy("rep").agg(F.sort_array(F.collect_set("shard")).alias("homes"))
    placed = cut(split.join(reps.select("rep", "copies"), "rep").join(homes, "rep"))
    searched = placed.where("blocks = 0")
    linked = cut(found_links(searched, cut(graph(searched)), threshold).unionByName(
        tile_links(placed.where("blocks > 0"), threshold)))
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(linked.where("rep <> least").select("rep", "least")).withColumnRenamed("node", "rep")
    classes = cut(reps.select("key", "rep", "copies").join(links, "rep", "left").join(parts, "rep", "left").select(
        "key", F.coalesce("component", "rep").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    out = rows.select("vec_id", "key").join(classes, "key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def recall(vectors: DataFrame, result: DataFrame, threshold: float = THRESHOLD, every: int = 100) -> float:
    """Share of the links of the vectors whose id is divisible by ``every`` that ``result`` counts.

    Brute force: these queries against all rows, in blocks of the queries.
    """
    rows = usable(vectors).where("ok")
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "label", "v").collect()
    true: dict[int, int] = {}
    for at in range(0, len(queries), 1000):
        some = queries[at:at + 1000]

        def count(batch: Rows) -> Rows:
            total = np.zeros(len(some), np.int64)
            ids = np.array([q["vec_id"] for q in some])
            labels = np.array([q["label"] for q in some])
            by_size = {}
            for i, q in enumerate(some):
                by_size.setdefault(len(q["v"]), []).append(i)
            x = {n: (np.array(at), unit(np.array([some[i]["v"] for i in at]))) for n, at in by_size.items()}
            for vec_id, label, v in batch:
                if len(v) in x:
                    at, directions = x[len(v)]
                    cosine = directions @ unit(np.array([v]))[0]
                    total[at] += (cosine >= threshold) & (labels[at] == label) & (ids[at] != vec_id)
            yield from zip(ids.tolist(), total.tolist())

        for r in map_rows(rows.select("vec_id", "label", "v"), count, vec_id="bigint", n="bigint").groupBy(
                "vec_id").agg(F.sum("n").alias("n")).collect():
            true[r["vec_id"]] = r["n"]
    got = {r["vec_id"]: r["n_links"] for r in result.where(F.col("vec_id") % every == 0).collect()}
    total = sum(true.values())
    return sum(min(n, got.get(i, 0)) for i, n in true.items()) / total if total else math.nan
