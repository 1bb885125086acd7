"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

1. Equal vectors become one node, which keeps the few smallest ids that an answer can need.
2. Nodes are dealt by hash to shards of at most about ``NUMBERS`` numbers.  A shard inserts its
   nodes in batches that grow with the graph: a greedy search from the medoid proposes
   neighbours, relaxed pruning keeps one only where no kept neighbour lies closer to it by the
   factor ``ALPHA``, and every edge is offered to its end in return.  A second pass does the
   same over the whole graph.  Nodes that the medoid can't reach get an edge from the nearest
   that it can.
3. Queries come in bounded blocks; every block meets every shard of its dimension.  A beam
   search runs in single precision, what the beam holds is measured in double precision on the
   original vectors.
4. The best of all shards are merged.

``recall`` compares with brute force.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.core.lineage import cut
from eventide.llm.columns import Rows, map_rows

K, EVERY = 5, 50
#: Numbers (vectors times dimensions) of a shard and of a block of queries.
NUMBERS = 1 << 19
DEGREE, BEAM, BUILD_BEAM, ALPHA, WIDE = 32, 128, 64, 1.2, 4


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, summed from the first component on.

    Rows are scaled by powers of two first, which changes no digit.
    """
    a, b = (np.ldexp(m.astype(np.float64), -np.frexp(np.abs(m).max(axis=1, keepdims=True).astype(np.float64))[1]) for m in (a, b))
    dot, na, nb = np.zeros((3, len(a)))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        dot += x * y
        na += x * x
        nb += y * y
    return np.clip(dot / np.sqrt(na * nb), -1, 1)


def beam_search(x: np.ndarray, near: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of the beam of every query, best first; -1 where it isn't full.

    Each step opens the best ``WIDE`` nodes of a beam that are still closed, until none is.
    """
    n, m = len(x), len(q)
    seen = np.full((m, n), -1, np.int32)  # the offer that showed the node first
    nodes, sims = np.full((m, beam), -1), np.full((m, beam), -np.inf, np.float32)
    closed = np.full((m, beam), -np.inf, np.float32)  # similarities of nodes to be opened
    seen[:, entry] = 0
    nodes[:, 0], sims[:, 0] = entry, q @ x[entry]
    closed[:, 0] = sims[:, 0]
    live = np.arange(m)
    wide, offers = min(WIDE, beam), 1
    while len(live):
        part = closed[live]
        col = np.argpartition(-part, wide - 1, axis=1)[:, :wide] if wide < beam else np.tile(np.arange(beam), (len(live), 1))
        r, c = np.nonzero(np.take_along_axis(part, col, 1) > -np.inf)
        row, col = live[r], col[r, c]
        closed[row, col] = -np.inf
        to = near[nodes[row, col]]
        row, to = np.repeat(row, to.shape[1]), to.ravel()
        new = np.flatnonzero(to >= 0)
        row, to = row[new], to[new]
        new = np.flatnonzero(seen[row, to] < 0)
        row, to = row[new], to[new]
        tag = np.arange(offers, offers + len(row), dtype=np.int32)
        seen[row, to] = tag
        new = np.flatnonzero(seen[row, to] == tag)  # of equal offers one
        offers += len(row)
        row, to = row[new], to[new]
        if len(row):
            s = np.einsum("ij,ij->i", q[row], x[to])
            count = np.bincount(row, minlength=m)
            rows = np.flatnonzero(count)
            count = count[rows]
            most = int(count.max())
            slot = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + beam
            at = np.repeat(np.arange(len(rows)), count)
            all_, all_s = np.full((len(rows), beam + most), -1), np.full((len(rows), beam + most), -np.inf, np.float32)
            all_c = all_s.copy()
            all_[:, :beam], all_s[:, :beam], all_c[:, :beam] = nodes[rows], sims[rows], closed[rows]
            all_[at, slot], all_s[at, slot], all_c[at, slot] = to, s, s
            best = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            nodes[rows], sims[rows], closed[rows] = (np.take_along_axis(a, best, 1) for a in (all_, all_s, all_c))
        live = live[closed[live].max(axis=1) > -np.inf]
    best = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(nodes, best, 1), np.take_along_axis(sims, best, 1)


def pruned(x: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of the nodes ``own`` out of rows of candidates (-1: none), nearest first."""
    out = np.full((len(own), degree), -1)
    for at in range(0, len(own), 512):
        p, c = own[at:at + 512], candidates[at:at + 512]
        c = np.sort(c, axis=1)
        bad = (c < 0) | (c == p[:, None])
        bad[:, 1:] |= c[:, 1:] == c[:, :-1]
        sims = np.where(bad, -np.inf, np.einsum("id,ijd->ij", x[p], x[c]))
        order = np.argsort(-sims, axis=1, kind="stable")
        c, sims = np.take_along_axis(c, order, 1), np.take_along_axis(sims, order, 1)
        v = x[c]
        far = 2 - 2 * sims
        between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
        open_ = sims > -np.inf
        for k in range(degree):
            r = np.flatnonzero(open_.any(axis=1))
            if not len(r):
                break
            pick = open_[r].argmax(axis=1)
            out[at + r, k] = c[r, pick]
            open_[r, pick] = False
            open_[r] &= alpha * alpha * between[r, pick] > far[r]
    return out


class Graph:
    """The pruned graph of unit vectors, built in the order of ``order``."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM):
        self.x, n = x, len(x)
        self.near = np.full((n, degree), -1)
        self.entry = int((x @ x.sum(axis=0)).argmax())
        self.beam = beam
        order = np.random.default_rng(7).permutation(n)
        order = np.concatenate([[self.entry], order[order != self.entry]])
        done = min(n, beam)
        first = order[:done]
        self._link(first, np.tile(first, (done, 1)))
        while done < n:
            some = order[done:done + max(beam, done // 3)]
            self._insert(some)
            done += len(some)
        if n > beam:
            for at in range(0, n, max(beam, n // 4)):
                self._insert(order[at:at + max(beam, n // 4)])
        self._reach()

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        step = max(1, (1 << 22) // max(1, len(self.x)))
        parts = [beam_search(self.x, self.near, self.entry, q[at:at + step], beam) for at in range(0, len(q), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _insert(self, some: np.ndarray) -> None:
        found, _ = self.search(self.x[some], self.beam)
        self._link(some, np.concatenate([found, self.near[some]], 1))

    def _link(self, some: np.ndarray, candidates: np.ndarray) -> None:
        degree = self.near.shape[1]
        self.near[some] = pruned(self.x, some, candidates, degree)
        # Edges in return; a full list is pruned with the nearest of what is offered.
        a, b = np.repeat(some, degree), self.near[some].ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.lexsort((-np.einsum("ij,ij->i", self.x[a], self.x[b]), b))
        a, b = a[order], b[order]
        ends, first, count = np.unique(b, return_index=True, return_counts=True)
        slot = np.arange(len(b)) - np.repeat(first, count)
        fits = slot < 2 * degree
        offered = np.full((len(ends), 2 * degree), -1)
        offered[np.repeat(np.arange(len(ends)), count)[fits], slot[fits]] = a[fits]
        self.near[ends] = pruned(self.x, ends, np.concatenate([self.near[ends], offered], 1), degree)

    def _reach(self) -> None:
        n = len(self.x)
        reached, edge = np.zeros(n, bool), np.array([self.entry])
        while True:
            while len(edge):
                reached[edge] = True
                edge = np.unique(self.near[edge])
                edge = edge[(edge >= 0) & ~reached[np.maximum(edge, 0)]]
            lost = np.flatnonzero(~reached)
            if not len(lost):
                return
            found, _ = self.search(self.x[lost], self.beam)
            _, one = np.unique(found[:, 0], return_index=True)  # one a node and round
            free = np.full((n, 1), -1)
            free[found[one, 0], 0] = lost[one]
            self.near = np.concatenate([self.near, free], 1)
            edge = lost[one]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v and dim of the vectors that take part: not null, not zero, all components finite."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & good).withColumn("dim", F.size("v"))


def _matrix(rows: pa.Table) -> np.ndarray:
    flat = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows.num_rows, -1)


_GRAPH = "dim int, shard bigint, doubles boolean, v binary, near binary, entry int, ids array<array<bigint>>"
_GRAPH_ARROW = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("doubles", pa.bool_()), ("v", pa.binary()),
                          ("near", pa.binary()), ("entry", pa.int32()), ("ids", pa.list_(pa.list_(pa.int64())))])


def _built(rows: pa.Table) -> pa.Table:
    # In one order whatever order the rows came in: a task that runs again builds the same graph.
    rows = rows.take(pa.array(np.argsort([i[0] for i in rows.column("ids").to_pylist()], kind="stable")))
    v = _matrix(rows)
    g = Graph(unit(v).astype(np.float32))
    return pa.table({"dim": rows.column("dim")[:1], "shard": rows.column("shard")[:1], "doubles": [v.dtype == np.float64],
                     "v": [v.tobytes()], "near": [g.near.astype(np.int32).tobytes()], "entry": [g.entry],
                     "ids": [rows.column("ids").to_pylist()]}, schema=_GRAPH_ARROW)


def graphs(nodes: DataFrame, numbers: int = NUMBERS) -> DataFrame:
    """One row a shard: its vectors, its graph and the ids of every node."""
    dims = cut(nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) * F.first("dim") / numbers).alias("shards")))
    dealt = nodes.join(dims, "dim").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")))
    return cut(dealt.select("dim", "shard", "v", "ids").groupBy("dim", "shard").applyInArrow(_built, _GRAPH))


_FOUND = pa.schema([("query_id", pa.int64()), ("mark", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _asked(built: pa.Table, queries: pa.Table, k: int, beam: int) -> pa.Table:
    if not built.num_rows or not queries.num_rows:
        return _FOUND.empty_table()
    g = built.slice(0, 1).to_pylist()[0]
    v = np.frombuffer(g["v"], np.float64 if g["doubles"] else np.float32).reshape(-1, g["dim"])
    x = unit(v).astype(np.float32)
    near = np.frombuffer(g["near"], np.int32).reshape(len(v), -1)
    q = _matrix(queries)
    own, mark = queries.column("query_id").to_pylist(), queries.column("mark").to_pylist()
    step = max(1, (1 << 22) // len(v))
    out = []
    for at in range(0, len(q), step):
        some = q[at:at + step]
        nodes, _ = beam_search(x, near, g["entry"], unit(some).astype(np.float32), max(beam, 2 * k))
        row, col = np.nonzero(nodes >= 0)
        score = cosines(some[row], v[nodes[row, col]])
        sure = np.full(nodes.shape, -np.inf)
        sure[row, col] = score
        for i, best in enumerate(np.argsort(-sure, axis=1, kind="stable")):
            hits = []
            for b in best:
                s = sure[i, b]
                if s == -np.inf or (len(hits) >= k and s < hits[k - 1][0]):
                    break
                hits += [(s, c) for c in g["ids"][nodes[i, b]] if c != own[at + i]]
                hits.sort(key=lambda h: (-h[0], h[1]))
            out += [(own[at + i], mark[at + i], c, float(s)) for s, c in hits[:k]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * 4, _FOUND)], schema=_FOUND)


def nearest(vectors: DataFrame, every: int = EVERY, k: int = K, beam: int = BEAM, numbers: int = NUMBERS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` nearest of every query.

    ``vectors`` has vec_id and embedding; other columns are ignored.  Queries are the rows whose
    vec_id is divisible by ``every``, candidates all rows but those with the query's vec_id;
    fewer than ``k`` candidates are all returned.  Null, empty, zero and non-finite vectors and
    rows without vec_id take no part.  Vectors of different dimension aren't compared.  Of
    equal scores the smaller vec_id comes first.  Rows that repeat id and vector count once.  A
    vec_id with several vectors asks and answers with each of them.  No rows give none.
    """
    rows = cut(usable(vectors))
    # Ranks up to a small number are cut off before the shuffle, so a vector of very many rows is none of one task.
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.select("v", "dim", "vec_id", F.dense_rank().over(order).alias("r")).where(F.col("r") <= k + 1).distinct()
    nodes = cut(few.groupBy("v", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    built = graphs(nodes, numbers)
    queries = cut(rows.where(F.col("vec_id") % every == 0).select(
        F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("mark"), "v", "dim").distinct())
    blocks = queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) * F.first("dim") / numbers).alias("blocks"))
    per_dim = cut(blocks.join(built.groupBy("dim").agg(F.count(F.lit(1)).alias("shards")), "dim"))
    asks = queries.join(per_dim, "dim").select(
        "dim", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).alias("shard"),
        F.pmod(F.xxhash64("query_id"), F.col("blocks")).alias("block"), "query_id", "mark", "v")
    answers = built.join(per_dim, "dim").select(
        "dim", "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"),
        "doubles", "v", "near", "entry", "ids")
    key = ("dim", "shard", "block")
    found = answers.groupBy(*key).cogroup(asks.groupBy(*key)).applyInArrow(
        lambda a, b: _asked(a, b, k, beam), "query_id bigint, mark bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(vectors: DataFrame, result: DataFrame, every: int = EVERY, k: int = K) -> float:
    """Share of the true neighbours (ties at the last place count) of all queries that ``result`` has.

    Brute force: the queries, in blocks, against all rows.
    """
    rows = usable(vectors)
    asked = rows.where(F.col("vec_id") % every == 0).collect()
    got: dict[int, list[float]] = {}
    for r in result.collect():
        got.setdefault(r["query_id"], []).append(r["score"])
    hit = total = 0
    for at in range(0, len(asked), 1000):
        some = asked[at:at + 1000]

        def best(batch: Rows) -> Rows:
            top = [[] for _ in some]
            x = [unit(np.array([s["v"]]))[0] for s in some]
            held: dict[int, list[tuple]] = {}

            def take(dim: int) -> None:
                ids, m = np.array([h[0] for h in held[dim]]), unit(np.array([h[1] for h in held[dim]]))
                for i, s in enumerate(some):
                    if len(x[i]) == dim:
                        c = np.where(ids == s["vec_id"], -np.inf, m @ x[i])
                        top[i] = sorted(top[i] + sorted(c[c > -np.inf].tolist())[-k:])[-k:]
                held[dim] = []

            for vec_id, v, dim in batch:
                held.setdefault(dim, []).append((vec_id, v))
                if len(held[dim]) >= 4096:
                    take(dim)
            for dim in [d for d in held if held[d]]:
                take(dim)
            yield from ((s["vec_id"], t) for s, t in zip(some, top))

        tops: dict[int, list[float]] = {}
        for r in map_rows(rows, best, vec_id="bigint", t="array<double>").collect():
            tops[r["vec_id"]] = sorted(tops.get(r["vec_id"], []) + list(r["t"]))[-k:]
        for i, t in tops.items():
            total += len(t)
            hit += sum(s >= t[0] - 1e-9 for s in got.get(i, [])) if t else 0
    return hit / total if total else float("nan")
