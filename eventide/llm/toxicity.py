"""Toxicity of texts by a convolutional classifier trained here.

A word is the mean of the embeddings of its hash and of the hashes of its first
bytes, so inflected forms share what they begin with.  Filters of widths one, two
and three run over the words; the largest response of each filter anywhere in the
text feeds a logistic output.

All labelled rows are learnt from.  They are dealt to units of bounded size; in an epoch
every unit trains, in numpy and in one task, from the same network, and the changes of
all units are averaged, those of a bucket over the units that moved it.  Changes are
added as whole numbers, so neither the order of tasks nor their number tells in the
result.  A fifth of the labelled rows, which training doesn't see, calibrates the scores
and sets one threshold per language; both are distributed sums.

Scores depend on the text alone.  The language only chooses the threshold of the
``toxic`` decision.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.core.lineage import cut, small_batches
from eventide.core.ranks import distribution
from eventide.llm.columns import Rows, crc32_of_id, map_rows, only
from eventide.llm.words import utf8

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 16, 12, (1, 2, 3)
PREFIXES = (4, 6)
#: Labelled rows of a unit on average; it ends at twice as many, or at so many words.
UNIT, UNIT_WORDS = 2048, 2_000_000
#: Buckets of a block of sums, and parts in which tasks' sums are added first.
BLOCK, PARTS = 4096, 16
#: Whole numbers a change of one stands for: of embeddings, of the sums of squares behind them, of the rest.
FINE, FINE_SEEN, FINE_DENSE = 2.0 ** 16, 2.0 ** 40, 2.0 ** 32
#: Texts scored at a time, and words that they have together unless one has more.
TEXTS, WORDS = 64, 32_768
#: Words whose vectors a worker remembers; the memory is emptied beyond it, results don't change.
REMEMBERED = 65_536
EPOCHS, BATCH, RATE = 5, 32, 0.01
DECISION = 0.7
_TRIM = b".,;:!?\"'()[]{}<>-*_#%&$|"


def tokens(text: str | None) -> list[bytes]:
    return utf8(text.lower() if text else "").split()


def buckets(some: Iterable[bytes]) -> np.ndarray:
    """Buckets of words, one row a word: of the word and of its first bytes."""
    bare = [w.strip(_TRIM) or w for w in some]
    parts = [[b"=" + w for w in bare]]
    for n in PREFIXES:
        mark = b"%d" % n
        parts.append([mark + w[:n] for w in bare])
    return np.stack([np.fromiter(map(xxhash.xxh3_64_intdigest, p), np.uint64, len(p)) % BUCKETS for p in parts], axis=1).astype(np.int32)


class Words:
    """Numbers of words and their buckets; a bounded number is remembered."""

    def __init__(self):
        self.index: dict[bytes, int] = {}
        self.buckets = np.zeros((REMEMBERED, 1 + len(PREFIXES)), np.int32)

    def of(self, texts: list[list[bytes]]) -> tuple[list[np.ndarray], int]:
        """Each text as numbers of words, and the number of the first word that is new."""
        new = set().union(*texts).difference(self.index)
        if len(self.index) + len(new) > len(self.buckets):
            new = set().union(*texts)
            self.index = {}
            if len(new) > len(self.buckets):
                self.buckets = np.zeros((len(new), 1 + len(PREFIXES)), np.int32)
        first = len(self.index)
        if new:
            self.index.update(zip(new, range(first, first + len(new))))
            self.buckets[first:first + len(new)] = buckets(new)
        return [np.fromiter(map(self.index.__getitem__, w), np.int64, len(w)) for w in texts], first


class Vectors:
    """Rows of the embedding table for words; words seen before are remembered, up to a bound."""

    def __init__(self, embedding: np.ndarray):
        self.embedding = embedding
        self.words = Words()
        self.rows = np.zeros((REMEMBERED, embedding.shape[1]), np.float32)

    def of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        numbers, first = self.words.of(texts)
        if len(self.rows) < len(self.words.buckets):
            self.rows = np.zeros((len(self.words.buckets), self.embedding.shape[1]), np.float32)
        last = len(self.words.index)
        if first < last:
            ids = self.words.buckets[first:last]
            self.rows[first:last] = sum(self.embedding[ids[:, k]] for k in range(ids.shape[1])) / np.float32(ids.shape[1])
        return [self.rows[n] for n in numbers]


def by_words(texts: Iterable[list[bytes]], most: int = WORDS) -> Iterator[list[list[bytes]]]:
    """Texts in a row, at most ``most`` words together; a longer one alone."""
    held, size = [], 0
    for words in texts:
        if held and (size + len(words) > most or len(held) >= TEXTS):
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts below each other, empty rows behind each, and where each begins."""
    gap = max(WIDTHS)
    size = [len(p) + gap for p in parts]
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    x = np.zeros((sum(size) + gap, parts[0].shape[1]), np.float32)
    for at, p in zip(start, parts):
        x[at:at + len(p)] = p
    return x, start


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.2, FILTERS * len(WIDTHS)).astype(np.float32)
        self.out_bias = np.float32(0)
        self.slope, self.offset = 1.0, 0.0
        self.constant: float | None = None
        self.thresholds: dict[str, float] = {}

    def _pooled(self, x: np.ndarray, start: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        n = len(x) - max(WIDTHS) + 1
        responses = [sum(x[k:k + n] @ f[k] for k in range(len(f))) for f in self.filters]
        # A filter at the end of a text must not see the words of the next one.
        for f, r in zip(self.filters, responses):
            for back in range(1, len(f)):
                r[start[1:] - back] = -np.inf
        return responses, np.concatenate([np.maximum.reduceat(r, start) for r in responses], axis=1)

    def logits(self, parts: list[np.ndarray]) -> np.ndarray:
        x, start = _padded(parts)
        _, best = self._pooled(x, start)
        return np.maximum(best + self.bias, 0) @ self.out + self.out_bias

    def scores(self, parts: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(parts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(parts).astype(np.float64) + self.offset, -30, 30)))

    def begin(self, count: np.ndarray, n: np.ndarray) -> None:
        """Start the first dimension at how much more often texts of class 1 have a bucket.

        ``count`` holds, by class, the texts that have a bucket, ``n`` all texts.  The
        difference of both shares in standard errors, so that rare words start near
        zero; one filter of each width starts by looking at that dimension.
        """
        share = count / n[:, None]
        both = count.sum(axis=0) / n.sum()
        error = np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n).sum())
        self.embedding *= 0.3
        self.embedding[:, 0] = np.clip((share[1] - share[0]) / error, -6, 6) / 2
        for k, f in enumerate(self.filters):
            f[0, 0, 0] = 1.0
            self.out[k * FILTERS] = 1.0
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (*self.filters, self.bias, self.out)]
        self.rows_seen = np.full(BUCKETS, 1e-8, np.float32)
        self.steps = 0
        self.weight = n.sum() * 0.5 / np.maximum(1, n)

    def train(self, ids: list[np.ndarray], labels: np.ndarray, seed: int) -> None:
        """One epoch over a unit; ``ids`` holds the buckets of each text's words, one row a word."""
        weight = self.weight[labels]
        dense = [*self.filters, self.bias, self.out]
        order = np.random.default_rng(seed).permutation(len(ids))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            self.steps += 1
            self._step([ids[i] for i in pick], labels[pick], weight[pick], dense, self.moments, self.rows_seen, self.steps)

    def dense(self) -> np.ndarray:
        """All but the embeddings as one row of numbers, with the moments and the steps taken."""
        parts = [*self.filters, self.bias, self.out, *[x for pair in self.moments for x in pair], self.out_bias, self.steps / 1024]
        return np.concatenate([np.ravel(p) for p in parts]).astype(np.float64)

    def set_dense(self, values: np.ndarray) -> None:
        at = 0
        for p in (*self.filters, self.bias, self.out, *[x for pair in self.moments for x in pair]):
            p[...] = values[at:at + p.size].reshape(p.shape)
            at += p.size
        self.out_bias, self.steps = np.float32(values[at]), int(round(values[at + 1] * 1024))

    def _step(self, ids, y, weight, dense, moments, rows_seen, step) -> None:
        x, start = _padded([self.embedding[i].mean(axis=1) if len(i) else np.zeros((0, DIM), np.float32) for i in ids])
        responses, best = self._pooled(x, start)
        active = np.maximum(best + self.bias, 0)
        p = 1 / (1 + np.exp(-np.clip(active @ self.out + self.out_bias, -30, 30)))
        slope = ((p - y) * weight / len(y)).astype(np.float32)
        through = slope[:, None] * self.out * (best + self.bias > 0)
        end = np.append(start[1:], len(x) - max(WIDTHS))
        grads, dx = [], np.zeros_like(x)
        for k, (f, r) in enumerate(zip(self.filters, responses)):
            g = through[:, k * FILTERS:(k + 1) * FILTERS]
            where = np.stack([a + r[a:b].argmax(axis=0) for a, b in zip(start, end)])
            df = np.zeros_like(f)
            for j in range(len(f)):
                df[j] = np.einsum("dfe,df->ef", x[where + j], g)
                np.add.at(dx, where + j, g[:, :, None] * f[j].T[None])
            grads.append(df)
        grads += [through.sum(axis=0), active.T @ slope + 1e-4 * self.out]
        for p_, g, (m, v) in zip(dense, grads, moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p_ -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        self.out_bias -= np.float32(RATE * slope.sum())
        for at, words in zip(start, ids):
            d = dx[at:at + len(words)]
            moved = np.flatnonzero(np.abs(d).sum(axis=1))
            for bucket in words[moved].T:
                np.add.at(rows_seen, bucket, (d[moved] ** 2).mean(axis=1))
                np.subtract.at(self.embedding, bucket,
                               5 * RATE * d[moved] / np.sqrt(rows_seen[bucket])[:, None] / words.shape[1])

    def calibrate(self, held: DataFrame) -> None:
        """Logistic scaling of held-back logits (logit, toxic, lang), then a threshold per language."""
        a, b = 1.0, 0.0
        n, ones = held.agg(F.count(F.lit(1)), F.sum("toxic")).first()
        # Targets short of 0 and 1 keep a perfect separation finite.
        target = F.when(F.col("toxic") == 1, (ones + 1) / (ones + 2)).otherwise(1 / (n - ones + 2))
        x = F.col("logit")

        def p() -> Column:
            return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x * a + b))))

        for _ in range(100):
            w = F.greatest(p() * (1 - p()), F.lit(1e-9))
            wxx, wx, ws, gx, g = held.agg(F.sum(w * x * x), F.sum(w * x), F.sum(w), F.sum((target - p()) * x),
                                          F.sum(target - p())).first()
            move = np.linalg.solve(np.array([[wxx + 1e-3, wx], [wx, ws + 1e-3]]), np.array([gx - 1e-3 * (a - 1), g]))
            a, b = a + float(np.clip(move[0], -1, 1)), b + float(np.clip(move[1], -1, 1))
            if np.abs(move).max() < 1e-9:
                break
        if a > 0:
            self.slope, self.offset = a, b
        a, b = self.slope, self.offset
        self.thresholds = thresholds(held.select("lang", "toxic", p().alias("score")))


def thresholds(scored: DataFrame, least: float = 0.5, most: float = 0.9) -> dict[str, float]:
    """By language the middle of the gap with the best F1 score, within bounds; few labels keep the default.

    ``scored`` has lang, toxic and score; equal scores stay on one side.
    """
    ranked = cut(distribution(scored.where("lang is not null"), ["lang"], "score", weights={"pos": F.col("toxic").cast("double")}))
    found, positives = F.col("n") - F.col("below"), F.col("n_pos") - F.col("below_pos")
    best = ranked.groupBy("lang").agg(
        F.max(F.struct((2 * positives / (found + F.col("n_pos"))).alias("f1"), "score")).alias("best"),
        F.max("n").alias("n"), F.max("n_pos").alias("ones"))
    best = best.select("lang", "n", "ones", F.col("best.score").alias("high"))
    under = ranked.select("lang", "score").join(best, "lang").groupBy("lang", "n", "ones", "high").agg(
        F.max(F.when(F.col("score") < F.col("high"), F.col("score"))).alias("low"))
    out = {}
    for r in under.collect():  # one row a language
        few = r["ones"] < 5 or r["n"] - r["ones"] < 5
        out[r["lang"]] = DECISION if few else float(np.clip((r["high"] + (r["low"] or 0.0)) / 2, least, most))
    return out


def labelled(docs: DataFrame, labels: DataFrame, unit: int = UNIT) -> DataFrame:
    """Every labelled row that may be learnt from: shard, back, lang, toxic and the buckets of its words, row by row.

    A shard is one partition, its rows in the order of a hash of doc_id; ``back`` rows are held back.
    """
    known = cut(labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
                .where(crc32_of_id(F.col("doc_id")) % 3 != 1))
    shards = max(1, -(-known.count() // unit))
    at = F.xxhash64("doc_id")
    may = docs.where(crc32_of_id(F.col("doc_id")) % 3 != 1).join(known, "doc_id")
    dealt = may.repartition(shards, "doc_id").select(
        F.pmod(F.hash("doc_id"), F.lit(shards)).alias("shard"), at.alias("at"), (F.pmod(at, F.lit(5)) == 4).alias("back"),
        "lang", "toxic", "text").sortWithinPartitions("shard", "at", "text").drop("at")

    def hashed(taken: Rows) -> Rows:
        seen = Words()
        for shard, back, lang, toxic, text in taken:
            (numbers,), _ = seen.of([tokens(text)])
            yield shard, back, lang, toxic, seen.buckets[numbers].tobytes()

    return cut(map_rows(dealt, hashed, 256, shard="int", back="boolean", lang="string", toxic="int", ids="binary"))


def units(rows: Rows, unit: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """Shard, buckets and classes of rows (shard, toxic, ids) that are trained on in a row."""
    for shard, own in groupby(rows, itemgetter(0)):
        ids, kinds, size = [], [], 0
        for _, toxic, data in own:
            if ids and (len(ids) >= 2 * unit or size >= UNIT_WORDS):
                yield shard, ids, np.array(kinds, np.int64)
                ids, kinds, size = [], [], 0
            ids.append(np.frombuffer(data, np.int32).reshape(-1, 1 + len(PREFIXES)))
            kinds.append(toxic)
            size += len(ids[-1])
        if ids:
            yield shard, ids, np.array(kinds, np.int64)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, compressed: their high bytes are mostly zero."""
    near_zero = (values << 1) ^ (values >> 63)
    return zlib.compress(np.ascontiguousarray(near_zero).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    near_zero = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return (near_zero >> np.uint64(1)).astype(np.int64) ^ -(near_zero & np.uint64(1)).astype(np.int64)


_SUMS = {"block": "int", "part": "int", "sums": "binary"}


def added(sums: DataFrame) -> dict[int, np.ndarray]:
    """Sums of equal blocks over all tasks, as many as a network has blocks."""
    kind = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("sums", pa.binary())])

    def add(some: pa.Table) -> pa.Table:
        whole = sum(unpacked(s.as_py()) for s in some.column("sums"))
        return pa.table([[some["block"][0].as_py()], [some["part"][0].as_py()], [packed(whole)]], schema=kind)

    names = ", ".join(f"{c} {k}" for c, k in _SUMS.items())
    parts = sums.groupBy("block", "part").applyInArrow(add, names)
    return {r["block"]: unpacked(r["sums"]) for r in parts.groupBy("block").applyInArrow(add, names).collect()}


def in_blocks(by_bucket: np.ndarray, *more: np.ndarray) -> Rows:
    """A task's sums, one row per bucket, as blocks that some bucket moved; ``more`` become blocks of their own."""
    part = TaskContext.get().partitionId() % PARTS
    for k, at in enumerate(range(0, BUCKETS, BLOCK)):
        own = by_bucket[at:at + BLOCK]
        if own.any():
            yield k, part, packed(own.ravel())
    for k, values in enumerate(more):
        yield BUCKETS // BLOCK + k, part, packed(values)


def out_of_blocks(found: dict[int, np.ndarray], columns: int) -> np.ndarray:
    out = np.zeros((BUCKETS, columns), np.int64)
    for k, at in enumerate(range(0, BUCKETS, BLOCK)):
        if k in found:
            out[at:at + BLOCK] = found[k].reshape(-1, columns)
    return out


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """By class the texts of ``rows`` that have a bucket."""

    def run(taken: Rows) -> Rows:
        count = np.zeros((BUCKETS, 2), np.int64)
        for toxic, data in taken:
            count[np.unique(np.frombuffer(data, np.int32)), toxic] += 1
        yield from in_blocks(count)

    return out_of_blocks(added(map_rows(rows.select("toxic", "ids"), run, 8, **_SUMS)), 2).T


def epoch(rows: DataFrame, net: Network, number: int, unit: int) -> None:
    """Every unit trains from ``net``, which then takes the mean of their changes."""
    model = rows.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(taken: Rows) -> Rows:
        start = model.value
        first = start.dense()
        moved = np.zeros((BUCKETS, DIM + 2), np.int64)
        dense, weight = np.zeros(len(first), np.int64), 0
        for shard, ids, kinds in units(taken, unit):
            own, n = copy.deepcopy(start), len(ids)
            own.train(ids, kinds, 11 + 7919 * number + shard)
            at = np.flatnonzero(own.rows_seen != start.rows_seen)
            moved[at, :DIM] += np.rint((own.embedding[at] - start.embedding[at]) * FINE).astype(np.int64) * n
            moved[at, DIM] += np.rint((own.rows_seen[at] - start.rows_seen[at]) * FINE_SEEN).astype(np.int64) * n
            moved[at, DIM + 1] += n
            dense += np.rint((own.dense() - first) * FINE_DENSE).astype(np.int64) * n
            weight += n
        if weight:
            yield from in_blocks(moved, dense, np.array([weight]))

    found = added(map_rows(rows.select("shard", "toxic", "ids"), run, 8, **_SUMS))
    model.unpersist()
    moved, last = out_of_blocks(found, DIM + 2), BUCKETS // BLOCK
    share = np.maximum(1, moved[:, DIM + 1]).astype(np.float64)
    net.embedding += (moved[:, :DIM] / FINE / share[:, None]).astype(np.float32)
    net.rows_seen += (moved[:, DIM] / FINE_SEEN / share).astype(np.float32)
    net.set_dense(net.dense() + found[last] / FINE_DENSE / found[last + 1][0])


def held_logits(rows: DataFrame, net: Network) -> DataFrame:
    model = rows.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(taken: Rows) -> Rows:
        net = model.value
        for toxic, lang, data in taken:
            ids = np.frombuffer(data, np.int32).reshape(-1, 1 + len(PREFIXES))
            yield float(net.logits([net.embedding[ids].mean(axis=1)])[0]), toxic, lang

    return map_rows(rows.select("toxic", "lang", "ids"), run, logit="double", toxic="int", lang="string")


def fit(docs: DataFrame, labels: DataFrame, unit: int = UNIT) -> Network:
    """Train on all labelled rows; one class only gives a constant score, no labels 0."""
    with small_batches(docs.sparkSession):
        rows = labelled(only(docs, doc_id="bigint", text="string", lang="string"),
                        only(labels, doc_id="bigint", toxic="int"), unit)
        net = Network()
        n = {(r["toxic"], r["back"]): r["n"] for r in rows.groupBy("toxic", "back").agg(F.count(F.lit(1)).alias("n")).collect()}
        kinds = {k for k, _ in n}
        if len(kinds) < 2:
            net.constant = float(kinds.pop()) if kinds else 0.0
            return net
        # Rows are held back for calibration if there are enough of either class.
        enough = all(n.get((k, True), 0) >= 5 and n.get((k, False), 0) >= 20 for k in kinds)
        fitted, back = (rows.where("not back"), rows.where("back")) if enough else (rows, rows)
        net.begin(bucket_counts(fitted), np.array([n.get((k, False), 0) + (0 if enough else n.get((k, True), 0)) for k in (0, 1)]))
        for number in range(EPOCHS):
            epoch(fitted, net, number, unit)
        net.calibrate(cut(held_logits(back, net)))
        del net.moments, net.rows_seen, net.weight
    return net


def score(docs: DataFrame, net: Network, decision: float = DECISION) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold and toxic of every row of ``docs``.

    predicted is 1 from a score of ``decision`` on; toxic holds where the score
    reaches the threshold of the row's language (``decision`` for unknown or null
    ones).  ``docs`` has doc_id, text and lang; other columns are ignored.  Texts that
    are null, empty or of any length are scored whole; rows that repeat a doc_id are
    scored each; no rows give no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(rows: Rows) -> Rows:
        net = model.value
        vectors = Vectors(net.embedding)
        while some := list(islice(rows, TEXTS)):
            found = [s for part in by_words(tokens(text) for _, text, _, _ in some) for s in net.scores(vectors.of(part))]
            for (doc_id, _, lang, held), s in zip(some, found):
                at = net.thresholds.get(lang, decision)
                yield doc_id, held, float(s), int(s >= decision), at, bool(s >= at)

    rows = only(docs, doc_id="bigint", text="string", lang="string").withColumn(
        "held_out", crc32_of_id(F.col("doc_id")) % 3 == 1)
    return map_rows(rows, run, doc_id="bigint", held_out="boolean", score="double", predicted="int",
                    threshold="double", toxic="boolean")


def without_toxic(docs: DataFrame, net: Network, decision: float = DECISION) -> DataFrame:
    """Rows of ``docs`` that are not toxic at the threshold of their language, unchanged.

    Rows are judged where they lie, so nothing is shuffled.  A null or empty text is one without
    words, an unknown or null language has the default threshold; repeated rows are judged each,
    columns may have any names, no rows give none.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    @F.pandas_udf("boolean")
    def toxic(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        net = model.value
        vectors = Vectors(net.embedding)
        for texts, languages in parts:
            scores = (s for part in by_words(tokens(t) for t in texts) for s in net.scores(vectors.of(part)))
            yield pd.Series([bool(s >= net.thresholds.get(lang, decision)) for s, lang in zip(scores, languages)], dtype=bool)

    return docs.where(~toxic(F.col("text").cast("string"), F.col("lang").cast("string")))
