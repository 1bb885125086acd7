"""Removal of paragraphs that repeat across documents, and of passages inside them.

Paragraphs are lines, and blocks of lines between blank lines, of at least one five-word
shingle.  MinHash bands, as few as keep the chance to miss a pair at the threshold below a
hundredth (``tuned``), lead similar paragraphs together; who meets is decided by the exact
Jaccard similarity of the shingle sets.  Of paragraphs that such pairs join, directly or in a
chain, the first document keeps its own; later documents lose theirs.

Passages that stand inside paragraphs are found besides, wherever they begin.  The signature of
a run of 50 words is the smallest hash of its five-word shingles; overlapping runs mostly share
it, so few anchors stand for all runs of a text.  Each anchor gives two keys: the 25 words from
it on, and the 25 words that end with it.  Of any 50 words that two documents have in common,
the anchor is the same in both and at least one of the keys lies inside.

Documents that share a key are compared with the first document that has it, word by word (edit
distance zero), and the match is extended to both sides as far as the words agree.  Two later
documents can have more in common with each other only if they part from the first one at the
same distance from the key and go on with the same word; who does so, with a word that no match
has taken yet, meets in another round, until nobody is left.  The first document keeps its words, the others lose them.  Documents that
are joined by removals, directly or in a chain, form a component.

One pass over the texts makes keys, bands and digests; texts are read again only where a
document takes part in a comparison.  Members are joined to one keeper, so a passage held by a
third of all documents costs as much per document as any other.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.core.lineage import cut
from eventide.llm.columns import Rows, fresh, map_rows, only, small_batches
from eventide.llm.components import components
from eventide.llm.minhash import Bands
from eventide.llm.ngram_join import link_tile, tiles
from eventide.llm.words import mixed, runs, utf8, word_hashes, words

PARAGRAPH, SHINGLE, KEY = 50, 5, 25
#: Jaccard similarity of paragraphs that count as repeated.
NUM, DEN = 80, 100
#: Chance to miss a pair of paragraphs at the threshold, and the most bands to spend on it.
MISS, MOST_BANDS = 0.01, 10
#: Digests that a task remembers, to give the keys of equal texts and paragraphs once.
HELD = 1_000_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = " \t\n\r\x0b\x0c"


def anchors(shingles: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the leftmost minimum of some ``width`` consecutive values."""
    n = len(shingles) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, have = shingles, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:len(least) - step], least[step:])
        have += step
    new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (shingles[:n - 1] == least[:-1])])
    windows = np.lib.stride_tricks.sliding_window_view(shingles, width)
    return np.unique(new + windows[new].argmin(axis=1))


def tuned(similarity: float, miss: float = MISS, most: int = MOST_BANDS) -> tuple[int, int]:
    """Bands and rows: as many rows as ``most`` bands allow, so that few unlike pairs meet."""
    best = (most, 1)
    for rows in range(1, 20):
        bands = math.ceil(math.log(miss) / math.log(1 - similarity ** rows))
        if bands > most:
            break
        best = (bands, rows)
    return best


#: An odd number and its inverse modulo 2**64.
_BASE, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def windows(h: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` values from each start on: differences of one running polynomial sum."""
    base, back = np.full(len(h), _BASE, np.uint64), np.full(len(h), _BACK, np.uint64)
    base[:1] = back[:1] = 1
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * np.multiply.accumulate(base))])
    return mixed((total[start + width] - total[start]) * np.multiply.accumulate(back)[start])


def keys(h: np.ndarray, s: np.ndarray, paragraph: int, shingle: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the passages of a text and the position of their first word; ``h`` hashes words, ``s`` shingles."""
    if len(h) < paragraph:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = anchors(s, paragraph - shingle + 1)
    start = np.unique(np.concatenate([at, at + shingle - key]))
    start = start[(start >= 0) & (start <= len(h) - key)]
    return windows(h, start, key).view(np.int64), start


def common_runs(a: list, b: list, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Per hit (position in a, in b) the maximal run [start, end) of ``a`` around it where both agree."""
    number: dict = {}
    x = np.fromiter((number.setdefault(w, len(number)) for w in a), np.int64, len(a))
    y = np.fromiter((number.setdefault(w, len(number)) for w in b), np.int64, len(b))
    out, last = {}, {}
    for i, j in sorted(hits):
        start, end = last.get(i - j, (0, 0))
        if i >= end:
            back = min(i, j)
            differ = np.flatnonzero(x[i - back:i] != y[j - back:j])
            start = i - back + (int(differ[-1]) + 1 if len(differ) else 0)
            ahead = min(len(x) - i, len(y) - j)
            differ = np.flatnonzero(x[i:i + ahead] != y[j:j + ahead])
            end = i + (int(differ[0]) if len(differ) else ahead)
            last[i - j] = start, end
        out[i, j] = start, end
    return [out[h] for h in hits]


def paragraphs(text: str | None, least: int = SHINGLE) -> list[tuple[int, int]]:
    """Words [start, end) of paragraphs of at least ``least`` words.

    Lines, and blocks of several lines where blank lines part the text.
    """
    lines, word = [], 0
    blocks: list[list[int]] = []
    open_ = False
    for line in utf8(text).split(b"\n"):
        n = len(line.split())
        if n:
            if not open_:
                blocks.append([len(lines), 0])
            lines.append((word, word + n))
            blocks[-1][1] = len(lines)
        open_ = n > 0
        word += n
    found = set(lines)
    if len(blocks) > 1:
        found |= {(lines[i][0], lines[j - 1][1]) for i, j in blocks}
    return sorted(p for p in found if p[1] - p[0] >= least)


def distinct_counts(shingles: np.ndarray, spans: list[tuple[int, int]]) -> list[int]:
    """Number of distinct values of each slice."""
    order = np.argsort(shingles, kind="stable")
    same = shingles[order[1:]] == shingles[order[:-1]]
    before = np.full(len(shingles), -1)
    before[order[1:][same]] = order[:-1][same]
    repeated = np.concatenate([[0], np.cumsum(before >= 0)])
    return [b - a if repeated[b] == repeated[a] else int((before[a:b] < a).sum()) for a, b in spans]


_SIGNED = {"doc_id": "bigint", "text_hash": "bigint", "digest": "binary", "n_words": "bigint", "key": "array<bigint>",
           "pos": "array<bigint>", "start": "array<bigint>", "end": "array<bigint>",
           "n": "array<bigint>", "same": "array<bigint>", "bands": "array<bigint>"}


def signatures(docs: DataFrame, paragraph: int, shingle: int, key: int, num: int, den: int) -> DataFrame:
    """Per row its digest and number of words, the keys of its passages, and its paragraphs.

    Paragraphs: words [start, end), n (distinct shingles), same (hash
    of the words) and, in one row of bands each, its keys; those of equal paragraphs are given once a
    task.  Of texts with the same words only those of the smallest ids of a task have keys.
    """
    bands, rows = tuned(num / den)

    def run(taken: Rows) -> Rows:
        family, texts, parts = Bands(bands, rows), {}, set()
        for doc_id, text, text_hash in taken:
            tokens = words(text)
            digest = hashlib.blake2b(b" ".join(tokens), digest_size=16).digest()
            if texts.get(digest, doc_id + 1) <= doc_id:  # equal texts are found by their digest
                yield doc_id, text_hash, digest, len(tokens), *[[]] * 7
                continue
            texts[digest] = doc_id
            h = word_hashes(tokens)
            s = runs(h, shingle)
            found, at = keys(h, s, paragraph, shingle, key)
            spans = paragraphs(text, shingle)
            same = [xxhash.xxh3_64_intdigest(h[a:b].tobytes()) - (1 << 63) for a, b in spans]
            n, banded = [], np.empty(0, np.int64)
            if spans:
                cut_ = [(a, b - shingle + 1) for a, b in spans]
                n = distinct_counts(s, cut_)
                banded = family.keys_of(s, cut_)
                for i, x in enumerate(same):
                    if x in parts:
                        banded[i] = 0
                    else:
                        parts.add(x)
                if len(parts) > HELD:
                    parts.clear()
            if len(texts) > HELD:
                texts.clear()
            yield (doc_id, text_hash, digest, len(tokens), found, at, [a for a, _ in spans], [b for _, b in spans], n,
                   same, banded.ravel())

    return map_rows(docs.select("doc_id", "text", F.xxhash64("text")), run, 256, **_SIGNED)


def _cut(df: DataFrame) -> DataFrame:
    with small_batches(df.sparkSession):
        return cut(df)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text_hash and text of the given documents; a shuffle join, as both sides grow."""
    return docs.join(ids.distinct().hint("merge"), "doc_id").select("doc_id", F.xxhash64("text").alias("text_hash"), "text").distinct()


def meeting_paragraphs(signed: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """All paragraphs (without bands), and those that share a band with one of other words, with their tiles."""
    bands, _ = tuned(num / den)
    cut_up = signed.select("doc_id", "text_hash", F.explode(F.arrays_zip("start", "end", "n", "same")).alias("p")).select(
        "doc_id", "text_hash", "p.*")
    banded = signed.select(F.explode(F.expr(
        f"transform(same, (x, i) -> struct(x AS same, slice(bands, i * {bands} + 1, {bands}) AS keys))")).alias("p")).select(
        "p.same", F.explode("p.keys").alias("band")).where("band <> 0")
    shared = cut(banded.groupBy("band").agg(F.min("same").alias("low"), F.max("same").alias("high")).where("low < high").select("band", "low"))
    met = banded.join(shared.hint("merge"), "band").where("same <> low").select("low", "same").distinct()
    cells = components(met).select(F.col("node").alias("same"), F.col("component").alias("cell"))
    held = cut_up.join(cells.hint("merge"), "same").groupBy("same", "cell").agg(
        F.min(F.struct("doc_id", "text_hash", "start", "end")).alias("at"), F.first("n").alias("n"))
    members = cut(held.select(F.col("same").alias("rep"), "cell", "n", F.lit(1).cast("bigint").alias("copies"),
                              F.lit(None).cast("binary").alias("digest"), "at.*"))
    placed = tiles(members.select("rep", "cell", "n", "copies", "digest"), num, den).groupBy("rep").agg(
        F.collect_list(F.struct("tile", "side")).alias("tiles"))
    return cut_up, members.join(placed, "rep").select("rep", "doc_id", "text_hash", "start", "end", "tiles")


def similar_paragraphs(cut_up: DataFrame, wanted: DataFrame, texts: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """doc_id, text_hash, start_word, end_word and keep_id of paragraphs like those of an earlier document."""
    asked = texts.join(wanted.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("rep", "start", "end", "tiles")).alias("parts")), ["doc_id", "text_hash"]).select("text", "parts")

    def arrays(rows: Rows) -> Rows:
        for text, parts in rows:
            s = runs(word_hashes(words(text)), shingle)
            for p in parts:
                packed = np.unique(s[p["start"]:p["end"] - shingle + 1]).tobytes()
                for t in p["tiles"]:
                    yield t["tile"], t["side"], p["rep"], 1, packed

    valued = map_rows(asked, arrays, 64, tile="bigint", side="int", rep="bigint", copies="bigint", values="binary")
    linked = _cut(valued.groupBy("tile").applyInArrow(
        lambda t: link_tile(t, num, den), "rep bigint, links bigint, least bigint"))
    joined = components(linked.select("rep", "least").where("rep <> least")).select(
        F.col("node").alias("same"), F.col("component").alias("other"))
    # Equal paragraphs are one class as they are; similar ones take the smallest hash of theirs.
    held = cut_up.join(joined.hint("merge"), "same", "left").select(
        "doc_id", "text_hash", "start", "end", F.coalesce("other", "same").alias("class"))
    keeper = cut(held.groupBy("class").agg(F.min("doc_id").alias("keep_id"), F.max("doc_id").alias("high"))
                 .where("keep_id < high").select("class", "keep_id"))
    return held.join(keeper.hint("merge"), "class").where("keep_id < doc_id").select(
        "doc_id", "text_hash", F.col("start").alias("start_word"), F.col("end").alias("end_word"), "keep_id")


def _round(hits: DataFrame, texts: DataFrame, key: int) -> DataFrame:
    """spans and next (keys of the next round) per document and its keeper; ``hits`` has doc_id, key and pos."""
    keeper = cut(hits.groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("k")).select(
        "key", F.col("k.doc_id").alias("keep_id"), F.col("k.pos").alias("keep_pos")))
    pairs = hits.join(keeper.hint("merge"), "key").where("doc_id <> keep_id").groupBy("doc_id", "keep_id").agg(
        F.sort_array(F.collect_set(F.struct("pos", "keep_pos", "key"))).alias("hits"))
    both = (pairs.join(texts.hint("merge"), "doc_id").join(texts.select(
        F.col("doc_id").alias("keep_id"), F.col("text").alias("keep_text")).hint("merge"), "keep_id")
        .select("doc_id", "text_hash", "text", "keep_id", "keep_text", "hits"))

    def verify(rows: Rows) -> Rows:
        for doc_id, text_hash, text, keep_id, keep_text, found in rows:
            a, b = words(text), words(keep_text)
            inside = [h for h in found if h["pos"] < len(a) and h["keep_pos"] < len(b)]
            agreed = common_runs(a, b, [(h["pos"], h["keep_pos"]) for h in inside])
            spans = sorted({r for r in agreed if r[1] - r[0] >= key})
            again, at, ends = [], [], []
            for h, (start, end) in zip(inside, agreed):
                # Where the match ends, seen from the key, and the word that goes on there.
                for side, far, beyond in ((0, h["pos"] - start, start - 1), (1, end - h["pos"], end)):
                    if end > start and 0 <= beyond < len(a):
                        word = xxhash.xxh3_64_intdigest(a[beyond], seed=(h["key"] * 2 + side) & ((1 << 64) - 1))
                        again.append(xxhash.xxh3_64_intdigest(b"%d %d" % (word, far)) - (1 << 63))
                        at.append(h["pos"])
                        ends.append(beyond)
            yield doc_id, text_hash, keep_id, [s for s, _ in spans], [e for _, e in spans], again, at, ends

    return _cut(map_rows(both, verify, 256, doc_id="bigint", text_hash="bigint", keep_id="bigint", start="array<bigint>",
                         end="array<bigint>", key="array<bigint>", pos="array<bigint>", beyond="array<bigint>"))


def _shared(keyed: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose key several documents have."""
    shared = cut(keyed.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
                 .where("low < high").select("key"))
    return keyed.join(shared.hint("merge"), "key").select("doc_id", "key", "pos")


def repeated_spans(docs: DataFrame, paragraph: int = PARAGRAPH, shingle: int = SHINGLE, key: int = KEY,
                   num: int = NUM, den: int = DEN) -> tuple[DataFrame, DataFrame]:
    """Spans to remove, and per row of ``docs`` its digest class.

    Spans: doc_id, text_hash, start_word, end_word, keep_id.
    Classes: doc_id, n_words, first_id (smallest doc_id with the same words).
    """
    if 2 * key > paragraph:
        raise ValueError("a key is at most half a paragraph")
    docs = docs.where("doc_id is not null")
    signed = _cut(signatures(docs, paragraph, shingle, key, num, den))
    first = signed.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    classes = cut(signed.select("doc_id", "digest", "n_words").join(first.hint("merge"), "digest").drop("digest"))
    moved = classes.where("doc_id <> first_id").select("doc_id", "first_id").distinct()
    keyed = signed.select("doc_id", F.explode(F.arrays_zip("key", "pos")).alias("k")).select(
        "doc_id", "k.key", F.col("k.pos").cast("int").alias("pos"))
    hits = cut(_shared(keyed).join(moved.hint("merge"), "doc_id", "left").select(
        F.coalesce("first_id", "doc_id").alias("doc_id"), "key", "pos").distinct())
    cut_up, wanted = meeting_paragraphs(signed, num, den)
    wanted = cut(wanted)
    texts = cut(texts_of(docs, hits.select("doc_id").unionByName(wanted.select("doc_id"))))
    spans = similar_paragraphs(cut_up, wanted, texts, shingle, num, den)
    spans = cut(spans)
    while not hits.isEmpty():
        found = _round(hits, texts, key)
        spans = spans.unionByName(found.select("doc_id", "text_hash", "keep_id", F.explode(F.arrays_zip("start", "end")).alias("s"))
                                  .select("doc_id", "text_hash", F.col("s.start").alias("start_word"),
                                          F.col("s.end").alias("end_word"), "keep_id"))
        # Only who would go on with a word that nobody has taken yet.
        taken = spans.join(found.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("taken"))
        going = found.select("doc_id", F.explode(F.arrays_zip("key", "pos", "beyond")).alias("k")).select(
            "doc_id", "k.key", F.col("k.pos").cast("int").alias("pos"), "k.beyond").distinct()
        left = going.join(taken.hint("merge"), "doc_id", "left").where(F.coalesce(~F.exists("taken", lambda s: (
            (s["start_word"] <= F.col("beyond")) & (F.col("beyond") < s["end_word"]))), F.lit(True)))
        hits = cut(_shared(cut(left.select("doc_id", "key", "pos").distinct())))
    # Copies go whole, by their class.
    copies = moved.join(classes.where(f"n_words >= {shingle}").select("doc_id").distinct(), "doc_id").select("doc_id")
    return cut(spans.join(copies.hint("merge"), "doc_id", "left_anti").distinct()), classes


def substring_dedup(docs: DataFrame, paragraph: int = PARAGRAPH, shingle: int = SHINGLE,
                    key: int = KEY) -> DataFrame:
    """What every document loses: doc_id, component_id, n_words, removed_words, n_spans,
    keep_ids (documents that keep what it loses) and kept.

    ``docs`` has doc_id and text; other columns are ignored.  A null text is empty;
    paragraphs below ``shingle`` words are not compared, passages inside paragraphs from
    ``paragraph`` words on.  Of texts with the same words, ``shingle`` at least, only the first
    stays, the others lose all.  kept is false where nothing is left.  Rows
    that repeat a doc_id are one document and don't repeat each other; rows without
    doc_id are not compared and don't appear.  No rows give no rows.
    """
    spans, classes = repeated_spans(only(docs, doc_id="bigint", text="string"), paragraph, shingle, key)
    lost = _words_lost(spans)
    copy = (F.col("doc_id") != F.col("first_id")) & (F.col("n_words") >= shingle)
    rows = (classes.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.min("first_id").alias("first_id"))
            .withColumn("copy", copy).join(lost, "doc_id", "left"))
    edges = spans.select("doc_id", "keep_id").unionByName(
        rows.where("copy").select("doc_id", F.col("first_id").alias("keep_id")))
    parts = components(edges.distinct()).withColumnRenamed("node", "doc_id")
    removed = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("lost", F.lit(0)))
    return rows.join(parts, "doc_id", "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("component_id"), "n_words",
        removed.cast("bigint").alias("removed_words"),
        F.when(F.col("copy"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(F.col("copy"), F.array("first_id")).otherwise(
            F.coalesce("keep_ids", F.array().cast("array<bigint>"))).alias("keep_ids"),
        ((F.col("n_words") == 0) | (removed < F.col("n_words"))).alias("kept"))


def _words_lost(spans: DataFrame) -> DataFrame:
    """doc_id, lost (words in the union of its spans), n_spans and keep_ids."""
    ordered = F.sort_array(F.collect_list(F.struct("start_word", "end_word")))
    step = F.aggregate(
        "s", F.struct(F.lit(0).cast("bigint").alias("lost"), F.lit(0).cast("bigint").alias("to")),
        lambda acc, x: F.struct(
            (acc["lost"] + F.greatest(F.lit(0), x["end_word"] - F.greatest(acc["to"], x["start_word"]))).alias("lost"),
            F.greatest(acc["to"], x["end_word"]).alias("to")),
        lambda acc: acc["lost"])
    return spans.groupBy("doc_id").agg(
        ordered.alias("s"), F.count(F.lit(1)).alias("n_spans"),
        F.sort_array(F.collect_set("keep_id")).alias("keep_ids")).select(
        "doc_id", step.alias("lost"), "n_spans", "keep_ids")


def without_repeats(docs: DataFrame, paragraph: int = PARAGRAPH, shingle: int = SHINGLE,
                    key: int = KEY) -> DataFrame:
    """``docs`` without repeated passages: same columns, n_chars set anew.

    Rows of which nothing is left go; rows that lose nothing stay as they are, those without
    doc_id or text among them.
    """
    spans, classes = repeated_spans(only(docs, doc_id="bigint", text="string"), paragraph, shingle, key)
    id_, gone_, cuts_ = fresh(docs, "id", "gone", "cuts")
    cuts = spans.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("start_word", "end_word"))).alias("cuts"))
    cuts = cuts.groupBy(F.col("doc_id").alias(id_)).agg(F.collect_list(F.struct("text_hash", "cuts")).alias(cuts_))
    copies = classes.where((F.col("doc_id") != F.col("first_id")) & (F.col("n_words") >= shingle)) \
        .select(F.col("doc_id").alias(id_), F.lit(True).alias(gone_)).distinct()
    # One table of what happens to a document, so that texts are shuffled once.
    marks = cuts.join(copies, id_, "full_outer")
    joined = docs.join(marks, docs["doc_id"] == marks[id_], "left").where(F.col(gone_).isNull())
    own = F.filter(F.col(cuts_), lambda c: c["text_hash"] == F.xxhash64(docs["text"]))
    joined = joined.withColumn(cuts_, F.when(F.size(own) > 0, own[0]["cuts"]))

    @F.pandas_udf("string")
    def remaining(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for t, a, b in zip(text, starts, ends):
            at = [m.start() for m in _WORD.finditer(t)] + [len(t)]
            parts, last = [], 0
            for s, e in zip(a, b):
                parts.append(t[last:max(last, at[s])])
                last = max(last, at[e])
            out.append("".join([*parts, t[last:]]).rstrip(_SPACE))
        return pd.Series(out, dtype=object)

    has = F.col(cuts_).isNotNull()
    left = joined.where(has).withColumn("text", remaining(
        F.col("text"), F.transform(cuts_, lambda c: c["start_word"]), F.transform(cuts_, lambda c: c["end_word"])))
    left = left.where("text <> ''")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.where(~has).select(docs.columns).unionByName(left.select(docs.columns))


def paragraph_recall(docs: DataFrame, spans: DataFrame, every: int = 100, num: int = NUM, den: int = DEN,
                     shingle: int = SHINGLE) -> float:
    """Share of the paragraphs of documents whose id is divisible by ``every`` that ``spans`` covers, of those that
    are similar to a paragraph of an earlier document.  Counted over all shingles, without bands."""

    def shingles(rows: Rows) -> Rows:
        for doc_id, text in rows:
            s = runs(word_hashes(words(text)), shingle)
            for a, b in paragraphs(text, shingle):
                own = np.unique(s[a:b - shingle + 1]).view(np.int64)
                yield from ((doc_id, a, b, len(own), x) for x in own.tolist())

    all_ = cut(map_rows(only(docs, doc_id="bigint", text="string").where("doc_id is not null"), shingles,
                        doc_id="bigint", a="bigint", b="bigint", n="bigint", x="bigint"))
    other = all_.select(F.col("doc_id").alias("keep_id"), F.col("a").alias("c"), F.col("n").alias("m"), "x")
    pairs = (all_.where(F.col("doc_id") % every == 0).join(other, "x").where("keep_id < doc_id")
             .groupBy("doc_id", "a", "b", "n", "keep_id", "c", "m").count())
    true = pairs.where(F.col("count") * (den + num) >= num * (F.col("n") + F.col("m"))).select("doc_id", "a", "b").distinct()
    covered = true.join(spans.select("doc_id", "start_word", "end_word").distinct(), "doc_id").where(
        "start_word <= a and b <= end_word").select("doc_id", "a", "b").distinct()
    total = true.count()
    return covered.count() / total if total else float("nan")
