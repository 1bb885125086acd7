"""Spelling variants: words of the corpus that differ by one code point, and the usual form of each.

1. Words of all texts are counted, per task first.
2. Of two words at one error, the first or the last half of either is untouched by it.  So a
   word is indexed under its length and as much of its beginning (and, apart from that, of its
   end) as words that may ask for it surely share, and asks under its own length and the two
   next to it.  Keys are gathered in groups of about ``GROUP`` code points; a key that alone
   holds more is compared in tiles of two bounded blocks.
3. A group builds a bidirectional FM-index of its words and matches one half of every query
   exactly, then extends the suffix-rank interval across the other half with one error.  What
   the last half finds counts only where the first half doesn't find it.
4. A task returns a count and the best word per query, never pairs.  Forms are followed to
   their last by pointer doubling; a form is ten times as frequent, so there are few rounds.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.core.lineage import cut
from eventide.llm.columns import Rows, map_rows, only
from eventide.llm.fm_index import Vocabulary, symbols

LEAST, TWICE, RATIO, MARK = 7, 2, 10, 31
GROUP = 150_000
#: Distinct words, and bytes of text read, after which a task hands its counts on.
HELD_WORDS, HELD_BYTES = 300_000, 1 << 26
#: Maximal runs of A-Za-z and U+00C0 to U+00FF in UTF-8, after A-Z are lower-cased.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def found_words(doc_id: int | None, text: str | None, least: int = LEAST) -> list[bytes]:
    """The words of a text with at least ``least`` code points, marked runs without one code point."""
    start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    out = []
    for run in _RUN.findall((text or "").encode("utf-8", "surrogatepass").lower()):
        if len(run) < least:
            continue
        h = zlib.crc32(run, start)
        if h % MARK == 0:
            points = run.decode()
            at = h % len(points)
            run = (points[:at] + points[at + 1:]).encode()
        if len(run) - run.count(b"\xc3") >= least:
            out.append(run)
    return out


def vocabulary(documents: DataFrame, least: int = LEAST, twice: int = TWICE) -> DataFrame:
    """word and n of the words that occur at least ``twice`` times."""

    def count(rows: Rows) -> Rows:
        counts, read = Counter(), 0
        for doc_id, text in rows:
            counts.update(found_words(doc_id, text, least))
            read += len(text or "")
            if len(counts) >= HELD_WORDS or read >= HELD_BYTES:
                yield from ((w.decode(), n) for w, n in counts.items())
                counts, read = Counter(), 0
        yield from ((w.decode(), n) for w, n in counts.items())

    counted = map_rows(only(documents, doc_id="bigint", text="string"), count, word="string", n="bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= twice)


def placed(words: DataFrame, group: int = GROUP) -> DataFrame:
    """word, n, length (of the words sought), side, and where the row goes: bucket, i, j, role.

    role is 1 for a word to be indexed, 2 for a query, 3 for both.
    """
    size = F.char_length("word")
    total = words.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-2 * total // group))
    # How much of a side a word of some length shares with all that may ask for it.
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), l.alias("length")) for s in (0, 1)
                                for l in (size - 1, size, size + 1)]))
    asked = words.select("word", "n", sides.alias("s")).select("word", "n", "s.side", "s.length").withColumn(
        "part", F.when(F.col("side") == 0, F.expr("left(word, int((length - 1) / 2))")).otherwise(F.expr("right(word, int(length / 2))")))
    own = F.col("length") == size
    asked = asked.withColumn("key", F.xxhash64("side", "length", "part")).drop("part")
    hot = cut(asked.where(own).groupBy("key").agg(F.sum("length").alias("held")).where(F.col("held") > group).select(
        "key", F.ceil(F.col("held") / group).cast("int").alias("blocks")))
    asked = asked.join(hot, "key", "left")
    mine = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)

    def go(i, j, role):
        return F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))

    zero = F.lit(0)
    whither = (F.when(F.col("blocks").isNull(), F.when(own, F.array(go(zero, zero, 3))).otherwise(F.array(go(zero, zero, 2))))
               .when(own, F.concat(F.transform(others, lambda x: go(mine, x, 1)), F.transform(others, lambda x: go(x, mine, 2))))
               .otherwise(F.transform(others, lambda x: go(x, mine, 2))))
    bucket = F.when(F.col("blocks").isNull(), F.pmod("key", F.lit(buckets))).otherwise(F.col("key"))
    return asked.select("word", "n", "length", "side", bucket.alias("bucket"), F.col("blocks").isNotNull().alias("split"),
                        F.explode(whither).alias("w")).select("word", "n", "length", "side", "bucket", "split", "w.*")


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
BATCH = 4096


def _searched(rows: pa.Table) -> pa.Table:
    word, n, role = rows.column("word").to_pylist(), rows.column("n").to_numpy(), rows.column("role").to_numpy()
    held = sorted((word[i], n[i]) for i in np.flatnonzero(role & 1))
    asks = np.flatnonzero(role & 2)
    if not held or not len(asks):
        return _NEAR.empty_table()
    backwards = bool(rows.column("side")[0].as_py())
    index = Vocabulary([w for w, _ in held])
    counts = np.array([c for _, c in held])
    sought = rows.column("length").to_numpy()
    out = []
    for at in range(0, len(asks), BATCH):
        some = asks[at:at + BATCH]
        own = [word[i] for i in some]
        size = np.array([len(w) for w in own])
        first = size // 2
        q, hit = index.near([symbols(w) for w in own], size - first if backwards else first, sought[some] - size, backwards)
        if backwards:  # the first half of the query finds these as well
            new = np.fromiter((not held[x][0].startswith(own[i][:len(own[i]) // 2]) for i, x in zip(q, hit)), bool, len(q))
            q, hit = q[new], hit[new]
        order = np.lexsort((hit, -counts[hit], q))
        q, hit = q[order], hit[order]
        which, start, near = np.unique(q, return_index=True, return_counts=True)
        out += [(own[i], int(k), int(counts[hit[s]]), held[hit[s]][0]) for i, s, k in zip(which, start, near)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * 4, _NEAR)], schema=_NEAR)


def neighbours(words: DataFrame, group: int = GROUP) -> DataFrame:
    """word, n_near, best_n and best of the words that have a near word."""
    found = placed(words, group).groupBy("side", "split", "bucket", "i", "j").applyInArrow(
        _searched, "word string, n_near bigint, best_n bigint, best string")
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")).select(
        "word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def roots(links: DataFrame) -> DataFrame:
    """word and root: where the links word -> form end, in rounds that double the step."""
    state = cut(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not state.where("moved").isEmpty():
        on = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = cut(state.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return state.select("word", "root")


def variants(documents: DataFrame, least: int = LEAST, twice: int = TWICE, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the corpus.

    ``documents`` has doc_id and text; other columns are ignored.  A missing or empty text
    has no words, a missing id counts as the empty text; rows that repeat count each.  Of near
    words of equal n the first in code-point order is the form.  Words of any length are
    compared whole.  No rows give none.  ``group`` changes the work, never the result.
    """
    words = cut(vocabulary(documents, least, twice))
    formed = cut(words.join(neighbours(words, group), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(F.col("best_n") >= ratio * F.col("n"), F.struct("best", "best_n")).alias("f"),
    ).select("word", "n", "n_near", F.col("f.best").alias("form"), F.col("f.best_n").alias("form_n")))
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
