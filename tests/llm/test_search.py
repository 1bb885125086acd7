"""Spelling variants, Merkle manifests and vector search against brute force, with odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import merkle, spelling, vector_search
from eventide.llm.fm_index import Vocabulary, symbols

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"
CLASHING = ["word", "n", "key", "tree", "part", "place", "size", "leaf", "root", "node", "v", "dim", "ids", "shard", "_draw"]


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def clashing(df):
    return df.withColumns({c: F.lit(c) for c in CLASHING if c not in df.columns})


def one_error(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def test_index_finds_all_words_at_one_error():
    rng = random.Random(3)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randrange(5, 9))) for _ in range(500)}
    words |= {"a" * 300, "a" * 301, "a" * 150 + "b" + "a" * 150}
    words = sorted(words)
    index, size = Vocabulary(words), np.array([len(w) for w in words])
    found = set()
    for longer in (-1, 0, 1):
        for backwards in (False, True):
            exact = size - size // 2 if backwards else size // 2
            q, hit = index.near([symbols(w) for w in words], exact, np.full(len(words), longer), backwards)
            found |= {(words[i], words[j]) for i, j in zip(q, hit)}
    assert found == {(a, b) for a in words for b in words if one_error(a, b)}


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= 2}
    near = {w: [x for x in n if one_error(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


def spelling_rows():
    rng = random.Random(8)
    base = ["chapter", "chapters", "Größere", "différence", "aaaaaaaa", "aaaaaaaaa", "abababab", "sentence"]
    base += ["stem" + "".join(rng.choice("xyz") for _ in range(4)) for _ in range(60)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = rng.choice(base[:8]) if rng.random() < 0.6 else rng.choice(base)
            if rng.random() < 0.1:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "q", w[at] + "q"]) + w[at + 1:]
            words.append(w)
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
    return rows + [(None, "chapter CHAPTER"), (500, None), (501, ""), (502, "x" * 4000 + " " + "x" * 4000), (3, "sentense " * 9)]


def test_variants_equal_brute_force(spark):
    rows = spelling_rows()
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    want = plain_variants(rows)
    for group in (150_000, 300):  # small groups split hot keys into tiles
        assert result(spelling.variants(docs, group=group)) == want


def test_forms_are_followed_to_their_root(spark):
    text = "letters " * 2000 + "lettters " * 150 + "letttters " * 12 + "lettttters lettttters"
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), ratio=2).collect()}
    assert got["letttters"]["form"] == "lettters" and got["lettttters"]["root"] == "letters" and got["letters"]["form"] is None


def test_no_words(spark):
    for rows in ([], [(1, None)], [(1, "short words only")]):
        assert spelling.variants(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == 0


def digest(data):
    return hashlib.sha256(data).hexdigest()


def plain_manifest(rows):
    def leaf(r, text):
        parts = [None if v is None else str(v).encode() for v in (*r[:4], text)]
        return digest(b"".join(b"-" if p is None else b"%d:%s" % (len(p), p) for p in parts))

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][i:i + 16]).encode()) for i in range(0, len(out[-1]), 16)])
        return out

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for s in sources}
    trees = {s: tree([leaf(r, r[4]) for r in own[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(own[s]):
            text = r[4]
            if text is not None and zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            node, siblings = leaf(r, text), ""
            for levels, at in ((trees[s], i), (top, k)):
                for level in levels[:-1]:
                    run, own_at = level[at - at % 16:at - at % 16 + 16], at % 16
                    siblings += "".join(run[:own_at] + run[own_at + 1:])
                    node = digest("".join(run[:own_at] + [node] + run[own_at + 1:]).encode())
                    at //= 16
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], digest(siblings.encode()), node, node == top[-1][0]))
    return sorted(out, key=repr)


def test_manifest_equals_plain_trees(spark):
    rows = [(i, "hot" if i % 3 else None, "en", 5, f"Ab é{i}") for i in range(1500)] + [(None, "hot", None, None, None)] * 3
    rows += [(i, f"s{i % 40}", "de", 1, "X" * (i % 7)) for i in range(2000, 2100)] + [(5000, "", "", 0, "")]
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(6))
    want = plain_manifest(rows)
    for deep in (1, 3):
        got = merkle.manifest(docs, deep)
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert result(got) == want
    assert 0 < sum(not r[-1] for r in want) < len(want)


@pytest.mark.parametrize("count", [1, 16, 17])
def test_small_manifests(spark, count):
    rows = [(1, "a", None, None, "T")] * count
    assert result(merkle.manifest(spark.createDataFrame(rows, DOCS))) == plain_manifest(rows)


def test_empty_manifest(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0


def plain_nearest(rows, every=50, k=5):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for i, q in usable:
        if i % every == 0:
            scores = {(c, tuple(v)): vector_search.cosines(q[None], v[None])[0] for c, v in usable if c != i and len(v) == len(q)}
            best = sorted(scores.items(), key=lambda s: (-s[1], s[0][0]))[:k]
            out |= {(i, r + 1, c[0], s) for r, (c, s) in enumerate(best)}
    return sorted(out, key=repr)


def vectors(spark, rows, kind="float"):
    return clashing(spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int").repartition(4))


def test_search_with_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8)).astype(np.float32).tolist()
    rows = [(i, x, 1) for i, x in enumerate(v)] + [(1000 + i, v[50], None) for i in range(40)] + [(1000, v[50], 1)]
    rows += [(None, v[0], 1), (2000, None, 1), (2050, [0.0] * 8, 1), (2100, [float("nan")] + v[0][1:], 1), (2150, [None] + v[0][1:], 1),
             (2200, [], 1), (3000, [1.0, 2.0], 1), (3001, [2.0, 4.0], 1), (3050, [1.0, 2.0, 3.0], 1), (4000, [float(np.float32(3e38))] * 8, 1)]
    got = result(vector_search.nearest(vectors(spark, rows)))
    assert got == plain_nearest([r[:2] for r in rows])
    assert [r[2] for r in got if r[0] == 50] == [1000, 1001, 1002, 1003, 1004]
    assert [r[2:] for r in got if r[0] == 3000] == [(3001, 1.0)] and not [r for r in got if r[0] == 3050]


def test_search_over_many_shards_reaches_its_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 32))
    v = centres[rng.integers(12, size=4000)] + rng.normal(size=(4000, 32))
    df = vectors(spark, [(i, x.tolist(), 0) for i, x in enumerate(v)], "double")
    got = vector_search.nearest(df, numbers=1 << 15).cache()
    assert got.count() == 80 * 5
    assert vector_search.recall(df, got) >= 0.95


def test_every_node_is_reached():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 16)) * 0.01 + 3 * rng.normal(size=16) for _ in range(8)])
    x = vector_search.unit(x).astype(np.float32)
    g = vector_search.Graph(x, degree=8, beam=16)
    reached, edge = {g.entry}, [g.entry]
    while edge:
        edge = [j for i in edge for j in g.near[i] if j >= 0 and j not in reached and not reached.add(j)]
    assert len(reached) == len(x)


def test_search_without_vectors(spark):
    assert vector_search.nearest(vectors(spark, [])).count() == 0
    assert vector_search.nearest(vectors(spark, [(50, [1.0], 1)])).count() == 0
