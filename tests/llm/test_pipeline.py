"""The pipeline over a small fixture with planted cases, stage by stage."""

import importlib
import os
import random

import pytest

import corpus_pipeline
from eventide.llm.words import words

PATH = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    texts = [prose(rng, rng.randrange(80, 200)) for _ in range(360)]
    labels = []
    for i in range(0, 300):
        if i % 3 == 0:
            texts[i] += " vile horrid vile"
        labels.append((i, 1, int(i % 3 == 0)))
    texts[340] = texts[310].replace(" ", "\n \t", 2)
    near = texts[311].split(" ")
    near[40] = "other"
    texts[341] = " ".join(near)
    passage = prose(rng, 55)
    texts[312] += " " + passage
    texts[342] = prose(rng, 60) + " " + passage + " " + prose(rng, 60)
    texts[343] = "vile horrid " + texts[343]
    root = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), texts, passage


def test_stages(spark, folder):
    root, texts, passage = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, root).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left[name] = {r.doc_id: r for r in docs.collect()}
    toxic = {i for i in range(300) if i % 3 == 0} | {343}
    assert set(left["toxicity"]) == set(range(360)) - toxic
    assert set(left["toxicity"]) - set(left["exact_dedup"]) == {340}
    assert set(left["exact_dedup"]) - set(left["ngram_join"]) == {341}
    last = left["substring_dedup"]
    assert set(last) == set(left["ngram_join"])
    assert passage in last[312].text and not set(passage.split()) & set(words(last[342].text))
    assert all(last[i].text == texts[i] and last[i].n_chars == len(texts[i]) for i in last if i != 342)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, root).collect()
    assert {r.doc_id for r in packed} == set(last)
    whole = corpus_pipeline.run(spark, root).collect()
    assert sorted((r.doc_id, r.start) for r in whole if r.start == 0) == sorted((i, 0) for i in last)


def test_stages_take_odd_rows(spark, folder):
    root, texts, _ = folder
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, rep string, digest string, _id string"
    rows = [(1, None, None, None, None, "x", "y", "z"), (2, "", "en", "s", 0, None, None, None), (3, texts[301], None, "s", 1, "a", None, "b"),
            (3, texts[301], None, "s", 1, "a", None, "b"), (None, texts[302], "en", None, 1, None, None, None),
            (4, "w1 " * 20000, "en", "s", 60000, None, None, None), (5, texts[303], "en", "s", None, None, None, None)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, root).cache()
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "rep", "digest", "_id"], name
        left = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
        assert left == ([(False, 1), (False, 3), (False, 4), (False, 5), (True, 0)] if some else [])
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, root).collect()
        assert {r.doc_id for r in packed} == {i or None for _, i in left}


@pytest.mark.skipif(not os.path.isdir(PATH), reason="no test tables")
def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    from tools.check_sql import TABLES, canonical, plain

    q = importlib.import_module("eventide.llm.queries")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    for name, sql in q.SQL.items():
        df = q.QUERIES[name](spark, PATH)
        got = canonical(pd.DataFrame([tuple(plain(v) for v in r) for r in df.collect()], columns=df.columns, dtype=object))
        cur = con.execute(sql)
        want = canonical(pd.DataFrame(cur.fetchall(), columns=[c[0] for c in cur.description], dtype=object))
        assert got == want, name


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)}
