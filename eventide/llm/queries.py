"""Registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm import (bpe, exact_dedup, html_extract, merkle, ngram_join, packing, spelling, substring_dedup, suffix_tree,
                          toxicity, url_graph, vector_graph, vector_search)
from eventide.llm.columns import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op1_html_extract")
def op1_html_extract(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op2_exact_dedup", """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents
), g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (body)""")
def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op3_ngram_join", """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ')
    ELSE array_to_string(w[i:i+3], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT x, y FROM (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g)
    WHERE a.doc_id <> b.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), r AS (
  SELECT doc_id AS x, doc_id AS c FROM documents
  UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, coalesce(k.k, 0)::BIGINT AS n_links
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(c) AS c FROM r GROUP BY x) m ON m.x = d.doc_id
LEFT JOIN (SELECT x, count(*) AS k FROM l GROUP BY x) k ON k.x = d.doc_id""")
def op3_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


@query("op4_suffix_tree")
def op4_suffix_tree(spark, sf_dir):
    return suffix_tree.score(table(spark, sf_dir, "documents"))


@query("op5_substring_dedup")
def op5_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op7_byte_bpe")
def op7_byte_bpe(spark, sf_dir):
    return bpe.encode_decode(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN, with_ids=False)


@query("op8_packing")
def op8_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


RULES = (
    url_graph.Rule("allow", "org", "/"),
    url_graph.Rule("block", "example.org", "/es/"),
    url_graph.Rule("block", "example.org", "/en/1"),
    url_graph.Rule("allow", "com", "/fr/"),
    url_graph.Rule("block", "com", "/de/"),
)


@query("op9_url_graph")
def op9_url_graph(spark, sf_dir):
    return url_graph.judge(table(spark, sf_dir, "pages"), RULES)


@query("op10_vector_graph", """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(e, lambda x: x * x)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id AS x, vec_id AS c FROM embeddings UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x
)
SELECT v.vec_id, coalesce(k.k, 0)::BIGINT AS n_links, m.c AS component_id, v.vec_id = m.c AS kept
FROM v JOIN (SELECT x, min(c) AS c FROM r GROUP BY x) m ON m.x = v.vec_id
LEFT JOIN (SELECT x, count(*) AS k FROM l GROUP BY x) k ON k.x = v.vec_id""")
def op10_vector_graph(spark, sf_dir):
    return vector_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: crc32 of a text in DuckDB, which has no such function: eight shifts a byte.
_CRC32 = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(encode({0}))),
    lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))))"""


@query("op11_spelling_variants", f"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS w FROM documents
), g AS (
  SELECT w, count(*) AS k, {_CRC32.format("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM r
  WHERE length(w) >= 7 GROUP BY doc_id, w
), c AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM g
), v AS (
  SELECT word, sum(k)::BIGINT AS n FROM c WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), p AS (SELECT word, n, unnest(range(length(word))) AS i FROM v
), d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS x FROM p
), e AS (
  SELECT a.word AS word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.x = b.x AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.x = v.word
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.x = v.word
), b AS (
  SELECT word, count(*) AS n_near, max(near_n) AS form_n, arg_min(near, (-near_n, near)) AS form FROM e GROUP BY word
), f AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 10 * v.n THEN b.form END AS form,
         CASE WHEN b.form_n >= 10 * v.n THEN b.form_n END AS form_n FROM v LEFT JOIN b USING (word)
), t AS (
  SELECT word, word AS root FROM f
  UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n
FROM f JOIN t USING (word) JOIN f z ON z.word = t.root WHERE z.form IS NULL""")
def op11_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op12_merkle_manifest", f"""
WITH RECURSIVE h AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf,
         CASE WHEN {_CRC32.format("coalesce(doc_id::VARCHAR, '')")} % 5 = 0
           THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
           ELSE {_leaf('text')} END AS seen
  FROM documents
), o AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS t FROM (SELECT DISTINCT source FROM h)
), l AS (
  SELECT doc_id, t, leaf, seen, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf, seen) - 1 AS place,
         count(*) OVER (PARTITION BY t) AS n
  FROM h JOIN o ON h.source IS NOT DISTINCT FROM o.source
), b AS (
  SELECT t, 0 AS lvl, place AS i, leaf AS x, n FROM l
  UNION ALL
  SELECT t, lvl + 1, i // 16, sha256(string_agg(x, '' ORDER BY i)), (n + 15) // 16 FROM b WHERE n > 1
  GROUP BY t, lvl, i // 16, n
), r AS (SELECT t, x FROM b WHERE n = 1
), u AS (
  SELECT -1 AS t, 0 AS lvl, t AS i, x, (SELECT count(*) FROM o) AS n FROM r
  UNION ALL
  SELECT t, lvl + 1, i // 16, sha256(string_agg(x, '' ORDER BY i)), (n + 15) // 16 FROM u WHERE n > 1
  GROUP BY t, lvl, i // 16, n
), a AS (
  SELECT t, lvl, i, CASE WHEN t >= 0 AND n <= 16 THEN -1 ELSE t END AS nt, CASE WHEN t >= 0 AND n <= 16 THEN 0 ELSE lvl + 1 END AS nl,
         CASE WHEN t >= 0 AND n <= 16 THEN t ELSE i // 16 END AS ni,
         coalesce(string_agg(x, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
         coalesce(string_agg(x, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM (SELECT * FROM b UNION ALL SELECT * FROM u) WHERE n > 1
  WINDOW w AS (PARTITION BY t, lvl, i // 16 ORDER BY i)
), f AS (
  SELECT doc_id, t AS s, place, leaf, seen AS x, '' AS proof, CASE WHEN n > 1 THEN t ELSE -1 END AS t, 0 AS lvl,
         CASE WHEN n > 1 THEN place ELSE t END AS i FROM l
  UNION ALL
  SELECT doc_id, s, place, leaf, sha256(lft || x || rgt), proof || lft || rgt, nt, nl, ni FROM f JOIN a USING (t, lvl, i)
)
SELECT f.doc_id, f.leaf, r.x AS subroot, p.x AS root, sha256(f.proof) AS proof_sha256, f.x AS folded_root, f.x = p.x AS verified
FROM f JOIN r ON r.t = f.s JOIN u p ON p.n = 1 LEFT JOIN a ON a.t = f.t AND a.lvl = f.lvl AND a.i = f.i WHERE a.t IS NULL""")
def op12_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


@query("op13_vector_search", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v
  WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""")
def op13_vector_search(spark, sf_dir):
    return vector_search.nearest(table(spark, sf_dir, "embeddings"))
