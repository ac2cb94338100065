"""The registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .bpe_automaton import round_trip_digests
from .cover_tree import top_k
from .dac_tokens import dac_round_trip
from .fingerprint import fingerprint_report
from .html_density import extract
from .langid import identify
from .mixing import mix
from .quality import score_quality
from .superminhash import near_duplicates
from .warc_merkle import ORACLE as WARC_ORACLE
from .warc_merkle import fixity_report

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprint(spark, sf_dir):
    return fingerprint_report(table(spark, sf_dir, "documents"))


def op2_dac_tokens(spark, sf_dir):
    return dac_round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_bpe_automaton(spark, sf_dir):
    return round_trip_digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_warc_merkle(spark, sf_dir):
    return fixity_report(table(spark, sf_dir, "pages"))


def op5_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


def op6_cover_tree(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op7_superminhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_eb(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_langid(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


def op10_html_density(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


#: Inner products of all pairs of a query and another row, ranked.
TOP_K_ORACLE = """
WITH long AS (
  SELECT vec_id, generate_subscripts(embedding, 1) AS i, floor(64 * CAST(unnest(embedding) AS DOUBLE)) AS x FROM embeddings),
scores AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(sum(q.x * d.x) AS BIGINT) AS score
  FROM long q JOIN long d ON q.i = d.i WHERE q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scores
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 20
"""

#: Pairs that share a shingle, linked by exact Jaccard; the least label that links reach.
NEAR_ORACLE = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT links.v, reach.c FROM reach JOIN links ON links.u = reach.doc_id)
SELECT d.doc_id, CAST(coalesce(any_value(sizes.n), 0) AS BIGINT) AS n_shingles, min(reach.c) AS component_id, d.doc_id = min(reach.c) AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id JOIN reach ON reach.doc_id = d.doc_id GROUP BY d.doc_id
"""


def oracle_sql():
    return {"op4_warc_merkle": WARC_ORACLE, "op6_cover_tree": TOP_K_ORACLE, "op7_superminhash": NEAR_ORACLE}
