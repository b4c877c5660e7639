"""Registered queries p4, p6, p7 and p8 with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import leaks, spans, tokens, topn
from tidegraph.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The five best candidates of each receipt and seed."""
    got = topn.best_candidates(table(spark, d, "ranked_candidate"), table(spark, d, "wave_query_receipt"))
    return got.select("receipt_id", "seed_node", "node_id", "record_id")


def p4_positions(spark: SparkSession, d: str) -> DataFrame:
    """The same with score, rank and position."""
    return topn.best_candidates(table(spark, d, "ranked_candidate"), table(spark, d, "wave_query_receipt"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.encode(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text, encoded and decoded again."""
    return tokens.decode(tokens.encode(table(spark, d, "documents")))


def p6_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents and tokens per language."""
    ids = tokens.encode(table(spark, d, "documents")).select("doc_id", F.size("ids").alias("n"))
    lang = table(spark, d, "documents").select("doc_id", F.lower("lang").alias("lang"))
    return ids.join(lang, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages that hold 13 or more consecutive words of a benchmark item."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).select("item_id", "doc_id")


def p7_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item that leaked: in how many pages, and the longest passage in words."""
    got = leaks.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return got.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_pages"), F.max("n_words").alias("longest"), F.max("item_words").alias("item_words"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents whose texts share a span of 256 code points or more."""
    return spans.Shared(table(spark, d, "documents")).pairs()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document's text is found elsewhere in spans of 256 code points or more."""
    return spans.Shared(table(spark, d, "documents")).shares()


def p8_linked(spark: SparkSession, d: str) -> DataFrame:
    """Of each document the class of equal texts and the number of different texts it shares such spans with."""
    return spans.Shared(table(spark, d, "documents")).linked()


QUERIES = {f.__name__: f for f in (p4_found, p4_positions, p6_ids, p6_decoded, p6_token_counts, p7_found, p7_leaked_items, p8_found, p8_shares, p8_linked)}

_TOP = """WITH s AS (SELECT DISTINCT receipt_id, seed_node FROM (SELECT receipt_id, unnest(seed_nodes) AS seed_node FROM wave_query_receipt) WHERE seed_node IS NOT NULL AND receipt_id IS NOT NULL),
c AS (SELECT receipt_id, seed_node, node_id, record_id, energy_score + 0.0 AS energy_score, rank FROM ranked_candidate c
  WHERE energy_score IS NOT NULL AND NOT isnan(energy_score) AND EXISTS (SELECT 1 FROM s WHERE s.receipt_id = c.receipt_id AND s.seed_node = c.seed_node)
  QUALIFY row_number() OVER (PARTITION BY receipt_id, seed_node, node_id, record_id ORDER BY energy_score + 0.0 DESC, rank NULLS LAST) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY receipt_id, seed_node ORDER BY energy_score DESC, rank NULLS LAST, node_id NULLS LAST, record_id NULLS LAST) AS position FROM c)
"""

_GRAMS = """WITH g AS (SELECT doc_id, i, hash(substr(text, i, 256)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 254)) AS i FROM documents WHERE length(text) >= 256)),
"""

SQL = {
    "p8_found": _GRAMS
    + """s AS (SELECT DISTINCT doc_id, h FROM g) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p8_linked": _GRAMS
    + """k AS (SELECT doc_id, CASE WHEN length(text) >= 256 THEN min(doc_id) OVER (PARTITION BY text) ELSE doc_id END AS class_id FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT class_id, h FROM g JOIN k ON g.doc_id = k.doc_id),
l AS (SELECT a.class_id, count(DISTINCT b.class_id) AS n FROM s a JOIN s b ON a.h = b.h AND a.class_id <> b.class_id GROUP BY 1)
SELECT k.doc_id, k.class_id, coalesce(l.n, 0) AS n_links FROM k LEFT JOIN l ON k.class_id = l.class_id""",
    "p8_shares": _GRAMS
    + """k AS (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS p FROM g WHERE h IN (SELECT h FROM k)),
n AS (SELECT doc_id, sum(CASE WHEN i - p >= 256 THEN 256 ELSE i - p END) AS c FROM c GROUP BY 1)
SELECT d.doc_id, CAST(length(d.text) AS BIGINT) AS n_chars, CAST(coalesce(n.c, 0) AS BIGINT) AS shared_chars,
  CASE WHEN length(d.text) > 0 THEN round(coalesce(n.c, 0) / length(d.text), 9) ELSE 0.0 END AS shared_share
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id WHERE d.text IS NOT NULL""",
    "p4_found": _TOP + "SELECT receipt_id, seed_node, node_id, record_id FROM t WHERE position <= 5",
    "p4_positions": _TOP + "SELECT receipt_id, seed_node, node_id, record_id, energy_score, rank, position FROM t WHERE position <= 5",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
