"""Registered queries of imports, lineage, torn logs and event waves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.catalog import sqltext as S
from tidegraph.catalog.graph import EVERY
from tidegraph.catalog.pipeline import TREE_SQL, p2_descendants
from tidegraph.functions.hashing import content_id
from tidegraph.operators import imports, paths
from tidegraph.sources.graph import durable_edges
from tidegraph.sources.tables import table


def import_plan(spark: SparkSession, d: str) -> DataFrame:
    """Durable edges in batches of 1,000 by id: first, last and number of each."""
    rows = imports.plan_batches(durable_edges(spark, d), ["logical_id"], 1000)
    return rows.groupBy("batch").agg(F.min("logical_id").alias("first_id"), F.max("logical_id").alias("last_id"), F.count(F.lit(1)).alias("n_rows"))


def transaction_digests(spark: SparkSession, d: str) -> DataFrame:
    """Whether sending a transaction's frames again gives the digest it had: transactions by number of frames, and their distinct digests."""
    rows = table(spark, d, "wal_frame").filter("lsn IS NOT NULL AND transaction_id IS NOT NULL").select(F.lower("transaction_id").alias("txn"), "lsn", F.upper("frame_type").alias("kind")).distinct()
    got = imports.batch_digests(rows, ["txn"], "lsn", ["kind"])
    return got.groupBy("n_rows").agg(F.count(F.lit(1)).alias("n_transactions"), F.count_distinct("digest").alias("n_digests"))


def appended_events(spark: SparkSession, d: str) -> DataFrame:
    """Events with those of the last quarter appended twice over the first three: once each, by type."""
    rows = table(spark, d, "events").select("event_id", "event_type", "user_id")
    log = rows.filter("event_id % 4 < 3")
    return imports.append_once(log, rows.unionByName(rows), "event_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"))


def documents_not_revoked(spark: SparkSession, d: str) -> DataFrame:
    """Documents per language whose source isn't one that sent an empty page."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    revoked = table(spark, d, "documents").filter("text = '' AND source IS NOT NULL").select("source")
    return imports.not_revoked(docs, revoked, ["source"]).groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"))


def spaces_put(spark: SparkSession, d: str) -> DataFrame:
    """Vector spaces, one per label, put again with an odd label's size changed: outcomes."""
    rows = table(spark, d, "embeddings").select("label", F.size("embedding").alias("dimension")).distinct()
    had = rows.filter("label < 7").select(content_id(F.col("label")).alias("space_id"), "label", "dimension")
    new = rows.select(content_id(F.col("label")).alias("space_id"), "label", F.when(F.col("label") % 2 == 1, F.lit(1)).otherwise(F.col("dimension")).alias("dimension"))
    return imports.put_spaces(had, new, ["label", "dimension"]).select("label", "outcome")


def torn_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of the log of which no copy is whole."""
    return imports.torn_frames(table(spark, d, "wal_frame"))


def event_waves(spark: SparkSession, d: str) -> DataFrame:
    """What waves from every hundredth event reach."""
    archive = paths.event_archive(table(spark, d, "events").select("event_id"))
    return imports.event_waves(archive, archive.filter(F.col("event_id") % EVERY == 0), 2, 0.1, 16, (4, 5, 7))


def provenance_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Number of ancestors of each event that has any, and the most links to one by shortest paths."""
    rows = p2_descendants(spark, d)
    return rows.groupBy(F.col("descendant").alias("provenance_id")).agg(F.count(F.lit(1)).alias("n_ancestors"), F.max("distance").alias("farthest"))


_FUNCTIONS = (import_plan, transaction_digests, appended_events, documents_not_revoked, spaces_put, torn_frames, event_waves, provenance_lineage)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

SQL = {
    "import_plan": f"WITH {S.durable_edges()} SELECT b AS batch, min(logical_id) AS first_id, max(logical_id) AS last_id, count(*) AS n_rows FROM (SELECT logical_id, (row_number() OVER (ORDER BY logical_id) - 1) // 1000 AS b FROM e) GROUP BY 1",
    "transaction_digests": "SELECT n AS n_rows, count(*) AS n_transactions, count(*) AS n_digests FROM (SELECT lower(transaction_id) AS t, count(DISTINCT (lsn, upper(frame_type))) AS n FROM wal_frame WHERE lsn IS NOT NULL AND transaction_id IS NOT NULL GROUP BY 1) GROUP BY 1",
    "appended_events": "SELECT event_type, count(*) AS n_events FROM events GROUP BY 1",
    "documents_not_revoked": "SELECT lang, count(*) AS n_docs FROM documents WHERE source IS NULL OR source NOT IN (SELECT source FROM documents WHERE text = '' AND source IS NOT NULL) GROUP BY 1",
    "spaces_put": "SELECT DISTINCT label, CASE WHEN label >= 7 THEN 'NEW' WHEN label % 2 = 1 THEN 'CONFLICT' ELSE 'EXISTS' END AS outcome FROM embeddings",
    "torn_frames": """WITH f AS (SELECT lsn, bool_or(payload IS NULL OR coalesce(json_valid(try(decode(payload))), false)) AS ok FROM wal_frame WHERE lsn IS NOT NULL GROUP BY 1)
SELECT lsn, CASE WHEN lsn > (SELECT coalesce(max(lsn), -1) FROM f WHERE ok) THEN 'TAIL' ELSE 'CORRUPT' END AS standing FROM f WHERE NOT ok""",
    "event_waves": f"""SELECT event_id, 1000000000 + event_id AS node_id, CAST(1.0 AS DOUBLE) AS energy, 'EMPTY_PATH' AS relation FROM events WHERE event_id % {EVERY} = 0
UNION ALL SELECT event_id, 2000000000 + event_id % 4096, round(CAST(0.75 AS DOUBLE) * 0.75, 12), 'PROJECT_CONTEXT' FROM events WHERE event_id % {EVERY} = 0
UNION ALL SELECT event_id, 3000000000 + event_id % 8192, round(CAST(0.9 AS DOUBLE) * 0.9, 12), 'CODE_PATTERN' FROM events WHERE event_id % {EVERY} = 0""",
    "provenance_lineage": TREE_SQL
    + """dn(a, b, k) AS (SELECT parent, node, 1 FROM g UNION SELECT d.a, g.node, d.k + 1 FROM dn d JOIN g ON d.b = g.parent)
SELECT b AS provenance_id, count(*) AS n_ancestors, CAST(max(k) AS BIGINT) AS farthest FROM (SELECT a, b, min(k) AS k FROM dn GROUP BY 1, 2) GROUP BY 1""",
}
