"""Write batches, duplicates and conflicts, snapshots, and the inventory of derived artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.hashing import state_digest
from tidegraph.operators.wave import ranked


RECORD_CONTENT = ("record_id", "node_id", "payload")
EDGE_CONTENT = ("src", "dst", "edge_type", "weight", "weight_million")


def batch_status(batch: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """Per key of a batch: DUPLICATE if all its rows are equal and more than one, CONFLICT if they differ, else SINGLE."""
    digest = F.xxhash64(*content)
    per = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ops"), F.min(digest).alias("a"), F.max(digest).alias("b"))
    status = F.when(F.col("a") != F.col("b"), "CONFLICT").when(F.col("n_ops") > 1, "DUPLICATE").otherwise("SINGLE")
    return per.select(*keys, "n_ops", status.alias("status"))


def changes_only(batch: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of the batch that the current state doesn't already hold as they are."""
    same = F.lit(True)
    for c in batch.columns:
        same = same & batch[c].eqNullSafe(current[c])
    return batch.join(current, same, "left_anti")


def new_transactions(batch: DataFrame, log: DataFrame, txn: str = "txn") -> DataFrame:
    """Rows of transactions that the log doesn't hold yet."""
    return batch.join(log.select(txn).distinct(), txn, "left_anti")


def records_of_nodes(records: DataFrame) -> DataFrame:
    """(node_id, n_records, first_record, last_record): the inverted index, summed up so that nodes with very many records stay small."""
    return records.filter("node_id IS NOT NULL").groupBy("node_id").agg(F.count_distinct("record_id").alias("n_records"), F.min("record_id").alias("first_record"), F.max("record_id").alias("last_record"))


def listing(records: DataFrame) -> DataFrame:
    """Records without payload, by id, with their place in the listing."""
    rows = records.select("record_id", "node_id", F.coalesce(F.octet_length("payload"), F.lit(0)).alias("payload_bytes"))
    return ranked(rows, [F.col("record_id"), F.col("node_id")], None)


def snapshot(records: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a relation: name, n_rows and a digest of its content that doesn't depend on order.

    Every content column that is there counts: ids, nodes and payloads of records; ends, types and weights of edges.
    """
    a = state_digest(records, [c for c in RECORD_CONTENT if c in records.columns]).withColumn("relation", F.lit("records"))
    return a.unionByName(state_digest(edges, [c for c in EDGE_CONTENT if c in edges.columns]).withColumn("relation", F.lit("edges")))


def register(inventory: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Each artifact of ``artifacts`` (kind, artifact_id, source_hash) with its ``outcome`` against the inventory: REGISTERED
    if it is new or was invalidated, UNCHANGED if it stands there with the same source, CONFLICT if with another or if
    ``artifacts`` itself names it with two sources. Null kinds or ids name nothing and are left out."""
    per = artifacts.dropna(subset=["kind", "artifact_id"]).groupBy("kind", "artifact_id").agg(F.min("source_hash").alias("source_hash"), F.max("source_hash").alias("__other"))
    had = inventory.select("kind", "artifact_id", F.col("state").alias("__state"), F.col("source_hash").alias("__had"))
    new = F.col("__state").isNull() | (F.col("__state") == "INVALIDATED")
    outcome = F.when(~F.col("source_hash").eqNullSafe(F.col("__other")), "CONFLICT").when(new, "REGISTERED")
    outcome = outcome.when(F.col("__had").eqNullSafe(F.col("source_hash")), "UNCHANGED").otherwise("CONFLICT")
    return per.join(had, ["kind", "artifact_id"], "left").select("kind", "artifact_id", "source_hash", outcome.alias("outcome"))


def invalidate(inventory: DataFrame, gone: DataFrame) -> DataFrame:
    """The inventory with the artifacts that ``gone`` (kind, artifact_id) names set to INVALIDATED."""
    marks = gone.select("kind", "artifact_id").distinct().withColumn("__gone", F.lit(True))
    rows = inventory.join(marks, ["kind", "artifact_id"], "left")
    return rows.withColumn("state", F.when(F.col("__gone"), "INVALIDATED").otherwise(F.col("state"))).select(*inventory.columns)


def reopenable(inventory: DataFrame, snapshot_hash: str) -> DataFrame:
    """The artifacts that may be opened again as they are: complete, and made from this very snapshot."""
    return checked_inventory(inventory, snapshot_hash).filter("standing = 'COMPATIBLE'").drop("standing")


def checked_inventory(inventory: DataFrame, snapshot_hash: str) -> DataFrame:
    """Artifacts (kind, artifact_id, state, source_hash) with ``standing``: COMPATIBLE if complete and of this snapshot, STALE if
    complete and of another, else INVALIDATED."""
    fresh = F.col("source_hash") == snapshot_hash
    return inventory.withColumn("standing", F.when(F.col("state") != "COMPLETE", "INVALIDATED").when(fresh, "COMPATIBLE").otherwise("STALE"))


def backup_conflicts(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Files (path, digest) of a backup with ``action``: RESTORE, SAME or CONFLICT; UNSAFE if the path leaves its folder."""
    p = present.select("path", F.col("digest").alias("__d"))
    unsafe = F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)") | F.contains(F.col("path"), F.lit("\\")) | (F.col("path") == "")
    action = F.when(unsafe, "UNSAFE").when(F.col("__d").isNull(), "RESTORE").when(F.col("__d") == F.col("digest"), "SAME").otherwise("CONFLICT")
    return manifest.join(p, "path", "left").select("path", "digest", action.alias("action"))
