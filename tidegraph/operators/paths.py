"""Relations of paths and the crystallization of repeated ones."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.config import BLOCKER, EDGE_TYPES
from tidegraph.functions.relation import derive, masked
from tidegraph.operators.wave import ranked


def relations(paths: DataFrame, column: str = "edge_types", allowed: Iterable[str] | None = None) -> DataFrame:
    """Paths with relation, blocked, unknown_count and step_count (which replace columns of those names); types outside
    ``allowed`` are masked first. An empty path has the empty relation; a null path has nulls."""
    paths = paths.drop("relation", "blocked", "unknown_count", "step_count")
    path = F.col(column) if allowed is None else masked(F.col(column), allowed)
    return paths.withColumn("__d", F.when(F.col(column).isNotNull(), derive(path))).select(*paths.columns, "__d.*")


def crystal_id(signature: Column, prefix: str = "CRYSTAL") -> Column:
    digest = F.sha2(F.concat(F.lit(prefix), F.lit("|"), F.array_join(signature, "|")), 256)
    return F.concat(F.lit(prefix + "_"), F.upper(F.substring(digest, 1, 24)))


def observed(observations: DataFrame) -> DataFrame:
    """Observations with ``kind``: BLOCKED if they are marked so, hold a blocking type or are empty, else USABLE."""
    shut = F.coalesce(F.col("blocked"), F.lit(False)) | F.array_contains("edge_types", EDGE_TYPES[BLOCKER]) | (F.size("edge_types") <= 0) | F.col("edge_types").isNull()
    return observations.withColumn("kind", F.when(shut, "BLOCKED").otherwise("USABLE"))


def crystallize(observations: DataFrame, min_support: int = 3, min_weight: float = 0.0, max_crystals: int | None = None, links: int = 16, prefix: str = "CRYSTAL") -> DataFrame:
    """Signatures (edge_types) that enough usable observations share: crystal_id, signature, support_count,
    weighted_support (9 places), provenance_path_ids and provenance_record_ids (the first ``links`` of each by ``seq``).

    Of equal support and weight the smaller signature comes first where ``max_crystals`` cuts. The first links come from
    windows that keep ``links`` rows per map task and signature before the shuffle; no array outgrows ``links``.
    """
    use = observed(observations).filter("kind = 'USABLE'")
    agg = use.groupBy("edge_types").agg(F.count(F.lit(1)).alias("support_count"), F.round(F.sum("weight"), 9).alias("weighted_support"))
    agg = agg.filter((F.col("support_count") >= min_support) & (F.col("weighted_support") >= min_weight))
    if max_crystals is not None:
        agg = ranked(agg, [F.col("support_count").desc(), F.col("weighted_support").desc(), F.col("edge_types")], max_crystals).drop("rank")
    kept = use.join(agg.select("edge_types"), "edge_types", "left_semi")
    first = Window.partitionBy("edge_types").orderBy("seq", "path_id")
    some = kept.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= links)
    # Record ids are flattened over observations in order; ``links`` observations with one id each, or fewer, suffice
    # unless observations lack record ids, so those that have some are numbered on their own.
    with_ids = kept.filter(F.size("record_ids") > 0).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= links)
    paths = some.groupBy("edge_types").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "path_id"))), lambda x: x["path_id"]).alias("provenance_path_ids"))
    ids = with_ids.groupBy("edge_types").agg(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "record_ids"))), lambda x: x["record_ids"])), 1, links).alias("provenance_record_ids"))
    out = agg.join(paths, "edge_types").join(ids, "edge_types", "left")
    none = F.array().cast("array<string>")
    return out.select(
        crystal_id(F.col("edge_types"), prefix).alias("crystal_id"), F.col("edge_types").alias("signature"), "support_count", "weighted_support",
        "provenance_path_ids", F.coalesce("provenance_record_ids", none).alias("provenance_record_ids"), F.lit("ACTIVE").alias("status"),
    )


def crystal_counters(observations: DataFrame, min_support: int = 3, min_weight: float = 0.0) -> DataFrame:
    """One row: inputs, those skipped as blocked, and those of signatures with too little support."""
    rows = observed(observations)
    per = rows.filter("kind = 'USABLE'").groupBy("edge_types").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 9).alias("w"))
    low = per.agg(F.coalesce(F.sum(F.when((F.col("n") < min_support) | (F.col("w") < min_weight), F.col("n"))), F.lit(0)).alias("skipped_low_support"))
    return rows.agg(F.count(F.lit(1)).alias("n_input"), F.count(F.when(F.col("kind") == "BLOCKED", 1)).alias("skipped_blocked")).join(F.broadcast(low), how="full", on=F.lit(True))


def revoke(crystals: DataFrame, revocations: DataFrame) -> DataFrame:
    """Crystals with status REVOKED where ``revocations`` (crystal_id, reason, evidence_ids) has one with a reason and evidence."""
    good = revocations.filter((F.length("reason") > 0) & (F.size("evidence_ids") > 0)).groupBy("crystal_id").agg(F.min("reason").alias("revocation_reason"))
    out = crystals.join(good, "crystal_id", "left")
    return out.withColumn("status", F.when(F.col("revocation_reason").isNotNull(), "REVOKED").otherwise(F.col("status")))


def hot_edges(archive: DataFrame) -> DataFrame:
    """Three edges for each archived event, with weights in thousandths."""
    e = lambda a, b, t, w: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(t).alias("edge_type"), F.lit(w).alias("weight_milli"))
    # Types and weights of the edges of an event.
    three = F.array(e("seed_node", "project_node", 4, 750), e("seed_node", "code_node", 5, 900), e("rule_node", "code_node", 7, 700))
    return archive.select("event_id", F.explode(three).alias("e")).select("event_id", "e.*")


def motifs(archive: DataFrame, min_support: int = 3, revoked: DataFrame | None = None) -> DataFrame:
    """Motifs (residues of project, code and rule mod 64) with support and first event, without revoked ones (motif)."""
    residue = lambda c: (F.col(c) % 64).cast("string")
    rows = archive.select("event_id", F.concat_ws(":", residue("project_node"), residue("code_node"), residue("rule_node")).alias("motif"))
    out = rows.groupBy("motif").agg(F.count(F.lit(1)).alias("support"), F.min("event_id").alias("first_event")).filter(F.col("support") >= min_support)
    return out if revoked is None else out.join(revoked.select("motif"), "motif", "left_anti")


def event_archive(events: DataFrame) -> DataFrame:
    """Archive rows for event ids: nodes by residues, payloads of eight bytes one after the other."""
    i = F.col("event_id")
    # Bases and moduli of the synthetic archive.
    return events.select(
        "event_id", (i + 1_000_000_000).alias("seed_node"), (i % 4096 + 2_000_000_000).alias("project_node"), (i % 8192 + 3_000_000_000).alias("code_node"),
        (i % 2048 + 4_000_000_000).alias("rule_node"), (i * 8).alias("payload_offset"), F.lit(8).cast("long").alias("payload_len"), F.lit(0).alias("flags"),
    )


def events_of_nodes(archive: DataFrame) -> DataFrame:
    """(node_id, event_id): the inverted index of an archive, a row an event and node, so that hubs stay spread."""
    nodes = F.array_distinct(F.array("seed_node", "project_node", "code_node", "rule_node"))
    return archive.select(F.explode(nodes).alias("node_id"), "event_id")
