"""Bringing data in: import plans, append-once ledgers, vector spaces, torn logs, and waves that start at events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.hashing import state_digest
from tidegraph.functions.relation import type_names
from tidegraph.operators import wave
from tidegraph.operators.paths import hot_edges, relations


def plan_batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Rows with ``batch`` (from 0) of at most ``size`` rows each in the given order, for imports in bounded steps. Numbers come
    from a range sort, so no task sees all rows. Ties in the order fall as the sort leaves them; add an id to break them."""
    if size <= 0:
        raise ValueError("size must be positive")
    out = wave.ranked(rows, [F.col(c) for c in order], None)
    return out.withColumn("batch", F.floor((F.col("rank") - 1) / size)).drop("rank")


def batch_digests(rows: DataFrame, by: list[str], position: str, columns: list[str]) -> DataFrame:
    """(by, n_rows, digest): a digest of each batch that depends on the order of its rows (their ``position``), added up from the
    rows' own digests with map-side combine."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(position, *columns), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.lpad(F.hex((F.sum(row) % F.lit(1 << 60)).cast("long")), 15, "0").alias("digest"))


def same_content(a: DataFrame, b: DataFrame, columns: list[str]) -> bool:
    """Whether two sets of rows have the same content, by their digests."""
    return state_digest(a, columns).first() == state_digest(b, columns).first()


def append_once(log: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Log and those of the new events whose key it lacks, each once (of repeated new events, the least row). Null keys are
    never appended."""
    fields = [c for c in new.columns if c != key]
    first = new.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*fields)).alias("r")).select(key, "r.*")
    return log.unionByName(first.join(log.select(key), key, "left_anti"))


def not_revoked(rows: DataFrame, revoked: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't revoked."""
    return rows.join(revoked.select(*keys).distinct(), keys, "left_anti")


def put_spaces(spaces: DataFrame, new: DataFrame, describes: list[str]) -> DataFrame:
    """(space_id, describes, outcome) of new vector spaces: EXISTS if known with the same description, CONFLICT if with another,
    else NEW."""
    had = spaces.select("space_id", F.struct(*describes).alias("__had"))
    rows = new.join(had, "space_id", "left")
    outcome = F.when(F.col("__had").isNull(), "NEW").when(F.col("__had") == F.struct(*[F.col(c) for c in describes]), "EXISTS").otherwise("CONFLICT")
    return rows.select("space_id", *describes, outcome.alias("outcome"))


def torn_frames(wal: DataFrame) -> DataFrame:
    """(lsn, standing) of frames of which no copy is whole: TAIL if no whole frame follows (such an end may be cut off), else
    CORRUPT (such a log must not be read). A frame without payload is whole."""
    ok = F.col("payload").isNull() | F.try_parse_json(F.col("payload").cast("string")).isNotNull()
    per = wal.filter("lsn IS NOT NULL").groupBy("lsn").agg(F.max(ok).alias("ok"))
    last = per.filter("ok").agg(F.max("lsn")).scalar()
    return per.filter("NOT ok").select("lsn", F.when(F.col("lsn") > F.coalesce(last, F.lit(-1)), "TAIL").otherwise("CORRUPT").alias("standing"))


def event_waves(archive: DataFrame, events: DataFrame, max_steps: int, threshold: float, top_k: int, mask: tuple[int, ...]) -> DataFrame:
    """Waves from the seed nodes of events over the archive's edges, with the relation of each path: event_id, node_id, energy,
    relation. Asked events that the archive lacks give nothing."""
    seeds = archive.join(events.select("event_id").distinct(), "event_id", "left_semi").select("event_id", F.col("seed_node").alias("seed"))
    edges = hot_edges(archive).select("src", "dst", "edge_type", (F.col("weight_milli") / 1000).alias("weight")).distinct()
    rows = wave.best_first(edges, seeds.select(F.col("seed").alias("node_id")), max_steps, threshold, top_k, mask)
    rows = relations(rows.withColumn("edge_types", type_names(F.col("best_path"))))
    return rows.join(seeds, "seed").select("event_id", "node_id", "energy", "relation")
