"""A database of records and edges in a folder: an append-only log of changes and checkpointed states."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.hashing import state_digest
from tidegraph.operators import changefeed, edges, mutations, wave

CHANGES = "commit bigint, op string, kind string, record_id string, node_id bigint, payload string, src bigint, dst bigint, edge_type int, weight_million bigint"
KEYS = ["kind", "record_id", "src", "dst", "edge_type", "weight_million"]


class Database:
    """Batches of changes are appended with a commit number; the state is the fold of a checkpoint and the changes after it.
    ``folder`` must be one that the driver and all executors share.

    One writer at a time: numbers come from the log when a batch is committed. Parquet's committer makes a batch visible
    as a whole. A change is (op PUT or DELETE, kind RECORD or EDGE, and the fields of its kind).
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        Path(folder).mkdir(parents=True, exist_ok=True)

    def _at(self, *names: str) -> str:
        return str(Path(self.folder, *names))

    def _commits(self, kind: str) -> list[int]:
        return sorted(int(p.name) for p in Path(self._at(kind)).glob("*") if (p / "_SUCCESS").exists())

    def commit(self, changes: DataFrame) -> dict:
        """Appends a batch. Keys with different contents in it are a conflict; weights must lie in 0..1, ids be set."""
        rows = changes.withColumn("commit", F.lit(0).cast("long")).select(*[c.split()[0] for c in CHANGES.split(", ")])
        edge = F.col("kind") == "EDGE"
        bad = F.when(edge, F.col("src").isNull() | F.col("dst").isNull() | ~F.coalesce(F.col("edge_type").between(1, 10), F.lit(False)) | ~F.coalesce(F.col("weight_million").between(0, 1_000_000), F.lit(False)))
        bad = bad.when(F.col("kind") == "RECORD", F.col("record_id").isNull() | (F.col("record_id") == "")).otherwise(F.lit(True)) | ~F.coalesce(F.col("op").isin("PUT", "DELETE"), F.lit(False))
        n = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(bad, 1)).alias("bad")).first()
        if n["bad"]:
            raise ValueError(f"{n['bad']} changes are not valid")
        conflicts = mutations.batch_status(rows, KEYS, ["op", "node_id", "payload"]).filter("status = 'CONFLICT'").count()
        if conflicts:
            raise ValueError(f"{conflicts} keys have different contents in one batch")
        number = max([0, *self._commits("log"), *self._commits("state")]) + 1
        rows.withColumn("commit", F.lit(number).cast("long")).distinct().write.parquet(self._at("log", f"{number:012d}"))
        return {"commit": number, "n_changes": n["n"]}

    def state(self, upto: int | None = None) -> DataFrame:
        """Everything that exists after commit ``upto`` (the last one): a pinned view, as logs and states never change."""
        return self._folded(upto).filter("NOT is_deleted").select("commit", *KEYS, "node_id", "payload")

    def _folded(self, upto: int | None = None) -> DataFrame:
        """The same with tombstones and the key of each row."""
        states = [s for s in self._commits("state") if upto is None or s <= upto]
        logs = [c for c in self._commits("log") if c > (states[-1] if states else 0) and (upto is None or c <= upto)]
        empty = self.spark.createDataFrame([], CHANGES)
        changes = self.spark.read.schema(CHANGES).parquet(*[self._at("log", f"{c:012d}") for c in logs]) if logs else empty
        named = lambda df: df.withColumn("key", F.to_json(F.struct(*KEYS)))
        fields = [*KEYS, "node_id", "payload"]
        base = self.spark.read.parquet(self._at("state", f"{states[-1]:012d}")) if states else None
        return changefeed.fold(named(changes), ["key"], ["commit"], F.col("op") == "DELETE", fields, base)

    def checkpoint(self) -> int:
        """Writes the state after the last commit, tombstones included; later reads start from it."""
        commits = self._commits("log")
        if commits and commits[-1] not in self._commits("state"):
            self._folded().write.parquet(self._at("state", f"{commits[-1]:012d}"))
        return commits[-1] if commits else 0

    def records(self, upto: int | None = None) -> DataFrame:
        return self.state(upto).filter("kind = 'RECORD'").select("record_id", "node_id", "payload")

    def edges(self, upto: int | None = None) -> DataFrame:
        rows = self.state(upto).filter("kind = 'EDGE'")
        return rows.select(F.xxhash64("src", "dst", "edge_type", "weight_million").alias("logical_id"), "src", "dst", "edge_type", (F.col("weight_million") / 1_000_000).alias("weight"))

    def record(self, record_id: str) -> DataFrame:
        return self.records().filter(F.col("record_id") == record_id)

    def edges_of(self, node: int, direction: str = "both", types: str | None = None, limit: int | None = None) -> DataFrame:
        return edges.edges_of(self.edges(), node, direction, edges.parse_mask(types) if types else None, limit)

    def wave(self, seeds: list[int], mask: str | None = None, max_steps: int = 3, threshold: float = 0.07, top_k: int = 64, rigor: float = 1.0) -> DataFrame:
        """Best-first waves of the seeds, merged."""
        nodes = self.spark.createDataFrame([(s,) for s in seeds], "node_id long")
        return wave.merged_best(wave.best_first(self.edges(), nodes, max_steps, threshold, top_k, edges.parse_mask(mask), rigor), top_k)

    def status(self) -> dict:
        """Numbers of records, edges, commits, and digests that depend on content alone."""
        got = {"commits": len(self._commits("log")), "checkpoints": len(self._commits("state"))}
        for name, df, columns in (("records", self.records(), ["record_id", "node_id", "payload"]), ("edges", self.edges(), ["src", "dst", "edge_type", "weight"])):
            row = state_digest(df, columns).first()
            got |= {name: row["n_rows"], f"{name}_digest": row["digest"]}
        return got

    def verify(self) -> dict:
        """Edges whose ends no record stands for, and nodes with several records."""
        r = self.records()
        return {
            "unresolved_edges": edges.unresolved_ends(self.edges(), r).count(),
            "shared_nodes": r.filter("node_id IS NOT NULL").groupBy("node_id").count().filter("count > 1").count(),
        }

    def to_json(self) -> str:
        return json.dumps(self.status(), sort_keys=True)
