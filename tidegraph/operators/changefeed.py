"""Rebuilding current state from a feed of inserts, updates and deletes: a commutative fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.plans.lineage import cut
from tidegraph.plans.skew import salted_join


def fold(
    changes: DataFrame, keys: Sequence[str], sequence: Sequence[str], is_delete: Column, payload: Sequence[str], base: DataFrame | None = None
) -> DataFrame:
    """The state per key after all changes, tombstones included: keys, sequence, ``is_deleted``, payload.

    The state of a key is the maximum of struct(sequence, operation, payload), which doesn't depend on the order or the
    repetition of the changes and combines on the map side, so hot keys cost one row a task. ``base`` rows (keys and
    payload, perhaps from an earlier fold with its sequence) come before all changes that they have no sequence for. At
    the same sequence a delete wins over a put, and of two puts the greater payload. Changes with a null sequence or a
    null key part are dropped: they have no place in the order or name nothing. Tombstones stay, so that a late change
    with a lower sequence can't bring a key back when this state is the next base.
    """
    seq = [F.col(s).alias(f"s{i}") for i, s in enumerate(sequence)]
    gone = F.coalesce(is_delete, F.lit(False))
    body = F.struct(*[F.when(~gone, F.col(p)).alias(p) for p in payload]) if payload else F.lit(None).cast("string")
    rows = changes.dropna(subset=[*keys, *sequence]).select(*keys, F.struct(*seq, gone.alias("is_deleted"), body.alias("payload")).alias("state"))
    if base is not None:
        types = dict(changes.dtypes)
        seq = [(F.col(s) if s in base.columns else F.lit(None)).cast(types[s]).alias(f"s{i}") for i, s in enumerate(sequence)]
        gone = F.col("is_deleted") if "is_deleted" in base.columns else F.lit(False)
        body = F.struct(*[F.col(p).cast(types[p]).alias(p) for p in payload]) if payload else F.lit(None).cast("string")
        rows = rows.unionByName(base.dropna(subset=list(keys)).select(*keys, F.struct(*seq, gone.alias("is_deleted"), body.alias("payload")).alias("state")))
    out = rows.groupBy(*keys).agg(F.max("state").alias("state"))
    return out.select(
        *keys,
        *[F.col(f"state.s{i}").alias(s) for i, s in enumerate(sequence)],
        F.col("state.is_deleted").alias("is_deleted"),
        *[F.col(f"state.payload.{p}").alias(p) for p in payload],
    )


FIELDS = "record_id string, node_id string, body string, src string, dst string, edge_type string, weight_million string, op_count string, broken string"


def whole_frames(wal: DataFrame) -> DataFrame:
    """One frame per lsn, parsed: lsn, kind (upper case), txn (lower case), is_whole, payload fields.

    Of the copies of a frame, one with a whole payload (a JSON object, or null where none is needed) counts. Frames
    without lsn have no place in the order and are dropped. Numbers may be strings; members may stand in any order.
    Parsed once and kept, as transactions and operations both read the frames.
    """
    text = F.col("payload").cast("string")
    rows = wal.select("lsn", F.upper(F.trim("frame_type")).alias("kind"), F.lower(F.trim("transaction_id")).alias("txn"), text.alias("text"))
    whole = F.coalesce(F.try_parse_json("text").isNotNull(), F.lit(False))
    best = rows.filter("lsn IS NOT NULL").groupBy("lsn").agg(F.max(F.struct(whole.alias("is_whole"), "kind", "txn", "text")).alias("f"))
    j = F.from_json("f.text", FIELDS, {"columnNameOfCorruptRecord": "broken"})
    out = best.select("lsn", "f.kind", "f.txn", "f.is_whole", F.when(F.col("f.is_whole"), j).alias("j"))
    number = lambda c: F.expr(f"try_cast(trim(j.{c}) AS bigint)").alias(c)
    return cut(out.select("lsn", "kind", "txn", "is_whole", "j.record_id", "j.body", *[number(c) for c in ("node_id", "src", "dst", "edge_type", "weight_million", "op_count")]))


OPERATIONS = ("PUT_RECORD", "PUT_EDGE", "DELETE_RECORD", "DELETE_EDGE")


def transactions(frames: DataFrame) -> DataFrame:
    """Per txn: commit_lsn (of the first COMMIT or null), status and numbers of its frames.

    status: COMMITTED takes effect; ABORTED has an ABORT before any COMMIT; OPEN has no COMMIT; SHORT has other than
    op_count operation frames up to its first COMMIT. One pass: the first COMMIT's lsn, then counts up to it.
    """
    txn = frames.filter(F.col("txn").isNotNull() & (F.col("kind") != "CHECKPOINT"))
    first = F.min(F.when(F.col("kind") == "COMMIT", F.struct("lsn", "op_count"))).alias("c")
    per = txn.groupBy("txn").agg(first, F.min(F.when(F.col("kind") == "ABORT", F.col("lsn"))).alias("abort_lsn"), F.min(F.when(F.col("kind") == "BEGIN", F.col("lsn"))).alias("begin_lsn"))
    per = per.select("txn", "begin_lsn", "abort_lsn", F.col("c.lsn").alias("commit_lsn"), F.col("c.op_count").alias("op_count"))
    ops = txn.filter(F.col("kind").isin(*OPERATIONS)).select("txn", "lsn")
    upto = salted_join(ops, per.filter("commit_lsn IS NOT NULL").select("txn", "commit_lsn"), ["txn"], "left", F.col("lsn"))
    done = upto.groupBy("txn").agg(
        F.count(F.lit(1)).alias("n_frames"), F.count(F.when(F.col("lsn") < F.col("commit_lsn"), F.lit(1))).alias("n_ops")
    )
    out = per.join(done, "txn", "left").withColumns({"n_frames": F.coalesce("n_frames", F.lit(0)), "n_ops": F.coalesce("n_ops", F.lit(0))})
    aborted = F.col("abort_lsn").isNotNull() & (F.col("commit_lsn").isNull() | (F.col("abort_lsn") < F.col("commit_lsn")))
    status = (
        F.when(aborted, "ABORTED").when(F.col("commit_lsn").isNull(), "OPEN").when(F.col("n_ops").eqNullSafe(F.col("op_count")), "COMMITTED").otherwise("SHORT")
    )
    return out.withColumn("status", status)


def effective_changes(wal: DataFrame) -> DataFrame:
    """The put and delete frames of committed transactions up to their first COMMIT, with its ``commit_lsn``."""
    frames = whole_frames(wal)
    done = transactions(frames).filter("status = 'COMMITTED'").select("txn", "commit_lsn")
    ops = frames.filter(F.col("kind").isin(*OPERATIONS))
    return salted_join(ops, done, ["txn"], "inner", F.col("lsn")).filter("lsn < commit_lsn")


EDGE_KEY = ("src", "dst", "edge_type", "weight_million")


def entity(c: str = "") -> Column:
    edge = F.concat(F.lit("e:"), F.concat_ws(":", *[F.col(f"{c}{k}").cast("string") for k in EDGE_KEY]))
    whole = F.lit(True)
    for k in EDGE_KEY:
        whole = whole & F.col(f"{c}{k}").isNotNull()
    return F.when(F.col(f"{c}kind").endswith("RECORD"), F.concat(F.lit("r:"), F.col(f"{c}record_id"))).when(whole, edge)


def replay(wal: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Current records and edges: entity, commit_lsn, lsn, is_deleted and the fields of the put that wrote it last.

    Transactions take effect in the order of their first COMMITs, their frames in the order of lsn. Frames whose
    payload names no entity count as operations but change nothing.
    """
    ops = effective_changes(wal).withColumn("entity", entity())
    fields = ["record_id", "node_id", "body", *EDGE_KEY]
    return fold(ops, ["entity"], ["commit_lsn", "lsn"], F.col("kind").startswith("DELETE"), fields, base)
