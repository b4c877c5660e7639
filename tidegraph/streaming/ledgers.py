"""Streaming views of the ledgers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.changefeed import fold
from tidegraph.operators.ledger import OPERATIONS, transition_table


def trust_stream(events: DataFrame) -> DataFrame:
    """A stream (record_id, sequence, operation) replayed per record with its state kept between batches: each event with
    ``legal`` and ``next_state``. Sequences must grow per record; one that doesn't is told as illegal and changes nothing."""
    table, number = transition_table(), {o: i for i, o in enumerate(OPERATIONS)}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, last = state.get if state.exists else (0, -1)
        rows = pd.concat(list(batches)).sort_values(["sequence", "operation"])
        out = []
        for s, o in zip(rows["sequence"], rows["operation"], strict=True):
            ok = s > last and o in number and table[number[o], now] >= 0
            if ok:
                now = int(table[number[o], now])
            last = max(last, s)
            out.append((key[0], s, o, bool(ok), now))
        state.update((now, int(last)))
        yield pd.DataFrame(out, columns=["record_id", "sequence", "operation", "legal", "next_state"])

    return events.groupBy("record_id").applyInPandasWithState(
        step, "record_id string, sequence long, operation string, legal boolean, next_state int", "state int, last long", "append", "NoTimeout"
    )


def windowed_metrics(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) counted per window and type; rows later than ``late`` behind the newest are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("sum_value"))


def apply_changes(folder: str, keys: list[str], sequence: list[str], payload: list[str], is_delete):
    """A foreachBatch function that folds each batch of changes into a state table in ``folder``/<epoch>, tombstones kept.

    Folding is commutative and idempotent and a batch writes to its own epoch's folder, so a repeated batch writes the
    same table again: the state is exact under retries.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        base = spark.read.parquet(f"{folder}/{epoch - 1}") if epoch else None
        fold(batch, keys, sequence, is_delete, payload, base).write.mode("overwrite").parquet(f"{folder}/{epoch}")

    return run
