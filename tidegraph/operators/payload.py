"""Planning reads of payloads: spans of neighbouring pointers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.plans.lineage import cut


def gap_spans(pointers: DataFrame, max_gap: int, file: str = "file") -> DataFrame:
    """(file, span_offset, span_length, n_records): pointers (file, record_id, offset, length) joined over gaps up to
    ``max_gap``: gaps and islands by windows per file."""
    if max_gap < 0:
        raise ValueError("max_gap must not be negative")
    w = Window.partitionBy(file).orderBy("offset", "record_id")
    end = F.max(F.col("offset") + F.col("length")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("offset") - end <= max_gap, 0).otherwise(1)
    rows = pointers.withColumn("__new", new).withColumn("__span", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(file, "__span").agg(F.min("offset").alias("span_offset"), F.max(F.col("offset") + F.col("length")).alias("e"), F.count(F.lit(1)).alias("n_records"))
    return out.select(file, "span_offset", (F.col("e") - F.col("span_offset")).alias("span_length"), "n_records")


def bounded_spans(pointers: DataFrame, max_gap: int, max_span: int, file: str = "file") -> DataFrame:
    """``gap_spans`` in which no span of several records is longer than ``max_span``: records join the running span while
    gap and length allow. (file, record_id, span_offset, span_length).

    The running rule can't cross a gap over ``max_gap``, so it is folded within gap islands: those are found by windows,
    sorted as they leave the shuffle, and walked in a stream, never held as a whole.
    """
    if max_span <= 0:
        raise ValueError("max_span must be positive")
    w = Window.partitionBy(file).orderBy("offset", "record_id")
    end = F.max(F.col("offset") + F.col("length")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = pointers.select(file, "record_id", "offset", "length").withColumn("__new", F.when(F.col("offset") - end <= max_gap, 0).otherwise(1))
    rows = rows.withColumn("__isle", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    rows = rows.repartition(file, "__isle").sortWithinPartitions(file, "__isle", "offset", "record_id")
    kind = dict(pointers.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, begin, end = None, 0, 0
        for pdf in batches:
            starts = []
            for f, isle, o, n in zip(pdf[file], pdf["__isle"], pdf["offset"], pdf["length"], strict=True):
                if at == (f, isle) and max(end, o + n) - begin <= max_span:
                    end = max(end, o + n)
                else:
                    at, begin, end = (f, isle), o, o + n
                starts.append(begin)
            yield pdf.drop(columns="__isle").assign(span_offset=starts)

    out = rows.mapInPandas(run, f"{file} {kind[file]}, record_id {kind['record_id']}, offset long, length long, span_offset long")
    out = cut(out)
    ends = out.groupBy(file, "span_offset").agg(F.max(F.col("offset") + F.col("length")).alias("__e"))
    return out.join(ends, [file, "span_offset"]).select(file, "record_id", "offset", "length", "span_offset", (F.col("__e") - F.col("span_offset")).alias("span_length"))


def read_costs(spans: DataFrame, file: str = "file") -> DataFrame:
    """One row: reads and bytes by record and by span."""
    one = spans.agg(F.count(F.lit(1)).alias("naive_reads"), F.coalesce(F.sum("length"), F.lit(0)).alias("naive_bytes"))
    per = spans.select(file, "span_offset", "span_length").distinct()
    two = per.agg(F.count(F.lit(1)).alias("span_reads"), F.coalesce(F.sum("span_length"), F.lit(0)).alias("span_bytes"))
    return one.join(F.broadcast(two), how="full", on=F.lit(True))


def fetch(pointers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(record_id, payload) of the asked records."""
    return pointers.select("record_id").distinct().join(payloads.select("record_id", "payload"), "record_id")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has and the other lacks, as bags."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).union(b.exceptAll(a).withColumn("side", F.lit("b")))


def checksum_failures(rows: DataFrame, mode: str = "full") -> DataFrame:
    """Rows (position, payload, crc) whose payload has another CRC-32: all, one in eight positions (sampled), or none (off)."""
    if mode not in ("full", "sampled", "off"):
        raise ValueError(f"unknown mode {mode}")
    some = {"full": F.lit(True), "sampled": F.pmod("position", F.lit(8)) == 0, "off": F.lit(False)}[mode]
    return rows.filter(some & (F.crc32("payload") != F.col("crc")))


def pages(records: DataFrame, page_size: int, file: str = "file") -> DataFrame:
    """(file, record_id, page, page_offset): records in the order of record_id on pages of a fixed size that none crosses.
    One longer than a page begins on a page of its own and takes as many in a row as it needs. Pages of a file follow from one another, so each file is one stream."""
    rows = records.select(file, "record_id", "length").repartition(file).sortWithinPartitions(file, "record_id")
    kind = dict(records.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, page, used = None, 0, 0
        for pdf in batches:
            where, offsets = [], []
            for f, n in zip(pdf[file], pdf["length"], strict=True):
                if f != at:
                    at, page, used = f, 0, 0
                if used and used + n > page_size:
                    page, used = page + 1, 0
                where.append(page)
                offsets.append(used)
                used += n
                if n > page_size:
                    page, used = page + -(-n // page_size), 0
            yield pdf.drop(columns="length").assign(page=where, page_offset=offsets)

    return rows.mapInPandas(run, f"{file} {kind[file]}, record_id {kind['record_id']}, page long, page_offset long")


def top_records(candidates: DataFrame, k: int) -> DataFrame:
    """The ``k`` first candidates by energy descending, rank, node and record; none for k of 0 or less."""
    if k <= 0:
        return candidates.limit(0)
    return candidates.orderBy(F.col("energy_score").desc(), "rank", "node_id", "record_id").limit(k)


def wave_payloads(rows: DataFrame, index: DataFrame, archive: DataFrame, max_records: int, max_gap: int, max_span: int) -> DataFrame:
    """Spans of the payloads of the events behind a wave's nodes: rows (node_id, rank) meet the index (node_id, event_id);
    each event counts at its best rank; the first ``max_records`` events are read."""
    events = rows.join(index, "node_id").groupBy("event_id").agg(F.min("rank").alias("rank"))
    events = events.orderBy("rank", "event_id").limit(max_records)
    pointers = archive.join(events, "event_id").select(F.lit(0).alias("file"), F.col("event_id").alias("record_id"), F.col("payload_offset").alias("offset"), F.col("payload_len").alias("length"))
    return bounded_spans(pointers, max_gap, max_span)
