"""Retrieval metrics and latency summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval(results: DataFrame, k: int) -> DataFrame:
    """Per query of results (query_id, rank, relevant): precision at k, hit at 1, reciprocal rank, and nDCG at k (whose ideal
    puts the query's relevant results first)."""
    top = results.filter(F.col("rank") <= k)
    rel = F.col("relevant").cast("int")
    gain = F.sum(rel / F.log2(F.col("rank") + 1))
    per = top.groupBy("query_id").agg(
        (F.sum(rel) / k).alias("precision"), F.max(F.when(F.col("rank") == 1, rel)).alias("top1"),
        F.coalesce(F.max(F.when(F.col("relevant"), 1.0 / F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"), gain.alias("dcg"), F.sum(rel).alias("n"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    return per.select("query_id", "precision", "top1", "reciprocal_rank", F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def overall(per_query: DataFrame) -> DataFrame:
    """Means over queries, and how many found nothing."""
    mean = lambda c: F.round(F.avg(c), 9).alias(c)
    return per_query.agg(F.count(F.lit(1)).alias("n_queries"), mean("precision"), mean("top1"), mean("reciprocal_rank"), mean("ndcg"), F.count(F.when(F.col("precision") == 0, 1)).alias("zero_hits"))


def latencies(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, nearest-rank median and 95th percentile, by weighted values so that no group is sorted in one task."""
    from tidegraph.operators.frequency import summarize

    return summarize(rows, by, value, (0.5, 0.95)).select(*by, "n_values", "min_value", "p50", "p95", "max_value")
