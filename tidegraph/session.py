"""A session with the settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(**settings: str) -> SparkSession:
    """The running session, or a new one. On a cluster, ``spark.checkpoint.dir`` must name a shared folder and
    ``spark.sql.shuffle.partitions`` should be about the shuffled bytes over 128 MB; adaptive execution merges small ones."""
    return SparkSession.builder.config(map=SETTINGS | settings).getOrCreate()
