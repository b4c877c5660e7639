"""Cutting lineage in iterative plans, safe against the loss of executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder shared by all executors. ``spark.checkpoint.dir`` of the session wins; only where it is unset
    (tests on one machine) a temporary folder is made and removed at exit."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidegraph-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession) -> str | None:
    """The shared folder as a path that all executors can open, or None where it isn't a file system of theirs."""
    scheme, path = re.fullmatch(r"(?:([a-z][a-z0-9+.-]*):)?(?://[^/]*)?(/.*)", checkpoint_folder(spark)).groups()
    return path if scheme in (None, "file") else None


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Plans made within remove their shuffle files as soon as they have run, not when the driver happens to collect its
    garbage. For plans that run once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, was)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; later plans start from the files, not from the lineage."""
    checkpoint_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return without_estimates(df.select("*").checkpoint(eager=True))


def without_estimates(kept: DataFrame) -> DataFrame:
    """The rows of a checkpoint without the size and the constraints that the planner guessed for them.

    A checkpoint inherits both from its plan. Sizes of joins are guessed as products, so that in a loop of joins their
    digits multiply from round to round until planning takes longer than running.
    """
    spark = kept.sparkSession
    try:
        rows = kept._jdf.queryExecution().analyzed().rdd()
        return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), spark)
    except Exception:  # a session that isn't in this process, or another version
        return kept


def cut_by(df: DataFrame, *keys: str) -> DataFrame:
    """``cut`` with the rows hash-partitioned by ``keys``, which later joins and groupings on them find and don't shuffle.

    A plan that adapts at run time doesn't tell how its result is partitioned, so this one doesn't adapt.
    """
    spark = df.sparkSession
    name = "spark.sql.adaptive.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        checkpoint_folder(spark)
        with shuffles_removed(spark):
            return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).checkpoint(eager=True)
    finally:
        spark.conf.set(name, was)
