"""Reading the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder. Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


FORMATS = ("parquet", "orc", "json", "csv")


def read(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """Rows of files with a stated schema (see ``tidegraph.schemas``), never an inferred one; rows that don't fit it are an error
    in text formats."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    reader = spark.read.schema(schema)
    if kind in ("json", "csv"):
        reader = reader.option("mode", "FAILFAST")
    if kind == "csv":
        reader = reader.option("header", "true").option("multiLine", "true").option("escape", '"')
    return reader.format(kind).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", sort_by: tuple[str, ...] = ()) -> None:
    """Rows as files, which become visible together. ``sort_by`` gives files disjoint ranges of these columns, so that later
    filters on them skip files."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    if sort_by:
        df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    writer = df.write.mode("errorifexists")
    if kind == "csv":
        writer = writer.option("header", "true").option("escape", '"')
    writer.format(kind).save(path)
