"""Per-key summaries where a few keys hold most rows: value-frequency compression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.plans.lineage import cut


def compress(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row for each key and value with the number ``n`` of rows that hold it.

    Grouping by key *and* value spreads a hot key over as many groups as it has values, and map-side combine sends each
    of them once per task. Null keys and null values form groups of their own. For doubles -0.0 counts as 0.0 and every
    NaN as the same value. Other columns of ``df`` are pruned, so they may have any name.
    """
    v = F.col(value)
    if dict(df.dtypes)[value] in ("double", "float"):
        v = F.when(v == 0, F.lit(0).cast(dict(df.dtypes)[value])).otherwise(v)
    return df.select(*keys, v.alias("value")).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))


def key_counts(compressed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, non-null values and exact distinct values per key, from ``compress``."""
    return compressed.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).cast("long").alias("n_values"),
        F.count("value").alias("n_distinct"),
    )


def summarize(
    df: DataFrame, keys: Sequence[str], value: str, percentiles: Sequence[float] = (0.5, 0.9), partitions: int | None = None
) -> DataFrame:
    """Exact counts, distinct counts, mode and percentiles of ``value`` per key, with no task that sees a whole hot key.

    Result: the keys, n_rows, n_values, n_distinct, mode, mode_rows, min_value, max_value and one column ``p<percent>``
    for each percentile. A percentile is by nearest rank: the smallest value that at least that share of the key's
    non-null rows doesn't exceed. Ties for the mode go to the smallest value. A key with null values only has nulls
    there. An empty table gives no rows. Keys may be null. -0.0 counts as 0.0; NaN sorts above all numbers.

    The weighted values are range-sorted by key and value together, so that a hot key covers many partitions; a running
    sum within each partition plus the offset of the key's earlier partitions gives exact ranks.
    """
    keys = list(keys)
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    vc = cut(compress(df, keys, value))  # read for the counts, the bounds of ranges and the ranks
    counts = vc.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).cast("long").alias("n_values"),
        F.count("value").alias("n_distinct"),
        F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("m"), F.col("value")))).alias("top"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )
    counts = counts.select(
        *keys, "n_rows", "n_values", "n_distinct", F.col("top.value").alias("mode"), (-F.col("top.m")).alias("mode_rows"), "min_value", "max_value"
    )
    names = [f"p{100 * p:g}".replace(".", "_") for p in percentiles]
    if not names:
        return counts
    # The partition's number is fixed by the checkpoint before it is used as a key.
    tagged = cut(vc.filter(F.col("value").isNotNull()).repartitionByRange(parts, *keys, "value").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tagged.groupBy(*keys, "part").agg(F.sum("n").alias("in_part"))
    offsets = offsets.withColumn("offset", F.coalesce(F.sum("in_part").over(before), F.lit(0))).withColumn("total", F.sum("in_part").over(Window.partitionBy(*keys)))
    renamed = offsets.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("part").alias("__part"), "offset", "total")
    on = F.col("part") == F.col("__part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    within = Window.partitionBy(*keys, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = tagged.join(renamed, on).withColumn("upto", F.col("offset") + F.sum("n").over(within))
    hit = []
    for p, name in zip(percentiles, names, strict=True):
        rank = F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(float(p)) - F.lit(1e-9)))
        hit.append(F.min(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank), F.col("value"))).alias(name))
    found = ranked.groupBy(*keys).agg(*hit).select(*[F.col(k).alias(f"__{k}") for k in keys], *names)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return counts.join(found, on, "left").drop(*[f"__{k}" for k in keys])


def heavy_hitters(df: DataFrame, keys: Sequence[str], value: str, one_in: int) -> DataFrame:
    """Keys that hold at least one in ``one_in`` of all rows of ``df``; keys with a null count in the total alone."""
    per_key = cut(key_counts(compress(df, keys, value), keys))
    total = per_key.agg(F.sum("n_rows").alias("total"))
    return per_key.filter(F.col("n_rows") * one_in >= total.scalar()).dropna(subset=list(keys))
