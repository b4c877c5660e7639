"""Layered storage: a rule that computes values, sparse exceptions, and patches over both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def layered(rows: DataFrame, keys: list[str], rule: Column, exceptions: DataFrame, patches: DataFrame | None = None) -> DataFrame:
    """Rows with ``value`` and ``source_layer``: a patch before an exception before the rule.

    ``exceptions`` (keys, value) and ``patches`` (keys, value) have one row a key; both are sparse, so the optimizer
    broadcasts them while they are small and joins by shuffle when not.
    """
    out = rows.join(exceptions.select(*keys, F.col("value").alias("__x"), F.lit(True).alias("__hx")), keys, "left")
    if patches is None:
        patched, has = F.lit(None), F.lit(False)
    else:
        out = out.join(patches.select(*keys, F.col("value").alias("__p"), F.lit(True).alias("__hp")), keys, "left")
        patched, has = F.col("__p"), F.coalesce("__hp", F.lit(False))
    held = F.coalesce("__hx", F.lit(False))
    value = F.when(has, patched).when(held, F.col("__x")).otherwise(rule)
    layer = F.when(has, "G4_PATCH").when(held, "G2_EXCEPTION").otherwise("G1_RULE")
    return out.select(*rows.columns, value.alias("value"), layer.alias("source_layer"))


def last_patch(chain: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, seq): the last patch of each key by seq."""
    return chain.groupBy(*keys).agg(F.max(F.struct("seq", "after")).alias("p")).select(*keys, F.col("p.after").alias("value"), F.col("p.seq").alias("seq"))


def compact(exceptions: DataFrame, chain: DataFrame, keys: list[str], rule: Column) -> DataFrame:
    """Exceptions after folding a patch chain in: (keys, value); keys that are back at their rule's value are left out."""
    last = last_patch(chain, keys).select(*keys, F.col("value").alias("__p"), F.lit(True).alias("__hp"))
    out = exceptions.select(*keys, F.col("value").alias("__x")).join(last, keys, "full")
    value = F.when(F.col("__hp"), F.col("__p")).otherwise(F.col("__x"))
    return out.select(*keys, value.alias("value")).filter(~F.col("value").eqNullSafe(rule))


def inverse(chain: DataFrame) -> DataFrame:
    """The chain that undoes ``chain``: before and after swapped, in reverse order. ``seq`` must run from 1 without gaps."""
    top = chain.agg(F.max("seq")).scalar()
    return chain.select((top + 1 - F.col("seq")).alias("seq"), *[c for c in chain.columns if c not in ("seq", "before", "after")], F.col("after").alias("before"), F.col("before").alias("after"))


def stale(chain: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Patches whose ``before`` isn't the value they meet: the prior patch's ``after`` or the current value of the key."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("seq")
    rows = chain.withColumn("__prior", F.lag("after").over(w)).withColumn("__n", F.row_number().over(w))
    rows = rows.join(current.select(*keys, F.col("value").alias("__v")), keys, "left")
    met = F.when(F.col("__n") == 1, F.col("__v")).otherwise(F.col("__prior"))
    return rows.filter(~F.col("before").eqNullSafe(met)).select(*chain.columns)


def matrix(spark, n: int) -> DataFrame:
    """(row, col, key) of an n by n grid, from one range, without a join."""
    k = F.col("key")
    return spark.range(n * n).withColumnRenamed("id", "key").select(F.floor(k / n).alias("row"), (k % n).alias("col"), "key")


def choose(sizes: DataFrame, key: str, raw: str = "RAW") -> DataFrame:
    """Of candidates (key, mode, bytes), the smallest per key that beats raw, else raw; ties go to the mode's name."""
    best = F.min(F.struct("bytes", (F.col("mode") != raw).cast("int").alias("__o"), "mode"))
    return sizes.groupBy(key).agg(best.alias("b"), F.max(F.when(F.col("mode") == raw, F.col("bytes"))).alias("raw_bytes")).select(key, F.col("b.mode").alias("mode"), F.col("b.bytes").alias("bytes"), "raw_bytes")


def compressible(sizes: DataFrame) -> DataFrame:
    """(name, raw_bytes, compact_bytes) with ratio and whether a claim of compression holds (it must not on noise)."""
    return sizes.withColumn("ratio", F.round(F.col("raw_bytes") / F.col("compact_bytes"), 9)).withColumn("claim", F.col("compact_bytes") < F.col("raw_bytes"))
