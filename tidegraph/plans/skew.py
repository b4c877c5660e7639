"""Joins and groupings that stay even when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most 1 / HEAVY_SHARE keys can hold this share of the rows each, so a table of them may be broadcast at any scale.
HEAVY_SHARE = 1e-4
#: Below this many rows a key is never worth splitting.
HEAVY_ROWS = 20_000
#: Parts that the rows of a heavy key are split into.
SALTS = 32


def heavy_keys(df: DataFrame, keys: list[str], share: float = HEAVY_SHARE, rows: int = HEAVY_ROWS) -> DataFrame:
    """The keys that hold at least ``rows`` rows and ``share`` of all rows: never more than 1 / share of them.

    One pass with map-side combine. Null is a key like any other. The count of all rows comes from a scalar subquery.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1)).alias("__all"))
    return counts.filter((F.col("__n") >= rows) & (F.col("__n") >= share * total.scalar())).select(*keys)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str,
    spread: Column,
    condition: Column | None = None,
    share: float = HEAVY_SHARE,
    rows: int = HEAVY_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join on ``keys`` in which heavy keys of ``left`` are split into ``salts`` parts by the hash of ``spread``.

    ``right`` is copied over the parts for heavy keys alone. ``how`` may be inner, left, left_semi or left_anti.
    ``condition`` may add a predicate on columns of both sides, whose other names must not clash. Null keys match nothing.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join can't be {how}")
    heavy = heavy_keys(left.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)), keys, share, rows)
    marked = F.broadcast(heavy.withColumn("__heavy", F.lit(True)))
    one = F.when(F.col("__heavy"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    a = left.join(marked, keys, "left").withColumn("__salt", one).drop("__heavy")
    every = F.when(F.col("__heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    b = right.join(marked, keys, "left").withColumn("__salt", F.explode(every)).drop("__heavy")
    if condition is None:
        return a.join(b, [*keys, "__salt"], how).drop("__salt")
    b = b.select(*[F.col(k).alias(f"__r_{k}") for k in [*keys, "__salt"]], *[c for c in b.columns if c not in (*keys, "__salt")])
    on = condition
    for k in [*keys, "__salt"]:
        on = on & (F.col(k) == F.col(f"__r_{k}"))
    out = a.join(b, on, how).drop("__salt")
    return out.drop(*[f"__r_{k}" for k in [*keys, "__salt"]]) if how in ("inner", "left") else out
