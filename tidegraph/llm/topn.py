"""The top N of every group, for millions of groups of which some hold millions of rows: a hot-cold split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.plans.lineage import cut

#: A group is hot from so many rows on, if it also holds HOT_SHARE of all rows (so at most 1 / HOT_SHARE groups are hot
#: and their table may be broadcast at any scale).
HOT_ROWS = 20_000
HOT_SHARE = 1e-5


def one_candidate(rows: DataFrame, group: Sequence[str], item: Sequence[str], score: str, rank: str) -> DataFrame:
    """Rows with a finite or infinite score, one per group and item: the first by score descending, rank ascending (null
    last). Null and NaN scores never count; -0.0 becomes 0.0. Combines on the map side, so repeated rows stay cheap."""
    s = F.col(score).cast("double")
    best = F.min(F.struct((-F.when(s == 0, F.lit(0.0)).otherwise(s)).alias("down"), F.col(rank).isNull().alias("unranked"), F.col(rank).alias("rank")))
    ok = rows.filter(s.isNotNull() & ~F.isnan(s)).groupBy(*group, *item).agg(best.alias("b"))
    return ok.select(*group, *item, F.when(F.col("b.down") == 0, F.lit(0.0)).otherwise(-F.col("b.down")).alias(score), F.col("b.rank").alias(rank))


def top_n(
    rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, hot_rows: int = HOT_ROWS, hot_share: float = HOT_SHARE, parts: int | None = None
) -> DataFrame:
    """The first ``n`` rows of each group in a total ``order``, with ``position`` 1..n. Null group keys form groups.

    Exact group counts part the groups. Light groups go through an ordinary window. The rows of hot groups are salted by
    range: sorted by group and order over many partitions, each of which keeps its own first ``n`` per group, from which
    a window takes the final ones; no task sees more of a group than its range and ``n`` rows of each other range.
    Repeated rows take a place each. An empty table gives no rows. Columns are kept as they are. ``rows`` are read
    several times: keep them first if they are dear.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    hot = cut(counts.filter((F.col("__n") >= hot_rows) & (F.col("__n") >= hot_share * total.scalar())).select(*group))
    keys = [f"__g{i}" for i in range(len(group))]
    hot = F.broadcast(hot.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)]))
    same = F.lit(True)
    for g, k in zip(group, keys, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(k))
    light = rows.join(hot, same, "left_anti")
    heavy = rows.join(hot, same, "left_semi")
    first = lambda df, by: df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col("position") <= n)
    salted = heavy.repartitionByRange(parts, *[F.col(g) for g in group], *order).withColumn("__salt", F.spark_partition_id())
    some = first(salted, ["__salt", *group]).drop("__salt", "position")
    return first(light, group).unionByName(first(some, group))


def seeds(receipts: DataFrame) -> DataFrame:
    """(receipt_id, seed_node): the distinct, non-null seeds of each receipt, over all of its deliveries."""
    return receipts.select("receipt_id", F.explode("seed_nodes").alias("seed_node")).dropna().distinct()


def best_candidates(candidates: DataFrame, receipts: DataFrame, n: int = 5, **split) -> DataFrame:
    """The ``n`` best candidates of each receipt and seed: score descending, rank ascending (null last), then ids.

    Groups are cut to ``n`` rows before they meet the seeds, as a join by group would bring a hot one into one task.
    """
    group = ["receipt_id", "seed_node"]
    rows = candidates.select(*group, "node_id", "record_id", "energy_score", "rank").dropna(subset=group)
    one = cut(one_candidate(rows, group, ["node_id", "record_id"], "energy_score", "rank"))
    order = [F.col("energy_score").desc(), F.col("rank").asc_nulls_last(), F.col("node_id").asc_nulls_last(), F.col("record_id").asc_nulls_last()]
    return top_n(one, group, order, n, **split).join(seeds(receipts), group, "left_semi")
