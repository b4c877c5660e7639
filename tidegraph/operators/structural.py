"""Structural features of nodes and the 48-part structural embedding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.wave import prepared

DIMENSION = 48


def feature_rows(edges: DataFrame, waves: DataFrame | None = None) -> DataFrame:
    """(node_id, feature, value) of every non-zero feature.

    Features: 0, 1 log of the degrees; 2, 3 mean weights out, in; 4 reciprocal neighbours; 5, 6 distinct neighbours; 7 log of
    the fan-in of targets beyond the own edge; 8-15, 16-23 weights by type mod 8; 24-27 wave energy by depth (0..3), 28-35 by
    last type mod 8, 36-39 nodes by depth; 40-47 products of weights over two edges in a row by both types.

    Two-edge features never list paths: inner edges are summed per node and type before they meet, so a hub costs ten rows.
    """
    n, e = F.col, prepared(edges)
    row = lambda df, node, feature, value: df.select(F.col(node).alias("node_id"), feature.cast("int").alias("feature"), value.cast("double").alias("value"))
    out_of = e.groupBy("src").agg(F.count(F.lit(1)).alias("c"), F.sum("weight").alias("w"))
    into = e.groupBy("dst").agg(F.count(F.lit(1)).alias("c"), F.sum("weight").alias("w"))
    pairs = e.select("src", "dst").distinct()
    back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    fan = e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")).join(into.select("dst", F.greatest(F.col("c") - 1, F.lit(0)).alias("f")), "dst").groupBy("src").agg(F.sum(F.col("m") * F.col("f")).alias("s"))
    by_out = e.groupBy("src", "edge_type").agg(F.sum("weight").alias("w"))
    by_in = e.groupBy("dst", "edge_type").agg(F.sum("weight").alias("w"))
    second = by_out.select(F.col("src").alias("dst"), F.col("edge_type").alias("t2"), F.col("w").alias("w2"))
    first = e.groupBy("src", "dst", "edge_type").agg(F.sum("weight").alias("w1"))
    two = first.join(second, "dst").groupBy("src", F.pmod(n("edge_type") * 131 + n("t2") * 17, F.lit(8)).alias("b")).agg(F.sum(n("w1") * n("w2")).alias("w"))
    parts = [
        row(out_of, "src", F.lit(0), F.log1p("c")), row(into, "dst", F.lit(1), F.log1p("c")),
        row(out_of, "src", F.lit(2), n("w") / n("c")), row(into, "dst", F.lit(3), n("w") / n("c")),
        row(pairs.join(back, ["src", "dst"]).groupBy("src").agg(F.count(F.lit(1)).alias("c")), "src", F.lit(4), n("c")),
        row(pairs.groupBy("src").agg(F.count(F.lit(1)).alias("c")), "src", F.lit(5), n("c")),
        row(pairs.groupBy("dst").agg(F.count(F.lit(1)).alias("c")), "dst", F.lit(6), n("c")),
        row(fan, "src", F.lit(7), F.log1p("s")),
        row(by_out.groupBy("src", F.pmod("edge_type", F.lit(8)).alias("b")).agg(F.sum("w").alias("w")), "src", n("b") + 8, n("w")),
        row(by_in.groupBy("dst", F.pmod("edge_type", F.lit(8)).alias("b")).agg(F.sum("w").alias("w")), "dst", n("b") + 16, n("w")),
        row(two, "src", n("b") + 40, n("w")),
    ]
    if waves is not None:
        depth = F.least(n("best_path_len"), F.lit(3))
        last = F.pmod(F.element_at("best_path", -1), F.lit(8))
        parts += [
            row(waves.groupBy("seed", depth.alias("d")).agg(F.sum("energy").alias("v")), "seed", n("d") + 24, n("v")),
            row(waves.filter("best_path_len > 0").groupBy("seed", last.alias("b")).agg(F.sum("energy").alias("v")), "seed", n("b") + 28, n("v")),
            row(waves.groupBy("seed", depth.alias("d")).agg(F.count(F.lit(1)).alias("v")), "seed", n("d") + 36, n("v")),
        ]
    return reduce(DataFrame.union, parts)


def vectors(features: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, vec): the features of each of ``nodes`` as a unit vector of floats; a node without any has 1 at 24 and 36."""
    one = features.groupBy("node_id").agg(*[F.coalesce(F.sum(F.when(F.col("feature") == i, F.col("value"))), F.lit(0.0)).alias(f"f{i}") for i in range(DIMENSION)])
    raw = F.array(*[F.coalesce(f"f{i}", F.lit(1.0 if i in (24, 36) else 0.0)) for i in range(DIMENSION)])
    rows = nodes.select("node_id").distinct().join(one, "node_id", "left").select("node_id", raw.alias("raw"))
    zero = F.forall("raw", lambda x: x == 0)
    rows = rows.withColumn("raw", F.when(zero, F.array(*[F.lit(1.0 if i in (24, 36) else 0.0) for i in range(DIMENSION)])).otherwise(F.col("raw")))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("norm", norm).select("node_id", F.transform("raw", lambda x: (x / F.col("norm")).cast("float")).alias("vec"))
