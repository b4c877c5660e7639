"""Graphs from tables: the order graph of the star schema, the durable graph, and synthetic ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.sources.tables import table

#: Node ids of the order graph: namespace times this plus the key.
SPACE = 1_000_000_000
NAMESPACES = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "orders": 6}


def node(namespace: str, key: str) -> Column:
    return F.lit(NAMESPACES[namespace] * SPACE) + F.col(key).cast("long")


def _edges(df: DataFrame, src: Column, dst: Column, edge_type: int, weight: Column) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(edge_type).alias("edge_type"), weight.cast("double").alias("weight"))


def canonical(weight: Column) -> Column:
    """A weight with -0.0 as 0.0."""
    return F.when(weight == 0, F.lit(0.0)).otherwise(weight)


def priority_weight() -> Column:
    first = F.substring("o_orderpriority", 1, 1)
    return F.when(first == "1", 0.95).when(first == "2", 0.85).when(first == "3", 0.75).when(first == "4", 0.65).otherwise(0.55)


def order_edges(spark: SparkSession, d: str, types: set[int] | None = None) -> DataFrame:
    """(src, dst, edge_type, weight) of the order graph, distinct. Only the tables that ``types`` need are read."""
    nations, customer, orders, supplier, lines = (table(spark, d, n) for n in ("nation", "customer", "orders", "supplier", "lineitem"))
    line = lines.select("l_orderkey", "l_partkey", "l_suppkey", canonical(F.col("l_discount")).alias("disc"), canonical(F.col("l_tax")).alias("tax"))
    parts = [
        (1, lambda: _edges(nations, node("nation", "n_nationkey"), node("region", "n_regionkey"), 1, F.lit(0.92))),
        (2, lambda: _edges(nations, node("region", "n_regionkey"), node("nation", "n_nationkey"), 2, F.lit(0.70))),
        (4, lambda: _edges(customer, node("customer", "c_custkey"), node("nation", "c_nationkey"), 4, F.lit(1.0))),
        (8, lambda: _edges(customer, node("nation", "c_nationkey"), node("customer", "c_custkey"), 8, F.lit(0.36))),
        (4, lambda: _edges(orders, node("orders", "o_orderkey"), node("customer", "o_custkey"), 4, F.lit(0.90))),
        (8, lambda: _edges(orders, node("customer", "o_custkey"), node("orders", "o_orderkey"), 8, priority_weight())),
        (5, lambda: _edges(line, node("orders", "l_orderkey"), node("part", "l_partkey"), 5, 1 - F.col("disc"))),
        (9, lambda: _edges(line, node("part", "l_partkey"), node("orders", "l_orderkey"), 9, F.lit(0.55))),
        (7, lambda: _edges(line, node("part", "l_partkey"), node("supplier", "l_suppkey"), 7, F.lit(0.86))),
        (6, lambda: _edges(line, node("supplier", "l_suppkey"), node("part", "l_partkey"), 6, 1 - F.col("tax"))),
        (3, lambda: _edges(supplier, node("supplier", "s_suppkey"), node("nation", "s_nationkey"), 3, F.lit(0.61))),
        (10, lambda: _edges(lines.filter("l_returnflag = 'R' AND l_discount >= 0.09"), node("orders", "l_orderkey"), node("part", "l_partkey"), 10, F.lit(1.0))),
    ]
    out: DataFrame | None = None
    for t, make in parts:
        if types is None or t in types:
            out = make() if out is None else out.union(make())
    assert out is not None
    return out.distinct()


def order_records(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, node_id, payload) with one record per row of the star schema's entities."""
    out: DataFrame | None = None
    for name, key, label in (
        ("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"),
        ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("orders", "o_orderkey", "o_orderstatus"),
    ):
        one = table(spark, d, name).select(F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("record_id"), node(name, key).alias("node_id"), F.col(label).alias("payload"))
        out = one if out is None else out.union(one)
    assert out is not None
    return out


def durable_edges(spark: SparkSession, d: str) -> DataFrame:
    """(logical_id, src, dst, edge_type, weight) of durable_edge: repeated deliveries once, without rows that lack an
    endpoint, a type or a weight, weights of -0.0 as 0.0."""
    rows = table(spark, d, "durable_edge").filter("src >= 0 AND dst >= 0 AND edge_type IS NOT NULL AND weight IS NOT NULL")
    latest = rows.groupBy("logical_id").agg(F.max(F.struct("arrived_at", "src", "dst", "edge_type", canonical(F.col("weight")).alias("weight"))).alias("e"))
    return latest.select("logical_id", "e.src", "e.dst", "e.edge_type", "e.weight")


def durable_records(spark: SparkSession, d: str, keep: tuple[str, ...] = ("logical_id", "node_id", "payload", "payload_sha256")) -> DataFrame:
    """(logical_id, record_id, node_id, payload, payload_sha256) of records that are not deleted, each once. ``keep`` may
    name the first of these only, so that payloads aren't shuffled; the latest row is the same."""
    rows = table(spark, d, "durable_record").filter("record_id IS NOT NULL")
    latest = rows.groupBy("record_id").agg(F.max(F.struct("arrived_at", *keep)).alias("r"), F.max("deleted_at").alias("gone"))
    return latest.filter("gone IS NULL").select("record_id", *[f"r.{k}" for k in keep])


def ring_graph(spark: SparkSession, n: int) -> DataFrame:
    """Three edges for each node 1..n: to the next, the seventh next, and a scattered one."""
    k = F.col("n")
    each = F.array(
        F.struct((k % n + 1).alias("dst"), F.lit(1).alias("edge_type"), F.lit(0.91).alias("weight")),
        F.struct(((k + 6) % n + 1).alias("dst"), F.lit(2).alias("edge_type"), F.lit(0.73).alias("weight")),
        F.struct(((17 * (k - 1) + 11) % n + 1).alias("dst"), F.lit(3).alias("edge_type"), F.lit(0.61).alias("weight")),
    )
    return spark.range(1, n + 1).withColumnRenamed("id", "n").select(k.alias("src"), F.explode(each).alias("e")).select("src", "e.*")


def typed_graph(spark: SparkSession, edges: int) -> DataFrame:
    """About ``edges`` typed edges over edges / 4 nodes, with a blocking edge at every 97th node."""
    n = max(64, edges // 4)
    k, parent = F.col("n"), F.floor(F.col("n") / 4)
    e = lambda src, dst, t, w: F.struct(src.cast("long").alias("src"), dst.cast("long").alias("dst"), F.lit(t).alias("edge_type"), F.lit(w).alias("weight"))
    far = (17 * k + 13) % n
    up = F.when(k != parent, e(k, parent, 1, 0.92)).otherwise(e(k, (k + 7) % n, 3, 0.88))
    each = F.array(e(k, (k + 1) % n, 4, 1.0), e(k, far, 5, 0.97), up, e(parent, k, 2, 0.70), F.when(k % 97 == 0, e(k, far, 10, 1.0)))
    return spark.range(n).withColumnRenamed("id", "n").select(F.explode(each).alias("e")).filter("e IS NOT NULL").select("e.*")
