"""Edge scans, adjacency, masks, blocking and induced subgraphs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.config import BLOCKER, DEFAULT_MASK, EDGE_TYPES
from tidegraph.plans.skew import salted_join

IDS = {name: i for i, name in EDGE_TYPES.items()}


def parse_mask(mask: Iterable[int | str] | str | None) -> tuple[int, ...]:
    """Edge type ids from names, ids, or both, separated by commas; the default mask for None. Unknown ones are errors."""
    if mask is None:
        return DEFAULT_MASK
    out = set()
    for m in mask.split(",") if isinstance(mask, str) else mask:
        m = m.strip() if isinstance(m, str) else m
        i = int(m) if isinstance(m, int) or m.isdigit() else IDS.get(m)
        if i not in EDGE_TYPES:
            raise ValueError(f"unknown edge type {m!r}")
        out.add(i)
    return tuple(sorted(out))


def in_mask(edge_type: Column, mask: Iterable[int]) -> Column:
    """Set membership, which is pushed down into scans."""
    return edge_type.isin(*mask)


def in_mask_bits(edge_type: Column, bits: int) -> Column:
    """The hop wave's test by bits, in which types 31 apart share a bit."""
    bit = F.call_function("shiftleft", F.lit(1), edge_type % 31)
    return bit.bitwiseAND(F.lit(bits).cast("int")) != 0


def blocked_pairs(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) that a blocking edge closes."""
    return edges.filter(F.col("edge_type") == BLOCKER).select("src", "dst").distinct()


def without_blocked(edges: DataFrame) -> DataFrame:
    """Edges other than blocking ones between pairs that no blocking edge closes."""
    return edges.filter(F.col("edge_type") != BLOCKER).join(blocked_pairs(edges), ["src", "dst"], "left_anti")


def edges_of(edges: DataFrame, node: int | DataFrame, direction: str = "out", types: Iterable[int] | None = None, limit: int | None = None) -> DataFrame:
    """Edges at a node, once per (src, dst, edge_type, weight in millionths), ordered; the node reaches the scan as a
    filter. Many nodes (a table with node_id) are joined with all edges, hot ends split."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"unknown direction {direction}")
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    if isinstance(node, DataFrame):
        edges = edges.select("src", "dst", "edge_type", "weight")
        ends = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
        found = [salted_join(edges, node.select(F.col("node_id").alias(c)).distinct(), [c], "left_semi", F.struct(*edges.columns)).select(*edges.columns) for c in ends]
        rows = found[0].union(found[-1]) if len(found) > 1 else found[0]
    else:
        at = {"out": F.col("src") == node, "in": F.col("dst") == node, "both": (F.col("src") == node) | (F.col("dst") == node)}[direction]
        rows = edges.filter(at)
    if types is not None:
        rows = rows.filter(in_mask(F.col("edge_type"), types))
    rows = rows.select("src", "dst", "edge_type", F.round(F.col("weight") * 1_000_000).cast("long").alias("weight_million")).distinct()
    rows = rows.orderBy("src", "dst", "edge_type", "weight_million")
    return rows.limit(limit) if limit else rows


def adjacency(edges: DataFrame) -> DataFrame:
    """Per source: degree, and its edges as an array in the stored order (edge_type, dst, weight). Arrays are as long as
    the degree; for hubs use ``stored_order``, which keeps one row an edge."""
    item = F.struct("edge_type", "dst", "weight")
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.array_sort(F.collect_list(item)).alias("edges"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, out_degree, in_degree), by one shuffle over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.select("x.*").groupBy("node_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def stored_order(edges: DataFrame, partitions: int | None = None) -> DataFrame:
    """Edges laid out by source for point lookups: range-partitioned and sorted, so files have disjoint source ranges."""
    by = ["src", "edge_type", "dst", "weight"]
    return (edges.repartitionByRange(partitions, *by) if partitions else edges.repartitionByRange(*by)).sortWithinPartitions(*by)


def unresolved_ends(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Edges with an end that no record stands for."""
    nodes = records.select(F.col("node_id").alias("n")).dropna().distinct()
    good = edges.join(nodes, edges.src == nodes.n, "left_semi")
    good = good.join(nodes, good.dst == nodes.n, "left_semi")
    return edges.join(good.select("logical_id"), "logical_id", "left_anti")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes`` (node_id)."""
    a = nodes.select(F.col("node_id").alias("src")).distinct()
    b = nodes.select(F.col("node_id").alias("dst")).distinct()
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def unsorted_rows(edges: DataFrame, order: str) -> DataFrame:
    """Rows that break the sort by (src, edge_type, dst) in the sequence ``order``, for checks of input layouts. Sequence
    numbers must be dense: a row meets its predecessor by an equi-join, not in a single sorted partition."""
    key = F.struct("src", "edge_type", "dst")
    prior = edges.select((F.col(order) + 1).alias(order), key.alias("prior"))
    return edges.join(prior, order).filter(F.col("prior") > key).drop("prior")


def merged(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Base and overlay as a bag."""
    return base.unionByName(overlay)
