"""Registered queries over graphs: scans, adjacency, waves and subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.catalog import sqltext as S
from tidegraph.catalog.pipeline import STATE_SQL, p5_edges
from tidegraph.functions.hashing import quantized
from tidegraph.functions.relation import type_names
from tidegraph.functions.text import edge_type_name
from tidegraph.operators import edges as E
from tidegraph.operators import subgraph, wave
from tidegraph.operators.paths import relations
from tidegraph.plans.lineage import cut
from tidegraph.sources.graph import durable_edges, durable_records, node, order_edges, order_records, ring_graph, typed_graph
from tidegraph.sources.tables import table

#: The stated query set of searches: every row whose id is divisible by this, against all rows.
EVERY = 100


def order_seeds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").filter(F.col("c_custkey") % EVERY == 0).select(node("customer", "c_custkey").alias("node_id"))


def receipt_seeds(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "wave_query_receipt").filter(F.col("receipt_id") % EVERY == 0)
    return rows.select(F.explode("seed_nodes").alias("node_id")).filter("node_id >= 0").distinct()


def every_receipt_seed(spark: SparkSession, d: str) -> DataFrame:
    """The seeds of all receipts."""
    return table(spark, d, "wave_query_receipt").select(F.explode("seed_nodes").alias("node_id")).filter("node_id >= 0").distinct()


def hop_wave_orders(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: from customers over their orders to parts and suppliers, 50 best nodes."""
    return wave.hop_wave(order_edges(spark, d, {5, 7, 8}), order_seeds(spark, d), 3, 0.05, 50, (5, 7, 8))


def hop_wave_1(spark: SparkSession, d: str) -> DataFrame:
    """One hop from receipts' seeds over the durable graph, all types."""
    return wave.hop_wave(durable_edges(spark, d), receipt_seeds(spark, d), 1, 0.1, 1000)


def hop_wave_per_seed(spark: SparkSession, d: str) -> DataFrame:
    """Three hops from each receipt seed on its own, 10 best nodes each."""
    seeds = receipt_seeds(spark, d).withColumn("seed", F.col("node_id"))
    return wave.hop_wave(durable_edges(spark, d), seeds, 3, 0.2, 10, (1, 2, 3, 4, 5), ["seed"])


def hop_wave_held(spark: SparkSession, d: str) -> DataFrame:
    """The same with the graph held by the workers."""
    seeds = receipt_seeds(spark, d)
    return wave.held_waves(durable_edges(spark, d), seeds, 3, 0.2, 10, (1, 2, 3, 4, 5))


def hop_wave_energies(spark: SparkSession, d: str) -> DataFrame:
    """All energies of a wave over the whole order graph, two hops, all types but blocking ones."""
    rows = wave.hop_wave(order_edges(spark, d), order_seeds(spark, d), 2, 0.3, None, tuple(range(1, 10)))
    return rows.select("node_id", "energy", "hop", "rank")


def hop_wave_mask_bits(spark: SparkSession, d: str) -> DataFrame:
    """Edges per type that a mask of bits lets through."""
    rows = durable_edges(spark, d).filter(E.in_mask_bits(F.col("edge_type"), (1 << 4) | (1 << 5) | (1 << 7)))
    return rows.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n_edges"))


def best_first_per_seed(spark: SparkSession, d: str) -> DataFrame:
    """Best-first waves from receipts' seeds, with a step limit that can't bind at this threshold."""
    rows = wave.best_first(durable_edges(spark, d), receipt_seeds(spark, d), 5, 0.25, None, (1, 3, 4))
    return rows.select("seed", "node_id", "energy")


def best_first_topk(spark: SparkSession, d: str) -> DataFrame:
    """Best-first waves of three steps from every receipt's seeds with 10 nodes per seed, paths as text."""
    rows = wave.best_first(durable_edges(spark, d), every_receipt_seed(spark, d), 3, 0.07, 10, (4, 5, 7))
    return rows.select("seed", "node_id", "energy", F.array_join(F.col("best_path").cast("array<string>"), ">").alias("path"))


def best_first_merged(spark: SparkSession, d: str) -> DataFrame:
    """Waves of all seeds as one, 20 best nodes."""
    return wave.merged_wave(durable_edges(spark, d), receipt_seeds(spark, d), 5, 0.25, 20, (1, 3, 4)).select("node_id", "energy", "rank")


def best_first_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counters of each seed's search."""
    return wave.best_first(durable_edges(spark, d), receipt_seeds(spark, d), 3, 0.07, 32, (4, 5, 7), stats=True)


def wave_scope_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Records in reach of every receipt's seeds with the types that link them directly."""
    rows = wave.wave_scope(durable_edges(spark, d), durable_records(spark, d, ("logical_id", "node_id")), every_receipt_seed(spark, d), 3, 0.05, 256, (1, 2, 3, 4, 5))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return rows.select("anchor", "record_id", "node_id", "energy", text("best_path"), text("direct_out"), text("direct_in"))


def wave_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations that the paths of waves derive, counted."""
    rows = wave.best_first(durable_edges(spark, d), receipt_seeds(spark, d), 3, 0.05, 64, tuple(range(1, 10)))
    got = relations(rows.withColumn("edge_types", type_names(F.col("best_path"))))
    return got.groupBy("relation", "blocked").agg(F.count(F.lit(1)).alias("n_rows"))


def compact_edges(spark: SparkSession, d: str) -> DataFrame:
    """Durable edges in fixed point; blocking ones as type 255."""
    rows = durable_edges(spark, d)
    kind = F.when(F.col("edge_type") == 10, 255).otherwise(F.col("edge_type"))
    return rows.select("src", "dst", kind.alias("edge_type"), quantized(F.col("weight")).cast("long").alias("attenuation"))


def saturating_recall(spark: SparkSession, d: str) -> DataFrame:
    """Fixed-point wave from receipts' seeds, 100 best fired nodes."""
    return wave.saturating_recall(compact_edges(spark, d), receipt_seeds(spark, d), 20_000, 100, 3)


def sum_wave(spark: SparkSession, d: str) -> DataFrame:
    """Wave that adds energies up, over the order graph."""
    rows = wave.sum_wave(order_edges(spark, d, {5, 7, 8}), order_seeds(spark, d), 3, 0.1, 100)
    return rows.select("node_id", F.round("energy", 8).alias("energy"), "rank")


def edges_both(spark: SparkSession, d: str) -> DataFrame:
    """Edges in either direction at the nodes divisible by 100, once per type and weight in millionths."""
    rows = durable_edges(spark, d)
    nodes = rows.select(F.explode(F.array("src", "dst")).alias("node_id")).filter(F.col("node_id") % EVERY == 0)
    return E.edges_of(rows, nodes, "both")


def node_degrees(spark: SparkSession, d: str) -> DataFrame:
    return E.degrees(durable_edges(spark, d))


def csr_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every edge with its place in the order of (src, edge_type, dst, weight, logical_id)."""
    order = [F.col(c) for c in ("src", "edge_type", "dst", "weight", "logical_id")]
    return wave.ranked(durable_edges(spark, d), order, None).select("src", "dst", "edge_type", "logical_id", (F.col("rank") - 1).alias("edge_index"))


def csr_nodes(spark: SparkSession, d: str) -> DataFrame:
    """First edge and number of edges of each source."""
    return csr_edges(spark, d).groupBy("src").agg(F.min("edge_index").alias("first_edge"), F.count(F.lit(1)).alias("n_edges"))


def order_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of every order as a text in stored order."""
    rows = E.adjacency(order_edges(spark, d, {4, 5}).filter(F.col("src") >= 6_000_000_000))
    item = F.transform("edges", lambda e: F.concat_ws(":", e["edge_type"].cast("string"), e["dst"].cast("string")))
    return rows.select("src", "degree", F.array_join(item, ",").alias("edges"))


def open_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the order graph by type, without blocking ones and those they close."""
    return E.without_blocked(order_edges(spark, d)).groupBy(edge_type_name(F.col("edge_type")).alias("edge_type")).agg(F.count(F.lit(1)).alias("n_edges"))


def induced_edges(spark: SparkSession, d: str) -> DataFrame:
    """Durable edges between nodes that current records stand for."""
    return E.induced(durable_edges(spark, d), durable_records(spark, d).filter("node_id IS NOT NULL")).select("logical_id", "src", "dst", "edge_type")


def unresolved_edges(spark: SparkSession, d: str) -> DataFrame:
    """Durable edges with an end that no current record stands for."""
    return E.unresolved_ends(durable_edges(spark, d), durable_records(spark, d)).select("logical_id", "src", "dst")


def merged_edges(spark: SparkSession, d: str) -> DataFrame:
    """Durable edges and those of the write-ahead log as a set, by origin."""
    base = durable_edges(spark, d).select("src", "dst", "edge_type", F.round(F.col("weight") * 1_000_000).cast("long").alias("weight_million"))
    overlay = p5_edges(spark, d).select("src", "dst", F.col("edge_type").cast("int").alias("edge_type"), "weight_million")
    return E.merged(base, overlay).distinct().groupBy("edge_type").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("weight_million").alias("sum_weight"))


def order_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Records of the order graph with their degrees."""
    deg = E.degrees(order_edges(spark, d, {4, 8}))
    return order_records(spark, d).join(deg, "node_id", "left").select("record_id", "node_id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def synthetic_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the synthetic graphs by type."""
    a = ring_graph(spark, 5000).withColumn("graph", F.lit("ring"))
    b = typed_graph(spark, 20000).withColumn("graph", F.lit("typed"))
    return a.unionByName(b).groupBy("graph", "edge_type").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("dst").alias("sum_dst"))


def floating_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """Bounded parts around every receipt's seeds, best 32 nodes each, written as streams and read back."""
    edges = cut(durable_edges(spark, d))
    nodes = subgraph.grow(edges, every_receipt_seed(spark, d), 3, 0.1, 32, (1, 2, 3, 4, 5))
    got = subgraph.decode(subgraph.export(nodes, edges))
    return got.select("root", F.size("content.nodes").alias("n_nodes"), F.size("content.edges").alias("n_edges"), F.coalesce("problem", F.lit("")).alias("problem"))


def wave_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """Edges between all nodes that waves reach."""
    edges = cut(durable_edges(spark, d))
    _, inner = subgraph.around(edges, receipt_seeds(spark, d), 5, 0.25, (1, 3, 4))
    return inner.select("logical_id", "src", "dst", "edge_type")


_FUNCTIONS = (
    hop_wave_orders, hop_wave_1, hop_wave_per_seed, hop_wave_held, hop_wave_energies, hop_wave_mask_bits, best_first_per_seed, best_first_topk, best_first_merged,
    best_first_stats, wave_scope_evidence, wave_relations, saturating_recall, sum_wave, edges_both, node_degrees, csr_edges, csr_nodes, order_adjacency, open_edges,
    induced_edges, unresolved_edges, merged_edges, order_nodes, synthetic_edges, floating_subgraph, wave_subgraph,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_ORDER_SEEDS = f"SELECT CAST(3000000000 + c_custkey AS BIGINT) AS node_id FROM customer WHERE c_custkey % {EVERY} = 0"
_RECEIPT_SEEDS = f"SELECT DISTINCT node_id FROM (SELECT unnest(seed_nodes) AS node_id FROM wave_query_receipt WHERE receipt_id % {EVERY} = 0) WHERE node_id >= 0"
_OWN_SEEDS = f"SELECT node_id AS seed, node_id FROM ({_RECEIPT_SEEDS})"


def _best(part: str, theta: float) -> str:
    return f"b AS (SELECT * FROM lv QUALIFY row_number() OVER (PARTITION BY {part} ORDER BY energy DESC, hop, predecessor, edge_type) = 1)"


_FIRST = (
    f"WITH {S.durable_edges()},\n{S.attenuated('e')},\n"
    + S.wave("a", _OWN_SEEDS, 5, 0.25, (1, 3, 4), "seed", factor="((f.energy * e.att) * e.w0) * CAST(1.0 AS DOUBLE)")
    + ",\nb AS (SELECT seed, node_id, max(energy) AS energy FROM lv GROUP BY 1, 2)\n"
)
_STEPS = ["c0 AS (SELECT node_id, 65535 AS energy FROM (" + _RECEIPT_SEEDS + ")), best0 AS (SELECT * FROM c0), fired0 AS (SELECT * FROM c0 WHERE false)"]
for _h in range(1, 4):
    _p = _h - 1
    _STEPS.append(f"""g{_h} AS (SELECT * FROM c{_p} WHERE energy >= 20000 AND node_id NOT IN (SELECT node_id FROM fired{_p})),
fired{_h} AS (SELECT * FROM fired{_p} UNION ALL SELECT * FROM g{_h}),
t{_h} AS (SELECT e.dst AS node_id, least(sum((g.energy * e.attenuation) >> 8), 65535) AS energy FROM g{_h} g JOIN k e ON g.node_id = e.src WHERE (g.energy * e.attenuation) >> 8 >= 20000 GROUP BY 1),
c{_h} AS (SELECT t.node_id, CAST(t.energy AS BIGINT) AS energy FROM t{_h} t LEFT JOIN best{_p} b ON t.node_id = b.node_id WHERE t.energy > coalesce(b.energy, 0)),
best{_h} AS (SELECT node_id, max(energy) AS energy FROM (SELECT * FROM best{_p} UNION ALL SELECT * FROM c{_h}) GROUP BY 1)""")

SQL = {
    "hop_wave_orders": f"WITH {S.order_edges({5, 7, 8})},\n{S.wave('e', _ORDER_SEEDS, 3, 0.05, (5, 7, 8))},\n{_best('node_id', 0.05)}\n"
    "SELECT *, row_number() OVER (ORDER BY energy DESC, node_id) AS rank FROM b ORDER BY energy DESC, node_id LIMIT 50",
    "hop_wave_1": f"WITH {S.durable_edges()},\n{S.wave('e', _RECEIPT_SEEDS, 1, 0.1, None)},\n{_best('node_id', 0.1)}\n"
    "SELECT *, row_number() OVER (ORDER BY energy DESC, node_id) AS rank FROM b ORDER BY energy DESC, node_id LIMIT 1000",
    "hop_wave_per_seed": f"WITH {S.durable_edges()},\n{S.wave('e', _OWN_SEEDS, 3, 0.2, (1, 2, 3, 4, 5), 'seed')},\n{_best('seed, node_id', 0.2)}\n"
    "SELECT *, row_number() OVER (PARTITION BY seed ORDER BY energy DESC, node_id) AS rank FROM b QUALIFY rank <= 10",
    "hop_wave_energies": f"WITH {S.order_edges()},\n{S.wave('e', _ORDER_SEEDS, 2, 0.3, tuple(range(1, 10)))},\n{_best('node_id', 0.3)}\n"
    "SELECT node_id, energy, hop, row_number() OVER (ORDER BY energy DESC, node_id) AS rank FROM b",
    "hop_wave_mask_bits": f"WITH {S.durable_edges()} SELECT edge_type, count(*) AS n_edges FROM e WHERE ((1 << (edge_type % 31)) & 176) <> 0 GROUP BY 1",
    "best_first_per_seed": _FIRST + "SELECT seed, node_id, round(energy, 12) AS energy FROM b",
    "best_first_merged": _FIRST
    + "SELECT node_id, max(round(energy, 12)) AS energy, row_number() OVER (ORDER BY max(round(energy, 12)) DESC, min(hop), node_id) AS rank FROM (SELECT b.*, l.hop FROM b JOIN lv l ON b.seed = l.seed AND b.node_id = l.node_id AND b.energy = l.energy) GROUP BY node_id QUALIFY rank <= 20",
    "saturating_recall": f"WITH {S.durable_edges()},\nk AS (SELECT src, dst, CAST(greatest(0, least(255, round_even(weight * 255.0, 0))) AS BIGINT) AS attenuation FROM e WHERE edge_type <> 10),\n"
    + ",\n".join(_STEPS)
    + "\nSELECT node_id, CAST(energy AS BIGINT) AS energy, row_number() OVER (ORDER BY energy DESC, node_id) AS rank FROM fired3 QUALIFY rank <= 100",
    "sum_wave": f"WITH {S.order_edges({5, 7, 8})},\n{S.wave('e', _ORDER_SEEDS, 3, 0.1, None, combine='sum')}\n"
    "SELECT node_id, round(energy, 8) AS energy, row_number() OVER (ORDER BY energy DESC, node_id) AS rank FROM (SELECT node_id, round(max(energy), 12) AS energy FROM lv GROUP BY 1) QUALIFY rank <= 100",
    "edges_both": f"WITH {S.durable_edges()} SELECT DISTINCT src, dst, edge_type, CAST(round(weight * 1000000) AS BIGINT) AS weight_million FROM e WHERE src % {EVERY} = 0 OR dst % {EVERY} = 0",
    "node_degrees": f"WITH {S.durable_edges()} SELECT n AS node_id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS n, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1",
    "csr_edges": f"WITH {S.durable_edges()} SELECT src, dst, edge_type, logical_id, row_number() OVER (ORDER BY src, edge_type, dst, weight, logical_id) - 1 AS edge_index FROM e",
    "csr_nodes": f"WITH {S.durable_edges()}, i AS (SELECT src, row_number() OVER (ORDER BY src, edge_type, dst, weight, logical_id) - 1 AS x FROM e) SELECT src, min(x) AS first_edge, count(*) AS n_edges FROM i GROUP BY 1",
    "order_adjacency": f"WITH {S.order_edges({4, 5})} SELECT src, count(*) AS degree, string_agg(edge_type || ':' || dst, ',' ORDER BY edge_type, dst, weight) AS edges FROM e WHERE src >= 6000000000 GROUP BY 1",
    "open_edges": f"WITH {S.order_edges()},\n{S.attenuated('e')} SELECT CASE edge_type WHEN 1 THEN 'UP_RULE' WHEN 2 THEN 'DOWN_EVIDENCE' WHEN 3 THEN 'LATERAL_SIMILAR_CASE' WHEN 4 THEN 'PROJECT_CONTEXT' WHEN 5 THEN 'CODE_PATTERN' WHEN 6 THEN 'RULE_TO_EVIDENCE' WHEN 7 THEN 'RULE_TO_CODE_PATTERN' WHEN 8 THEN 'PROJECT_TO_RECENT_SEED' ELSE 'CODE_TO_RECENT_RULE' END AS edge_type, count(*) AS n_edges FROM a GROUP BY 1",
    "induced_edges": f"WITH {S.durable_edges()}, {S.durable_records()} SELECT logical_id, src, dst, edge_type FROM e WHERE src IN (SELECT node_id FROM r WHERE node_id IS NOT NULL) AND dst IN (SELECT node_id FROM r WHERE node_id IS NOT NULL)",
    "unresolved_edges": f"WITH {S.durable_edges()}, {S.durable_records()} SELECT logical_id, src, dst FROM e WHERE src NOT IN (SELECT node_id FROM r WHERE node_id IS NOT NULL) OR dst NOT IN (SELECT node_id FROM r WHERE node_id IS NOT NULL)",
    "merged_edges": STATE_SQL.replace("WITH w AS", f"WITH {S.durable_edges()},\nw AS", 1)
    + """, u AS (SELECT src, dst, edge_type, CAST(round(weight * 1000000) AS BIGINT) AS weight_million FROM e UNION SELECT src, dst, CAST(edge_type AS INTEGER), weight_million FROM l WHERE kind = 'PUT_EDGE')
SELECT edge_type, count(*) AS n_edges, CAST(sum(weight_million) AS BIGINT) AS sum_weight FROM u GROUP BY 1""",
    "order_nodes": f"WITH {S.order_edges({4, 8})},\nn AS (" + " UNION ALL ".join(f"SELECT '{t}:' || {k} AS record_id, CAST({i}000000000 + {k} AS BIGINT) AS node_id FROM {t}" for i, (t, k) in enumerate((("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey")), 1))
    + "),\no AS (SELECT src AS n, count(*) AS c FROM e GROUP BY 1), i AS (SELECT dst AS n, count(*) AS c FROM e GROUP BY 1)\nSELECT n.record_id, n.node_id, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) AS in_degree FROM n LEFT JOIN o ON n.node_id = o.n LEFT JOIN i ON n.node_id = i.n",
    "synthetic_edges": """WITH k AS (SELECT i FROM range(5000) t(i)), n AS (SELECT i FROM range(5000) t(i)),
r AS (SELECT 'ring' AS graph, 1 AS edge_type, (i + 1) % 5000 + 1 AS dst FROM k UNION ALL SELECT 'ring', 2, (i + 7) % 5000 + 1 FROM k UNION ALL SELECT 'ring', 3, (17 * i + 11) % 5000 + 1 FROM k),
t AS (SELECT 'typed' AS graph, 4 AS edge_type, (i + 1) % 5000 AS dst FROM n UNION ALL SELECT 'typed', 5, (17 * i + 13) % 5000 FROM n
  UNION ALL SELECT 'typed', CASE WHEN i <> i // 4 THEN 1 ELSE 3 END, CASE WHEN i <> i // 4 THEN i // 4 ELSE (i + 7) % 5000 END FROM n
  UNION ALL SELECT 'typed', 2, i FROM n UNION ALL SELECT 'typed', 10, (17 * i + 13) % 5000 FROM n WHERE i % 97 = 0)
SELECT graph, edge_type, count(*) AS n_edges, CAST(sum(dst) AS BIGINT) AS sum_dst FROM (SELECT * FROM r UNION ALL SELECT * FROM t) GROUP BY 1, 2""",
    "wave_subgraph": _FIRST + "SELECT logical_id, src, dst, edge_type FROM e WHERE src IN (SELECT node_id FROM b) AND dst IN (SELECT node_id FROM b)",
}
SQL["hop_wave_held"] = SQL["hop_wave_per_seed"]
