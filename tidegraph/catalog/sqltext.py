"""Pieces of SQL that the checks of several queries share."""

from __future__ import annotations

from tidegraph.config import ATTENUATION
from tidegraph.sources.graph import NAMESPACES, SPACE


def _node(namespace: str, key: str) -> str:
    return f"CAST({NAMESPACES[namespace] * SPACE} + {key} AS BIGINT)"


_ORDER_PARTS = [
    (1, _node("nation", "n_nationkey"), _node("region", "n_regionkey"), "0.92", "nation"),
    (2, _node("region", "n_regionkey"), _node("nation", "n_nationkey"), "0.70", "nation"),
    (4, _node("customer", "c_custkey"), _node("nation", "c_nationkey"), "1.0", "customer"),
    (8, _node("nation", "c_nationkey"), _node("customer", "c_custkey"), "0.36", "customer"),
    (4, _node("orders", "o_orderkey"), _node("customer", "o_custkey"), "0.90", "orders"),
    (8, _node("customer", "o_custkey"), _node("orders", "o_orderkey"), "CASE left(o_orderpriority, 1) WHEN '1' THEN 0.95 WHEN '2' THEN 0.85 WHEN '3' THEN 0.75 WHEN '4' THEN 0.65 ELSE 0.55 END", "orders"),
    (5, _node("orders", "l_orderkey"), _node("part", "l_partkey"), "1 - (l_discount + 0.0)", "lineitem"),
    (9, _node("part", "l_partkey"), _node("orders", "l_orderkey"), "0.55", "lineitem"),
    (7, _node("part", "l_partkey"), _node("supplier", "l_suppkey"), "0.86", "lineitem"),
    (6, _node("supplier", "l_suppkey"), _node("part", "l_partkey"), "1 - (l_tax + 0.0)", "lineitem"),
    (3, _node("supplier", "s_suppkey"), _node("nation", "s_nationkey"), "0.61", "supplier"),
    (10, _node("orders", "l_orderkey"), _node("part", "l_partkey"), "1.0", "lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.09"),
]


def order_edges(types: set[int] | None = None, name: str = "e") -> str:
    """A CTE of the order graph's edges."""
    parts = [f"SELECT {s} AS src, {d} AS dst, {t} AS edge_type, CAST({w} AS DOUBLE) AS weight FROM {f}" for t, s, d, w, f in _ORDER_PARTS if types is None or t in types]
    return f"{name} AS (\n  " + "\n  UNION ".join(parts) + ")"


def durable_edges(name: str = "e") -> str:
    return f"""{name} AS (SELECT logical_id, src, dst, edge_type, weight + 0.0 AS weight FROM durable_edge
  WHERE src >= 0 AND dst >= 0 AND edge_type IS NOT NULL AND weight IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY logical_id ORDER BY arrived_at DESC, src DESC, dst DESC, edge_type DESC, weight + 0.0 DESC) = 1)"""


def durable_records(name: str = "r") -> str:
    return f"""{name} AS (SELECT record_id, logical_id, node_id, payload, payload_sha256 FROM (SELECT *, max(deleted_at) OVER (PARTITION BY record_id) AS gone FROM durable_record
  WHERE record_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY arrived_at DESC, logical_id DESC) = 1) WHERE gone IS NULL)"""


def attenuated(source: str, name: str = "a", profile: str = "default") -> str:
    """Reduced edges: attenuation times weight, without blocking edges and closed pairs."""
    case = " ".join(f"WHEN {i + 1} THEN {x!r}" for i, x in enumerate(ATTENUATION[profile]))
    return f"""{name} AS (SELECT src, dst, edge_type, CAST(CASE edge_type {case} ELSE 0 END AS DOUBLE) * weight * CAST(1.0 AS DOUBLE) AS weight, CAST(CASE edge_type {case} ELSE 0 END AS DOUBLE) AS att, weight AS w0
  FROM {source} x WHERE edge_type <> 10 AND NOT EXISTS (SELECT 1 FROM {source} b WHERE b.edge_type = 10 AND b.src = x.src AND b.dst = x.dst))"""


def wave(edges: str, seeds: str, steps: int, theta: float, mask: tuple[int, ...] | None, group: str | None = None, combine: str = "max", factor: str = "f.energy * e.weight") -> str:
    """CTEs l0..l<steps> and ``lv``: (group, node_id, energy, hop, predecessor, edge_type) per hop. ``seeds`` selects (group, node_id)."""
    g = f"{group}, " if group else ""
    fg = f"f.{group}, " if group else ""
    out = [f"l0 AS (SELECT DISTINCT {g}node_id, CAST(1.0 AS DOUBLE) AS energy, 0 AS hop, CAST(-1 AS BIGINT) AS predecessor, 0 AS edge_type FROM ({seeds}))"]
    inside = f" AND e.edge_type IN ({', '.join(map(str, mask))})" if mask else ""
    part = f"{group}, node_id" if group else "node_id"
    for h in range(1, steps + 1):
        step = f"SELECT {fg}e.dst AS node_id, {factor} AS energy, {h} AS hop, e.src AS predecessor, e.edge_type FROM l{h - 1} f JOIN {edges} e ON f.node_id = e.src WHERE {factor} >= {theta}{inside}"
        if combine == "max":
            out.append(f"l{h} AS (SELECT * FROM ({step}) QUALIFY row_number() OVER (PARTITION BY {part} ORDER BY energy DESC, predecessor, edge_type) = 1)")
        else:
            out.append(f"l{h} AS (SELECT {g}node_id, sum(energy) AS energy, {h} AS hop, min(predecessor) AS predecessor, min(edge_type) AS edge_type FROM ({step}) GROUP BY {part})")
    out.append("lv AS (" + " UNION ALL ".join(f"SELECT * FROM l{h}" for h in range(steps + 1)) + ")")
    return ",\n".join(out)
