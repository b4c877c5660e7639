"""Registered queries p1, p2, p3 and p5, for training-data pipelines, over the record, edge and ledger tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators import changefeed, frequency, hierarchy, orphans
from tidegraph.plans.lineage import cut
from tidegraph.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs (src, edge_type) that hold at least one hundredth of all rows of durable_edge."""
    edges = table(spark, d, "durable_edge").select("src", "edge_type", "weight")
    got = frequency.heavy_hitters(edges, ["src", "edge_type"], "weight", one_in=100)
    return got.filter("src >= 0").select("src", "edge_type")


def p1_weight_summary(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct weights, mode and exact percentiles of the weight for each src and edge_type."""
    return frequency.summarize(table(spark, d, "durable_edge"), ["src", "edge_type"], "weight", (0.1, 0.5, 0.9))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Events on cycles, and (event, root, depth) of those 12 or more links below a root."""
    rows = hierarchy.hierarchy(table(spark, d, "provenance_event"), "provenance_id", "parent_provenance_ids")
    return rows.filter("depth = -1 OR depth >= 12")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """For each event and each of its roots: depth, the shortest path from the root, and the object_id of every step."""
    events = table(spark, d, "provenance_event")
    rows = hierarchy.hierarchy(events, "provenance_id", "parent_provenance_ids", with_path=True)
    steps = rows.select("provenance_id", "root_id", F.posexplode("path").alias("pos", "node")).join(hierarchy.latest_object(events), "node", "left")
    objects = steps.groupBy("provenance_id", "root_id").agg(F.array_sort(F.collect_list(F.struct("pos", "object_id"))).alias("s"))
    objects = objects.select("provenance_id", "root_id", F.transform("s", lambda x: F.coalesce(x["object_id"], F.lit(""))).alias("objects"))
    out = rows.join(objects, ["provenance_id", "root_id"], "left")
    return out.select("provenance_id", "root_id", "depth", F.array_join("path", ">").alias("path"), F.array_join("objects", ">").alias("object_path"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every event off cycles with each of its descendants and the smallest number of links between them."""
    nodes, links = hierarchy.clean_links(table(spark, d, "provenance_event"), "provenance_id", "parent_provenance_ids")
    return hierarchy.descendants(hierarchy.peel(nodes, links).links).withColumnRenamed("node", "provenance_id")


def p2_subtree_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Number of descendants and height of every event that has any."""
    rows = p2_descendants(spark, d)
    return rows.groupBy("provenance_id").agg(F.count(F.lit(1)).alias("n_descendants"), F.max("distance").alias("height"))


def unresolved_references(spark: SparkSession, d: str) -> DataFrame:
    """References of durable_edge and evidence_ref that name nothing live at their moment."""
    edges, evidence = table(spark, d, "durable_edge"), table(spark, d, "evidence_ref")
    ends = {c: F.when(F.col(c) >= 0, F.col(c)) for c in ("src", "dst")}
    refs = orphans.first_deliveries(edges, "logical_id", ends, "arrived_at")
    nodes = orphans.lifetimes(table(spark, d, "durable_record"), F.col("node_id"), F.col("record_id"), "arrived_at", "deleted_at")
    a = orphans.orphans(refs, nodes, {c: [(c, "key")] for c in ends}, "simple", "ref_key", "moment").withColumn("ref_table", F.lit("durable_edge"))
    refs = orphans.first_deliveries(evidence, "evidence_id", {"provenance_id": hierarchy.clean_id("provenance_id")}, "arrived_at")
    events = table(spark, d, "provenance_event").select(hierarchy.clean_id("provenance_id").alias("k"), "arrived_at")
    events = orphans.lifetimes(events, F.col("k"), F.lit(0), "arrived_at")
    b = orphans.orphans(refs, events, {"provenance_id": [("provenance_id", "key")]}, "simple", "ref_key", "moment").withColumn("ref_table", F.lit("evidence_ref"))
    day = F.date_format("moment", "yyyy-MM-dd").alias("ref_day")
    columns = ["ref_table", "ref_column", "ref_key", "reason", day]
    return a.select(*columns).union(b.select(*columns))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per unresolved reference."""
    return unresolved_references(spark, d)


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Unresolved references counted per table, column, reason and day."""
    keys = ["ref_table", "ref_column", "reason", "ref_day"]
    return unresolved_references(spark, d).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_refs"))


def p3_composite_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose (src, dst), by partial match of the non-null part, names no pair of any other edge type 1 edge."""
    edges = table(spark, d, "durable_edge").select("logical_id", "src", "dst")
    targets = table(spark, d, "durable_edge").filter("edge_type = 1").select("src", "dst")
    got = orphans.orphans(edges, targets, [("src", "src"), ("dst", "dst")], "partial", "logical_id")
    return got.groupBy("null_mask").agg(F.count(F.lit(1)).alias("n_refs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The records and edges that exist at the end, with the lsn of the put that wrote each last."""
    return changefeed.replay(table(spark, d, "wal_frame")).filter("NOT is_deleted").select("entity", "lsn")


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """Current records with node and body."""
    got = changefeed.replay(table(spark, d, "wal_frame")).filter("NOT is_deleted AND entity LIKE 'r:%'")
    return got.select("record_id", "node_id", "body", "commit_lsn", "lsn")


def p5_edges(spark: SparkSession, d: str) -> DataFrame:
    """Current edges."""
    got = changefeed.replay(table(spark, d, "wal_frame")).filter("NOT is_deleted AND entity LIKE 'e:%'")
    return got.select("src", "dst", "edge_type", "weight_million", "lsn")


def p5_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Status of every transaction of the feed."""
    got = changefeed.transactions(changefeed.whole_frames(table(spark, d, "wal_frame")))
    return got.select("txn", "commit_lsn", "status", "n_ops")


def p5_late_changes(spark: SparkSession, d: str) -> DataFrame:
    """The final state where every other transaction arrives only after a state was kept, tombstones and all: its
    changes are folded into that base, though many are older than what they meet there."""
    changes = changefeed.effective_changes(table(spark, d, "wal_frame")).withColumn("entity", changefeed.entity())
    fold = lambda some, base: changefeed.fold(some, ["entity"], ["commit_lsn", "lsn"], F.col("kind").startswith("DELETE"), ["record_id"], base)
    changes = cut(changes)
    base = fold(changes.filter("commit_lsn % 2 = 0"), None)
    return fold(changes.filter("commit_lsn % 2 = 1"), base).filter("NOT is_deleted").select("entity", "lsn")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_weight_summary, p2_found, p2_paths, p2_descendants, p2_subtree_sizes, p3_found, p3_counts, p3_composite_orphans,
        p5_found, p5_records, p5_edges, p5_transactions, p5_late_changes,
    )
}

_NODE_SPANS = """spans AS (SELECT node_id AS k, record_id, min(arrived_at) AS b, coalesce(min(deleted_at), TIMESTAMP '9999-12-31') AS e
  FROM durable_record WHERE node_id IS NOT NULL GROUP BY 1, 2)"""
_UNRESOLVED = f"""WITH {_NODE_SPANS},
e AS (SELECT logical_id, min(arrived_at) AS m, any_value(src) AS src, any_value(dst) AS dst FROM durable_edge GROUP BY 1),
r AS (SELECT 'durable_edge' AS ref_table, 'src' AS ref_column, CAST(logical_id AS VARCHAR) AS ref_key, src AS k, m FROM e WHERE src >= 0
  UNION ALL SELECT 'durable_edge', 'dst', CAST(logical_id AS VARCHAR), dst, m FROM e WHERE dst >= 0),
n AS (SELECT r.ref_table, r.ref_column, r.ref_key, r.m, count(s.k) AS known, count(*) FILTER (s.b <= r.m AND r.m < s.e) AS live,
  count(*) FILTER (s.b < s.e AND s.b <= r.m) AS earlier FROM r LEFT JOIN spans s ON r.k = s.k GROUP BY 1, 2, 3, 4),
v AS (SELECT evidence_id, min(arrived_at) AS m, any_value(lower(trim(provenance_id, E' \\t\\n\\r'))) AS k FROM evidence_ref
  WHERE trim(provenance_id, E' \\t\\n\\r') <> '' GROUP BY 1),
p AS (SELECT lower(trim(provenance_id, E' \\t\\n\\r')) AS k, min(arrived_at) AS b FROM provenance_event GROUP BY 1),
u AS (SELECT ref_table, ref_column, ref_key, CASE WHEN known = 0 THEN 'missing' WHEN earlier > 0 THEN 'deleted' ELSE 'late' END AS reason, m
  FROM n WHERE live = 0
  UNION ALL SELECT 'evidence_ref', 'provenance_id', v.evidence_id, CASE WHEN p.k IS NULL THEN 'missing' ELSE 'late' END, v.m
  FROM v LEFT JOIN p ON v.k = p.k WHERE p.k IS NULL OR p.b > v.m)
"""
STATE_SQL = """WITH w AS (SELECT lsn, upper(trim(frame_type)) AS kind, lower(trim(transaction_id)) AS txn, try(decode(payload)) AS t FROM wal_frame WHERE lsn IS NOT NULL),
f AS (SELECT lsn, kind, txn, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM w
  QUALIFY row_number() OVER (PARTITION BY lsn ORDER BY coalesce(json_valid(t), false) DESC) = 1),
c AS (SELECT txn, min(lsn) AS commit_lsn FROM f WHERE kind = 'COMMIT' GROUP BY 1),
a AS (SELECT txn, min(lsn) AS abort_lsn FROM f WHERE kind = 'ABORT' GROUP BY 1),
o AS (SELECT f.*, c.commit_lsn FROM f LEFT JOIN c ON f.txn = c.txn WHERE kind IN ('PUT_RECORD', 'PUT_EDGE', 'DELETE_RECORD', 'DELETE_EDGE')),
k AS (SELECT txn, count(*) FILTER (lsn < commit_lsn) AS n_ops FROM o GROUP BY 1),
t AS (SELECT x.txn, c.commit_lsn, CASE WHEN a.abort_lsn IS NOT NULL AND (c.commit_lsn IS NULL OR a.abort_lsn < c.commit_lsn) THEN 'ABORTED'
  WHEN c.commit_lsn IS NULL THEN 'OPEN' WHEN coalesce(k.n_ops, 0) = CAST(g.j->>'op_count' AS BIGINT) THEN 'COMMITTED' ELSE 'SHORT' END AS status,
  coalesce(k.n_ops, 0) AS n_ops
  FROM (SELECT DISTINCT txn FROM f WHERE txn IS NOT NULL AND kind <> 'CHECKPOINT') x LEFT JOIN c ON x.txn = c.txn LEFT JOIN a ON x.txn = a.txn
  LEFT JOIN k ON x.txn = k.txn LEFT JOIN f g ON g.lsn = c.commit_lsn),
s AS (SELECT o.lsn, o.commit_lsn, o.kind, o.j->>'record_id' AS record_id, CAST(o.j->>'node_id' AS BIGINT) AS node_id, o.j->>'body' AS body,
  CAST(o.j->>'src' AS BIGINT) AS src, CAST(o.j->>'dst' AS BIGINT) AS dst, CAST(o.j->>'edge_type' AS BIGINT) AS edge_type,
  CAST(o.j->>'weight_million' AS BIGINT) AS weight_million
  FROM o JOIN t ON o.txn = t.txn WHERE t.status = 'COMMITTED' AND o.lsn < o.commit_lsn),
z AS (SELECT *, CASE WHEN kind LIKE '%RECORD' THEN 'r:' || record_id
  ELSE 'e:' || src || ':' || dst || ':' || edge_type || ':' || weight_million END AS entity FROM s),
l AS (SELECT * FROM z WHERE entity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity ORDER BY commit_lsn DESC, lsn DESC) = 1)
"""

TREE_SQL = """WITH RECURSIVE ev AS (SELECT nullif(lower(trim(provenance_id, E' \\t\\n\\r')), '') AS node, parent_provenance_ids AS ps FROM provenance_event),
n AS (SELECT DISTINCT node FROM ev WHERE node IS NOT NULL),
l AS (SELECT DISTINCT node, p AS parent FROM (SELECT node, lower(trim(unnest(ps), E' \\t\\n\\r')) AS p FROM ev WHERE node IS NOT NULL) WHERE p IN (SELECT node FROM n)),
reach(a, b) AS (SELECT node, parent FROM l UNION SELECT r.a, l.parent FROM reach r JOIN l ON r.b = l.node),
cyc AS (SELECT r.a AS node, min(r.b) AS root_id FROM reach r JOIN reach s ON r.a = s.b AND r.b = s.a GROUP BY 1),
g AS (SELECT * FROM l WHERE node NOT IN (SELECT node FROM cyc) AND parent NOT IN (SELECT node FROM cyc)),
"""

SQL = {
    "p2_found": TREE_SQL
    + """tr(node, root_id, depth) AS (SELECT node, node, 0 FROM n WHERE node NOT IN (SELECT node FROM l)
  UNION SELECT g.node, t.root_id, t.depth + 1 FROM tr t JOIN g ON g.parent = t.node)
SELECT node AS provenance_id, root_id, CAST(min(depth) AS BIGINT) AS depth FROM tr GROUP BY 1, 2 HAVING min(depth) >= 12
UNION ALL SELECT node, root_id, -1 FROM cyc""",
    "p2_descendants": TREE_SQL
    + """dn(a, b, k) AS (SELECT parent, node, 1 FROM g UNION SELECT d.a, g.node, d.k + 1 FROM dn d JOIN g ON d.b = g.parent)
SELECT a AS provenance_id, b AS descendant, CAST(min(k) AS BIGINT) AS distance FROM dn GROUP BY 1, 2""",
    "p2_subtree_sizes": TREE_SQL
    + """dn(a, b, k) AS (SELECT parent, node, 1 FROM g UNION SELECT d.a, g.node, d.k + 1 FROM dn d JOIN g ON d.b = g.parent)
SELECT a AS provenance_id, count(*) AS n_descendants, CAST(max(k) AS BIGINT) AS height FROM (SELECT a, b, min(k) AS k FROM dn GROUP BY 1, 2) GROUP BY 1""",
    "p2_paths": TREE_SQL
    + """tr(node, root_id, depth, path) AS (SELECT node, node, 0, node FROM n WHERE node NOT IN (SELECT node FROM l)
  UNION SELECT node, root_id, depth, path FROM (SELECT g.node, t.root_id, t.depth + 1 AS depth, min(t.path || '>' || g.node) AS path
    FROM tr t JOIN g ON g.parent = t.node GROUP BY 1, 2, 3)),
best AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY node, root_id ORDER BY depth, path) = 1),
ob AS (SELECT nullif(lower(trim(provenance_id, E' \\t\\n\\r')), '') AS node, coalesce(max(object_id) FILTER (false),
  (arg_max(object_id, (sequence_no, object_id)) FILTER (object_id IS NOT NULL)), '') AS object_id FROM provenance_event GROUP BY 1),
st AS (SELECT b.node, b.root_id, s.i, list_extract(string_split(b.path, '>'), s.i) AS step FROM best b, LATERAL (SELECT unnest(range(1, b.depth + 2)) AS i) s),
op AS (SELECT st.node, st.root_id, string_agg(ob.object_id, '>' ORDER BY i) AS object_path FROM st JOIN ob ON st.step = ob.node GROUP BY 1, 2)
SELECT best.node AS provenance_id, best.root_id, CAST(best.depth AS BIGINT) AS depth, best.path, op.object_path FROM best JOIN op ON best.node = op.node AND best.root_id = op.root_id
UNION ALL SELECT node, root_id, -1, NULL, NULL FROM cyc""",
    "p1_found": "SELECT src, edge_type FROM durable_edge WHERE src >= 0 AND edge_type IS NOT NULL GROUP BY 1, 2 HAVING count(*) * 100 >= (SELECT count(*) FROM durable_edge)",
    "p1_weight_summary": """WITH v AS (SELECT src, edge_type, weight + 0.0 AS w, count(*) AS n FROM durable_edge GROUP BY 1, 2, 3),
c AS (SELECT *, sum(n) OVER (PARTITION BY src, edge_type ORDER BY w) AS upto, sum(n) OVER (PARTITION BY src, edge_type) AS total FROM v WHERE w IS NOT NULL),
q AS (SELECT src, edge_type, min(w) FILTER (upto >= greatest(1, ceil(total * 0.1 - 1e-9))) AS p10, min(w) FILTER (upto >= greatest(1, ceil(total * 0.5 - 1e-9))) AS p50,
  min(w) FILTER (upto >= greatest(1, ceil(total * 0.9 - 1e-9))) AS p90 FROM c GROUP BY 1, 2),
m AS (SELECT src, edge_type, w AS mode, n AS mode_rows FROM v WHERE w IS NOT NULL QUALIFY row_number() OVER (PARTITION BY src, edge_type ORDER BY n DESC, w) = 1),
s AS (SELECT src, edge_type, count(*) AS n_rows, count(weight) AS n_values, count(DISTINCT weight + 0.0) AS n_distinct, min(weight + 0.0) AS min_value,
  max(weight + 0.0) AS max_value FROM durable_edge GROUP BY 1, 2)
SELECT s.*, m.mode, m.mode_rows, q.p10, q.p50, q.p90 FROM s LEFT JOIN m ON s.src IS NOT DISTINCT FROM m.src AND s.edge_type IS NOT DISTINCT FROM m.edge_type
LEFT JOIN q ON s.src IS NOT DISTINCT FROM q.src AND s.edge_type IS NOT DISTINCT FROM q.edge_type""",
    "p3_found": _UNRESOLVED + "SELECT ref_table, ref_column, ref_key, reason, strftime(m, '%Y-%m-%d') AS ref_day FROM u",
    "p3_counts": _UNRESOLVED + "SELECT ref_table, ref_column, reason, strftime(m, '%Y-%m-%d') AS ref_day, count(*) AS n_refs FROM u GROUP BY 1, 2, 3, 4",
    "p3_composite_orphans": """SELECT CAST((CASE WHEN src IS NULL THEN 1 ELSE 0 END) + (CASE WHEN dst IS NULL THEN 2 ELSE 0 END) AS INTEGER) AS null_mask, count(*) AS n_refs
FROM durable_edge e WHERE (src IS NOT NULL AND dst IS NOT NULL AND NOT EXISTS (SELECT 1 FROM durable_edge t WHERE t.edge_type = 1 AND t.src = e.src AND t.dst = e.dst))
 OR (src IS NULL AND dst IS NOT NULL AND NOT EXISTS (SELECT 1 FROM durable_edge t WHERE t.edge_type = 1 AND t.dst = e.dst))
 OR (src IS NOT NULL AND dst IS NULL AND NOT EXISTS (SELECT 1 FROM durable_edge t WHERE t.edge_type = 1 AND t.src = e.src)) GROUP BY 1""",
    "p5_found": STATE_SQL + "SELECT entity, lsn FROM l WHERE kind LIKE 'PUT%'",
    "p5_late_changes": STATE_SQL + "SELECT entity, lsn FROM l WHERE kind LIKE 'PUT%'",
    "p5_records": STATE_SQL + "SELECT record_id, node_id, body, commit_lsn, lsn FROM l WHERE kind = 'PUT_RECORD'",
    "p5_edges": STATE_SQL + "SELECT src, dst, edge_type, weight_million, lsn FROM l WHERE kind = 'PUT_EDGE'",
    "p5_transactions": STATE_SQL + "SELECT txn, commit_lsn, status, n_ops FROM t",
}
