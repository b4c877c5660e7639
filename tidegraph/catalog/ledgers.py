"""Registered queries over ledgers, mutations and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.catalog import sqltext as S
from tidegraph.functions.hashing import content_id
from tidegraph.operators import changefeed, ledger, metrics, mutations
from tidegraph.operators.hierarchy import clean_id
from tidegraph.sources.graph import durable_edges, durable_records
from tidegraph.sources.tables import table

#: Operation that an event of each type stands for.
EVENT_OPERATIONS = {"view": "PROPOSE", "click": "PROMOTE", "signup": "PROPOSE", "purchase": "DISPUTE", "error": "EXPIRE"}


def operation(event_type: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in EVENT_OPERATIONS.items() for x in kv])[event_type]


def trust_events(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, sequence, operation) from the events of each user in the order of time and id."""
    rows = table(spark, d, "events").filter("user_id IS NOT NULL")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.select(F.col("user_id").cast("string").alias("record_id"), F.struct(micros.alias("at"), "event_id").alias("sequence"), operation(F.col("event_type")).alias("operation"), "event_id")


def _sequenced(spark: SparkSession, d: str) -> DataFrame:
    return trust_events(spark, d).select("record_id", F.format_string("%020d.%020d", "sequence.at", "sequence.event_id").alias("sequence"), "operation", "event_id")


def trust_replayed(spark: SparkSession, d: str) -> DataFrame:
    return ledger.replay(_sequenced(spark, d), "record_id", "sequence", "operation")


def trust_current(spark: SparkSession, d: str) -> DataFrame:
    """State of every record after its last legal event."""
    return ledger.current_states(trust_replayed(spark, d), "record_id", "sequence")


def trust_legality(spark: SparkSession, d: str) -> DataFrame:
    """Legal and illegal events by operation."""
    return trust_replayed(spark, d).groupBy("operation", "legal").agg(F.count(F.lit(1)).alias("n_events"))


def trust_events_replayed(spark: SparkSession, d: str) -> DataFrame:
    """Every event with the state before and after it."""
    rows = trust_replayed(spark, d)
    maturity, validity = ledger.state_names(F.col("next_state"))
    return rows.select("event_id", "operation", "legal", maturity, validity)


def wal_pending(spark: SparkSession, d: str) -> DataFrame:
    """Transactions of the log that take no effect, by status."""
    got = changefeed.transactions(changefeed.whole_frames(table(spark, d, "wal_frame")))
    return got.filter("status <> 'COMMITTED'").groupBy("status").agg(F.count(F.lit(1)).alias("n_transactions"), F.sum("n_frames").alias("n_frames"))


def wal_copies(spark: SparkSession, d: str) -> DataFrame:
    """Frames with the same lsn: how many, and how many with different payloads."""
    rows = table(spark, d, "wal_frame").select("lsn", F.upper("frame_type").alias("kind"), F.hex("payload").alias("payload"))
    got = mutations.batch_status(rows.filter("lsn IS NOT NULL"), ["lsn"], ["kind", "payload"])
    return got.groupBy("status").agg(F.count(F.lit(1)).alias("n_lsn"), F.sum("n_ops").alias("n_frames"))


def edge_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of each edge: single, repeated alike, or in conflict."""
    got = mutations.batch_status(table(spark, d, "durable_edge"), ["logical_id"], ["src", "dst", "edge_type", "weight_million"])
    return got.groupBy("status").agg(F.count(F.lit(1)).alias("n_ids"), F.sum("n_ops").alias("n_rows"))


def unchanged_puts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the record deliveries that the current state doesn't already hold, by node known or not."""
    batch = table(spark, d, "durable_record").select("record_id", "node_id", "payload_sha256")
    current = durable_records(spark, d).select("record_id", "node_id", "payload_sha256")
    got = mutations.changes_only(batch, current)
    return got.groupBy(F.col("node_id").isNull().alias("without_node")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("record_id").alias("n_records"))


def records_by_node(spark: SparkSession, d: str) -> DataFrame:
    return mutations.records_of_nodes(durable_records(spark, d))


def record_listing(spark: SparkSession, d: str) -> DataFrame:
    """Current records without payload, in order, numbered."""
    return mutations.listing(durable_records(spark, d)).select("record_id", "node_id", F.col("payload_bytes").cast("long").alias("payload_bytes"), "rank")


def snapshot_digests(spark: SparkSession, d: str) -> DataFrame:
    return mutations.snapshot(durable_records(spark, d), durable_edges(spark, d))


def payload_checks(spark: SparkSession, d: str) -> DataFrame:
    """Records whose payload doesn't have its stated SHA-256, has it, or states none."""
    rows = durable_records(spark, d)
    check = F.when(F.col("payload_sha256").isNull(), "NONE").when(F.sha2("payload", 256) == F.lower("payload_sha256"), "GOOD").otherwise("BAD")
    return rows.groupBy(check.alias("checked")).agg(F.count(F.lit(1)).alias("n_records"))


def content_ids(spark: SparkSession, d: str) -> DataFrame:
    """Content-derived ids: how many records, how many distinct ids."""
    rows = durable_records(spark, d).select("record_id", content_id(F.col("record_id"), F.col("node_id")).alias("id"))
    return rows.agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("id").alias("n_ids"))


def inventory_standing(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts (one per document source and language) against a snapshot: compatible, stale or invalid."""
    rows = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("source", "lang", F.when(F.col("n") % 3 == 0, "INVALIDATED").otherwise("COMPLETE").alias("state"), F.concat(F.lit("s"), (F.col("n") % 2).cast("string")).alias("source_hash"))
    return mutations.checked_inventory(rows, "s1").groupBy("standing").agg(F.count(F.lit(1)).alias("n_artifacts"))


def provenance_versions(spark: SparkSession, d: str) -> DataFrame:
    """Objects whose versions aren't 1, 2, 3 and so on."""
    return ledger.version_gaps(table(spark, d, "provenance_event"), ["object_namespace", "object_id"], "object_version")


def provenance_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of each object."""
    rows = table(spark, d, "provenance_event").select("object_namespace", "object_id", "object_version", "sequence_no", clean_id("provenance_id").alias("provenance_id"))
    return ledger.latest(rows.dropna(subset=["object_id"]), ["object_namespace", "object_id"], "object_version", ["sequence_no", "provenance_id"])


def provenance_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Events per kind that break the rule of their kind: derived without parents, others with some."""
    n = F.size(F.filter(F.coalesce("parent_provenance_ids", F.array().cast("array<string>")), lambda x: F.trim(x) != ""))
    broken = F.when(F.col("kind") == "DERIVED", n == 0).otherwise(n > 0)
    return table(spark, d, "provenance_event").groupBy("kind").agg(F.count(F.lit(1)).alias("n_events"), F.count(F.when(broken, 1)).alias("n_broken"))


def chain_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Breaks of the log's chain of sequence, digest and time of arrival, by reason."""
    rows = table(spark, d, "wal_frame").filter("lsn IS NOT NULL").groupBy("lsn").agg(F.min("arrived_at").alias("clock"))
    rows = rows.withColumns({"digest": F.sha2(F.col("lsn").cast("string"), 256), "previous": F.sha2((F.col("lsn") - 1).cast("string"), 256)})
    return ledger.chain_breaks(rows, "lsn", "digest", "previous", "clock").groupBy("reason").agg(F.count(F.lit(1)).alias("n_breaks"))


def evidence_quorum(spark: SparkSession, d: str) -> DataFrame:
    """Transitions whose distinct evidence reaches their quorum of two."""
    rows = table(spark, d, "evidence_ref").select("transition_no", clean_id("provenance_id").alias("voter")).dropna()
    asked = rows.select("transition_no").distinct().withColumn("quorum", F.lit(2))
    return ledger.thresholds(rows, ["transition_no"], "voter", F.lit(1), asked).select("transition_no", F.col("weight").cast("long").alias("weight"), "n_voters", "reached")


def open_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Transactions whose latest frame isn't a COMMIT or ABORT, by that frame."""
    frames = changefeed.whole_frames(table(spark, d, "wal_frame")).filter("txn IS NOT NULL AND kind <> 'CHECKPOINT'")
    return ledger.open_journal(frames, "txn", "lsn", "kind", ("COMMIT", "ABORT")).groupBy("kind").agg(F.count(F.lit(1)).alias("n_transactions"))


def audit_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Events and their values by type."""
    rows = ledger.metrics(table(spark, d, "events"), ["event_type"], ["value"])
    return rows.withColumn("sum_value", F.round("sum_value", 4))


def audit_exposition(spark: SparkSession, d: str) -> DataFrame:
    """Counts by type as lines of the text exposition format."""
    return ledger.prometheus(ledger.metrics(table(spark, d, "events"), ["event_type"], []), "events_total", ["event_type"], "n_events")


def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of the delay between logging and arrival of edges, by edge type, in seconds."""
    delay = F.floor((F.unix_micros(F.col("arrived_at").cast("timestamp")) - F.unix_micros(F.col("logged_at").cast("timestamp"))) / 1_000_000).cast("long")
    return metrics.latencies(table(spark, d, "durable_edge").select("edge_type", delay.alias("delay")), ["edge_type"], "delay")


_FUNCTIONS = (
    trust_current, trust_legality, trust_events_replayed, wal_pending, wal_copies, edge_duplicates, unchanged_puts, records_by_node, record_listing, snapshot_digests, payload_checks,
    content_ids, inventory_standing, provenance_versions, provenance_latest, provenance_shapes, chain_breaks, evidence_quorum, open_transactions, audit_metrics, audit_exposition, latency_summary,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

# With these operations a record's state follows from the events since its first PROPOSE: PROMOTE counts while active, the
# first DISPUTE or EXPIRE ends that, and an EXPIRE after the DISPUTE still counts.
_ORDER = "(ts, event_id)"
TRUST_SQL = """ev AS (SELECT CAST(user_id AS VARCHAR) AS record_id, event_id, CASE event_type WHEN 'view' THEN 'PROPOSE' WHEN 'click' THEN 'PROMOTE' WHEN 'signup' THEN 'PROPOSE' WHEN 'purchase' THEN 'DISPUTE' WHEN 'error' THEN 'EXPIRE' END AS op,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL),
fp AS (SELECT record_id, min(n) AS p FROM ev WHERE op = 'PROPOSE' GROUP BY 1),
ds AS (SELECT ev.record_id, min(n) FILTER (op = 'DISPUTE') AS d, min(n) FILTER (op = 'EXPIRE') AS x FROM ev JOIN fp ON ev.record_id = fp.record_id WHERE n > p GROUP BY 1),
pr AS (SELECT ev.record_id, ev.n, row_number() OVER (PARTITION BY ev.record_id ORDER BY ev.n) AS k FROM ev JOIN fp ON ev.record_id = fp.record_id LEFT JOIN ds ON ev.record_id = ds.record_id
  WHERE op = 'PROMOTE' AND n > p AND n < least(coalesce(d, 1000000000), coalesce(x, 1000000000))),
lg AS (SELECT ev.event_id, ev.record_id, ev.n, ev.op, CASE WHEN ev.n = fp.p THEN true WHEN ev.n < fp.p OR fp.p IS NULL THEN false WHEN op = 'PROMOTE' THEN coalesce(pr.k <= 3, false)
  WHEN op = 'DISPUTE' THEN ev.n = ds.d AND (ds.x IS NULL OR ds.d < ds.x) WHEN op = 'EXPIRE' THEN ev.n = ds.x ELSE false END AS legal
  FROM ev LEFT JOIN fp ON ev.record_id = fp.record_id LEFT JOIN ds ON ev.record_id = ds.record_id LEFT JOIN pr ON ev.record_id = pr.record_id AND ev.n = pr.n),
st AS (SELECT event_id, record_id, n, op, legal, sum(CASE WHEN legal AND op = 'PROPOSE' THEN 1 ELSE 0 END) OVER w AS born, sum(CASE WHEN legal AND op = 'PROMOTE' THEN 1 ELSE 0 END) OVER w AS up,
  sum(CASE WHEN legal AND op = 'DISPUTE' THEN 1 ELSE 0 END) OVER w AS dis, sum(CASE WHEN legal AND op = 'EXPIRE' THEN 1 ELSE 0 END) OVER w AS ex FROM lg WINDOW w AS (PARTITION BY record_id ORDER BY n)),
states AS (SELECT event_id, record_id, n, op, legal, CASE WHEN born > 0 THEN ['RAW', 'HYPOTHESIS', 'CANDIDATE', 'VERIFIED'][CAST(up AS INTEGER) + 1] END AS maturity,
  CASE WHEN born > 0 THEN CASE WHEN ex > 0 THEN 'EXPIRED' WHEN dis > 0 THEN 'DISPUTED' ELSE 'ACTIVE' END END AS validity FROM st),
current AS (SELECT record_id, maturity, validity FROM states WHERE legal QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY n DESC) = 1)"""
_CLEAN = "nullif(lower(trim(provenance_id, E' \\t\\n\\r')), '')"

from tidegraph.catalog.pipeline import STATE_SQL  # noqa: E402

SQL = {
    "trust_current": f"WITH {TRUST_SQL} SELECT * FROM current",
    "trust_legality": f"WITH {TRUST_SQL} SELECT op AS operation, legal, count(*) AS n_events FROM lg GROUP BY 1, 2",
    "trust_events_replayed": f"WITH {TRUST_SQL} SELECT event_id, op AS operation, legal, maturity, validity FROM states",
    "wal_pending": STATE_SQL + "SELECT t.status, count(*) AS n_transactions, CAST(sum(coalesce(m.n, 0)) AS BIGINT) AS n_frames FROM t LEFT JOIN (SELECT txn, count(*) AS n FROM o GROUP BY 1) m ON t.txn = m.txn WHERE status <> 'COMMITTED' GROUP BY 1",
    "wal_copies": """SELECT status, count(*) AS n_lsn, CAST(sum(n) AS BIGINT) AS n_frames FROM (SELECT lsn, count(*) AS n, CASE WHEN count(DISTINCT upper(frame_type) || '|' || coalesce(hex(payload), '')) > 1 THEN 'CONFLICT' WHEN count(*) > 1 THEN 'DUPLICATE' ELSE 'SINGLE' END AS status
FROM wal_frame WHERE lsn IS NOT NULL GROUP BY 1) GROUP BY 1""",
    "edge_duplicates": """SELECT status, count(*) AS n_ids, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT logical_id, count(*) AS n, CASE WHEN count(DISTINCT concat_ws('|', coalesce(CAST(src AS VARCHAR), 'x'), coalesce(CAST(dst AS VARCHAR), 'x'), coalesce(CAST(edge_type AS VARCHAR), 'x'),
coalesce(CAST(weight_million AS VARCHAR), 'x'))) > 1 THEN 'CONFLICT' WHEN count(*) > 1 THEN 'DUPLICATE' ELSE 'SINGLE' END AS status FROM durable_edge GROUP BY 1) GROUP BY 1""",
    "unchanged_puts": f"""WITH {S.durable_records()} SELECT b.node_id IS NULL AS without_node, count(*) AS n_rows, count(DISTINCT b.record_id) AS n_records FROM durable_record b
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.record_id IS NOT DISTINCT FROM b.record_id AND r.node_id IS NOT DISTINCT FROM b.node_id AND r.payload_sha256 IS NOT DISTINCT FROM b.payload_sha256) GROUP BY 1""",
    "records_by_node": f"WITH {S.durable_records()} SELECT node_id, count(DISTINCT record_id) AS n_records, min(record_id) AS first_record, max(record_id) AS last_record FROM r WHERE node_id IS NOT NULL GROUP BY 1",
    "record_listing": f"WITH {S.durable_records()} SELECT record_id, node_id, CAST(coalesce(octet_length(payload), 0) AS BIGINT) AS payload_bytes, row_number() OVER (ORDER BY record_id, node_id) AS rank FROM r",
    "payload_checks": f"WITH {S.durable_records()} SELECT CASE WHEN payload_sha256 IS NULL THEN 'NONE' WHEN sha256(payload) = lower(payload_sha256) THEN 'GOOD' ELSE 'BAD' END AS checked, count(*) AS n_records FROM r GROUP BY 1",
    "content_ids": f"WITH {S.durable_records()} SELECT count(*) AS n_records, count(DISTINCT record_id) AS n_ids FROM r",
    "inventory_standing": "WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT CASE WHEN n % 3 = 0 THEN 'INVALIDATED' WHEN n % 2 = 1 THEN 'COMPATIBLE' ELSE 'STALE' END AS standing, count(*) AS n_artifacts FROM n GROUP BY 1",
    "provenance_versions": "SELECT object_namespace, object_id, count(DISTINCT object_version) AS n_versions, max(object_version) AS max_version, max(object_version) - count(DISTINCT object_version) AS n_missing FROM provenance_event WHERE object_namespace IS NOT NULL AND object_id IS NOT NULL GROUP BY 1, 2 HAVING n_missing <> 0",
    "provenance_latest": f"SELECT object_namespace, object_id, object_version, sequence_no, {_CLEAN} AS provenance_id FROM provenance_event WHERE object_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY object_namespace, object_id ORDER BY object_version DESC NULLS LAST, sequence_no DESC NULLS LAST, {_CLEAN} DESC NULLS LAST) = 1",
    "provenance_shapes": "WITH n AS (SELECT kind, len(list_filter(coalesce(parent_provenance_ids, []), lambda x: trim(x) <> '')) AS n FROM provenance_event) SELECT kind, count(*) AS n_events, count(*) FILTER (CASE WHEN kind = 'DERIVED' THEN n = 0 ELSE n > 0 END) AS n_broken FROM n GROUP BY 1",
    "chain_breaks": """WITH s AS (SELECT lsn AS s, min(arrived_at) AS c FROM wal_frame WHERE lsn IS NOT NULL GROUP BY 1),
b AS (SELECT s.s, CASE WHEN p.s IS NULL THEN 'SEQUENCE' WHEN NOT coalesce(s.c > p.c, false) THEN 'CLOCK' END AS reason FROM s LEFT JOIN s p ON p.s = s.s - 1 WHERE s.s <> (SELECT min(s) FROM s))
SELECT reason, count(*) AS n_breaks FROM b WHERE reason IS NOT NULL GROUP BY 1""",
    "evidence_quorum": f"SELECT transition_no, count(DISTINCT {_CLEAN}) AS weight, count(DISTINCT {_CLEAN}) AS n_voters, count(DISTINCT {_CLEAN}) >= 2 AS reached FROM evidence_ref WHERE transition_no IS NOT NULL AND {_CLEAN} IS NOT NULL GROUP BY 1",
    "open_transactions": STATE_SQL + "SELECT kind, count(*) AS n_transactions FROM (SELECT kind FROM f WHERE txn IS NOT NULL AND kind <> 'CHECKPOINT' QUALIFY row_number() OVER (PARTITION BY txn ORDER BY lsn DESC) = 1) WHERE kind NOT IN ('COMMIT', 'ABORT') GROUP BY 1",
    "audit_metrics": "SELECT event_type, count(*) AS n_events, round(sum(value), 4) AS sum_value FROM events GROUP BY 1",
    "audit_exposition": "SELECT 'events_total{event_type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type",
    "latency_summary": """WITH v AS (SELECT edge_type, CAST(floor((epoch_us(arrived_at) - epoch_us(logged_at)) / 1000000) AS BIGINT) AS s FROM durable_edge),
c AS (SELECT edge_type, s, row_number() OVER (PARTITION BY edge_type ORDER BY s) AS i, count(s) OVER (PARTITION BY edge_type) AS n FROM v WHERE s IS NOT NULL)
SELECT edge_type, max(n) AS n_values, min(s) AS min_value, min(s) FILTER (i >= ceil(n * 0.5 - 1e-9)) AS p50, min(s) FILTER (i >= ceil(n * 0.95 - 1e-9)) AS p95, max(s) AS max_value FROM c GROUP BY 1""",
}
