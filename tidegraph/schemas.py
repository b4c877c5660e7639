"""Schemas of the model, stated and never inferred."""

RECORDS = "logical_id bigint, record_id string, node_id bigint, payload binary, payload_sha256 string"
EDGES = "logical_id bigint, src bigint, dst bigint, edge_type int, weight double"
WAVE = "node_id bigint, energy double, predecessor bigint, edge_type int"
BEST_FIRST = "seed bigint, node_id bigint, energy double, best_path array<int>, best_path_len int"
VECTORS = "space_id string, record_id string, vec array<float>, generation bigint"
TRUST_EVENTS = (
    "sequence bigint, logical_timestamp bigint, record_id string, operation string, authority string, "
    "evidence array<struct<evidence_id: string, provenance_id: string, evidence_digest: string>>, superseding_record_id string"
)
WAL = "lsn bigint, frame_type string, transaction_id string, payload binary"
ARCHIVE = "event_id bigint, seed_node bigint, project_node bigint, code_node bigint, rule_node bigint, payload_offset bigint, payload_len bigint, flags int"
POINTERS = "record_id bigint, offset bigint, length bigint"
