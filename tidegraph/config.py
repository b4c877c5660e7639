"""Fixed values that results depend on, and limits."""

from __future__ import annotations

# Edge types by id.
EDGE_TYPES = {
    1: "UP_RULE",
    2: "DOWN_EVIDENCE",
    3: "LATERAL_SIMILAR_CASE",
    4: "PROJECT_CONTEXT",
    5: "CODE_PATTERN",
    6: "RULE_TO_EVIDENCE",
    7: "RULE_TO_CODE_PATTERN",
    8: "PROJECT_TO_RECENT_SEED",
    9: "CODE_TO_RECENT_RULE",
    10: "IS_NOT_EDGE",
}
BLOCKER = 10

# Attenuation per edge type 1..10, by profile.
ATTENUATION = {
    "default": [0.70, 0.25, 0.40, 0.75, 0.90, 0.55, 0.65, 0.80, 0.85, 0.0],
    "strict": [0.66, 0.16, 0.18, 0.58, 0.88, 0.28, 0.82, 0.36, 0.72, 0.0],
    "balanced": [0.70, 0.25, 0.40, 0.75, 0.90, 0.42, 0.86, 0.55, 0.80, 0.0],
    "explorative": [0.76, 0.38, 0.62, 0.82, 0.92, 0.55, 0.88, 0.72, 0.86, 0.0],
    "floating": [0.70, 0.25, 0.40, 0.75, 0.90, 0.62, 0.66, 0.58, 0.64, 0.0],
}

# How two relations in a row combine; any other pair is unknown.
UNKNOWN, EMPTY, BLOCKED, MASKED = "UNKNOWN_PATH", "EMPTY_PATH", "BLOCKED_PATH", "MASKED_OUT_EDGE"
RELATIONS = {
    ("PROJECT_CONTEXT", "DOWN_EVIDENCE"): "PROJECT_SUPPORT_PATH",
    ("PROJECT_CONTEXT", "RULE_TO_EVIDENCE"): "PROJECT_SUPPORT_PATH",
    ("PROJECT_CONTEXT", "PROJECT_TO_RECENT_SEED"): "PROJECT_RECENT_ACTIVITY_PATH",
    ("UP_RULE", "CODE_PATTERN"): "RULE_CODE_CANDIDATE",
    ("UP_RULE", "RULE_TO_CODE_PATTERN"): "RULE_CODE_CANDIDATE",
    ("CODE_TO_RECENT_RULE", "RULE_TO_CODE_PATTERN"): "RECENT_CODE_RULE_PATH",
    ("CODE_PATTERN", "CODE_TO_RECENT_RULE"): "CODE_RULE_BACKLINK_PATH",
    ("RULE_CODE_CANDIDATE", "DOWN_EVIDENCE"): "RULE_CODE_EVIDENCE_PATH",
    ("RULE_CODE_CANDIDATE", "RULE_TO_EVIDENCE"): "RULE_CODE_EVIDENCE_PATH",
    ("PROJECT_SUPPORT_PATH", "LATERAL_SIMILAR_CASE"): "PROJECT_SUPPORT_SIMILAR_CASE_PATH",
    ("PROJECT_RECENT_ACTIVITY_PATH", "LATERAL_SIMILAR_CASE"): "PROJECT_RECENT_SIMILAR_CASE_PATH",
    ("RECENT_CODE_RULE_PATH", "DOWN_EVIDENCE"): "RECENT_CODE_RULE_EVIDENCE_PATH",
    ("CODE_RULE_BACKLINK_PATH", "DOWN_EVIDENCE"): "CODE_RULE_BACKLINK_EVIDENCE_PATH",
    ("LATERAL_SIMILAR_CASE", "DOWN_EVIDENCE"): "SIMILAR_CASE_EVIDENCE_PATH",
    ("LATERAL_SIMILAR_CASE", "PROJECT_CONTEXT"): "SIMILAR_PROJECT_CONTEXT_PATH",
    ("SIMILAR_PROJECT_CONTEXT_PATH", "DOWN_EVIDENCE"): "SIMILAR_PROJECT_EVIDENCE_PATH",
}

# Wave presets (energy threshold, top k, steps, rigor).
PRESETS = {"strict": (0.18, 32, 3, 0.88), "mixed": (0.07, 64, 3, 1.0), "explorative": (0.035, 128, 4, 1.15)}
DEFAULT_MASK = (4, 5, 7)

#: Limits of a call.
MAX_STEPS = 64
MAX_DIMENSION = 65_536
#: Edges that a graph for batches of hop waves may have in each worker; beyond, they are joined.
KERNEL_EDGES = 2_000_000
#: Edges that best-first searches may hold in each worker; beyond, they are mapped from files in the shared folder.
BROADCAST_EDGES = 4_000_000
#: Edges that a growing subgraph may hold in each worker, in compressed rows of 13 bytes an edge; beyond, each seed gets its own.
HELD_EDGES = 8_000_000
