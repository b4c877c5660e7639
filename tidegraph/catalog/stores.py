"""Registered queries over paths, payload plans, layered rules, and line and token dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.config import EDGE_TYPES, RELATIONS
from tidegraph.functions.hashing import bit_of, mixed_bit, plain_bit
from tidegraph.functions.text import pack_record, prefix_record
from tidegraph.operators import lines, paths, payload, rules
from tidegraph.sources.tables import table

#: Edge types that event types stand for in path observations.
EVENT_EDGES = {"view": "PROJECT_CONTEXT", "click": "DOWN_EVIDENCE", "purchase": "LATERAL_SIMILAR_CASE", "signup": "UP_RULE", "error": "IS_NOT_EDGE"}


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Each user's every three events in a row as a path; errors block."""
    names = F.create_map(*[F.lit(x) for kv in EVENT_EDGES.items() for x in kv])
    rows = table(spark, d, "events").filter("user_id IS NOT NULL").select("event_id", "user_id", "ts", names[F.col("event_type")].alias("t"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = rows.withColumns({"t2": F.lead("t", 1).over(w), "t3": F.lead("t", 2).over(w)}).filter("t3 IS NOT NULL")
    path = F.array("t", "t2", "t3")
    return rows.select(
        F.col("event_id").cast("string").alias("path_id"), path.alias("edge_types"), F.array(F.col("user_id").cast("string")).alias("record_ids"),
        F.lit(1.0).alias("weight"), F.lit(False).alias("blocked"), F.col("event_id").alias("seq"),
    )


def relation_derive(spark: SparkSession, d: str) -> DataFrame:
    """Relation of every observed path."""
    return paths.relations(observations(spark, d).drop("blocked")).select("path_id", "relation", "blocked", "unknown_count", "step_count")


def relation_masked(spark: SparkSession, d: str) -> DataFrame:
    """Relations by count when only context and evidence may take part."""
    got = paths.relations(observations(spark, d).drop("blocked"), allowed=["PROJECT_CONTEXT", "DOWN_EVIDENCE"])
    return got.groupBy("relation", "blocked").agg(F.count(F.lit(1)).alias("n_paths"), F.sum("unknown_count").alias("n_unknown"))


def crystallize(spark: SparkSession, d: str) -> DataFrame:
    """Repeated paths as crystals, with the first links of each."""
    got = paths.crystallize(observations(spark, d), 50, 0.0, 20, 4)
    text = lambda c: F.array_join(c, ",").alias(c)
    return got.select("crystal_id", text("signature"), "support_count", "weighted_support", text("provenance_path_ids"), text("provenance_record_ids"))


def crystal_counters(spark: SparkSession, d: str) -> DataFrame:
    return paths.crystal_counters(observations(spark, d), 50)


def crystal_revoked(spark: SparkSession, d: str) -> DataFrame:
    """Crystals by status after those that begin with a similar case are revoked."""
    got = paths.crystallize(observations(spark, d), 50)
    gone = got.filter(F.get("signature", F.lit(0)) == "LATERAL_SIMILAR_CASE").select("crystal_id", F.lit("retired").alias("reason"), F.array(F.lit("e1")).alias("evidence_ids"))
    return paths.revoke(got, gone).groupBy("status").agg(F.count(F.lit(1)).alias("n_crystals"), F.sum("support_count").alias("support"))


def hot_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the archive of all events, by type."""
    got = paths.hot_edges(paths.event_archive(table(spark, d, "events").select("event_id")))
    return got.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("weight_milli").alias("sum_weight"), F.count_distinct("dst").alias("n_targets"))


def motif_crystals(spark: SparkSession, d: str) -> DataFrame:
    """Motifs of the archive with their support."""
    return paths.motifs(paths.event_archive(table(spark, d, "events").select("event_id")))


def archive_index(spark: SparkSession, d: str) -> DataFrame:
    """Events per node of the archive."""
    got = paths.events_of_nodes(paths.event_archive(table(spark, d, "events").select("event_id")))
    return got.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"))


def pointers(spark: SparkSession, d: str) -> DataFrame:
    """Texts of each source one after the other."""
    rows = table(spark, d, "documents").filter("source IS NOT NULL").select("source", "doc_id", F.coalesce("n_chars", F.lit(0)).alias("length"))
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)))
    return rows.filter("length > 0").select(F.col("source").alias("file"), F.col("doc_id").alias("record_id"), "offset", "length")


def coalesced_spans_gap(spark: SparkSession, d: str) -> DataFrame:
    """Reads joined over gaps of up to 2,000."""
    return payload.gap_spans(pointers(spark, d).filter("length > 1500"), 2000)


def coalesced_spans_bounded(spark: SparkSession, d: str) -> DataFrame:
    """Spans of up to 65,536 over gaps of up to 256, by record."""
    return payload.bounded_spans(pointers(spark, d), 256, 65_536).select("file", "record_id", "span_offset", "span_length")


def read_costs(spark: SparkSession, d: str) -> DataFrame:
    return payload.read_costs(payload.bounded_spans(pointers(spark, d), 2000, 65_536))


def page_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Texts on pages of 16,384 in each source."""
    return payload.pages(pointers(spark, d), 16_384)


def fetch_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Differences between texts fetched one by one and cut out of their spans' records (none)."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.col("text").alias("payload"))
    one = payload.fetch(pointers(spark, d), docs)
    two = payload.bounded_spans(pointers(spark, d), 256, 65_536).join(docs, "record_id").select("record_id", "payload")
    return payload.differences(one, two).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def checksum_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Failures of a sampled check where every text's checksum is of its first half."""
    rows = table(spark, d, "documents").filter("text IS NOT NULL AND text <> ''").select(F.col("doc_id").alias("position"), F.encode("text", "utf-8").alias("payload"))
    rows = rows.withColumn("crc", F.when(F.col("position") % 3 == 0, F.crc32(F.lit(b"other"))).otherwise(F.crc32("payload")))
    return payload.checksum_failures(rows, "sampled").select("position")


def top_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The 100 best candidates over all groups."""
    rows = table(spark, d, "ranked_candidate").filter("energy_score IS NOT NULL AND NOT isnan(energy_score) AND rank IS NOT NULL")
    rows = rows.withColumn("energy_score", F.when(F.col("energy_score") == 0, 0.0).otherwise(F.col("energy_score")))
    return payload.top_records(rows.select("energy_score", "rank", "node_id", "record_id").distinct(), 100)


def payload_for_wave(spark: SparkSession, d: str) -> DataFrame:
    """Spans of the payloads of the events behind the nodes of a ranking: the 64 most frequent project nodes."""
    archive = paths.event_archive(table(spark, d, "events").select("event_id"))
    index = paths.events_of_nodes(archive)
    rank = archive.groupBy(F.col("project_node").alias("node_id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "node_id").limit(64)
    rank = rank.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "node_id")))
    return payload.wave_payloads(rank, index, archive, 200, 64, 4096).select("record_id", "span_offset", "span_length")


def matrix_layers(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a matrix by layer and value, with parts as exceptions and suppliers as patches."""
    n = 512
    at = lambda t, k: table(spark, d, t).select((F.col(k) * 37 % (n * n)).alias("key")).distinct()
    exceptions = at("part", "p_partkey").withColumn("value", F.lit(7))
    patches = at("supplier", "s_suppkey").withColumn("value", F.lit(9))
    got = rules.layered(rules.matrix(spark, n), ["key"], plain_bit(F.col("row"), F.col("col")), exceptions, patches)
    return got.groupBy("source_layer", "value").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("key").alias("sum_key"))


def mixed_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Ones per row of the matrix of the mixed rule."""
    return rules.matrix(spark, 256).groupBy("row").agg(F.sum(mixed_bit("row", "col")).alias("n_ones"))


def prefix_family(spark: SparkSession, d: str) -> DataFrame:
    """Records of a numbered family for all orders, with finished ones as exceptions."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"))
    exceptions = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("idx"), F.concat(F.lit("X|"), "o_orderpriority").alias("value"))
    return rules.layered(rows, ["idx"], prefix_record(F.col("idx")), exceptions)


def family_pack(spark: SparkSession, d: str) -> DataFrame:
    """Records of a family of files for all lines of orders, with returned ones as exceptions."""
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("file"), F.col("l_orderkey").alias("record")).distinct()
    exceptions = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_linenumber").cast("long").alias("file"), F.col("l_orderkey").alias("record")).distinct().withColumn("value", F.lit("R"))
    got = rules.layered(rows, ["file", "record"], pack_record("PACK", F.col("file"), F.col("record")), exceptions)
    return got.groupBy("file", "source_layer").agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.length("value")).alias("n_chars"), F.max("value").alias("last"))


def chain(spark: SparkSession, d: str) -> DataFrame:
    """Events as patches of their users' values: each writes its rounded value."""
    rows = table(spark, d, "events").filter("user_id IS NOT NULL").select("event_id", "user_id", F.floor(F.coalesce("value", F.lit(0.0))).cast("long").alias("after"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = rows.withColumn("before", F.when(F.col("event_id") % 50 == 0, -1).otherwise(F.lag("after").over(w)))
    return rows.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), "before", "after")


def patch_compaction(spark: SparkSession, d: str) -> DataFrame:
    """Exceptions after the chain is folded into those of the customers."""
    exceptions = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.floor("c_acctbal").cast("long").alias("value"))
    return rules.compact(exceptions, chain(spark, d), ["key"], F.col("key") % 100)


def inverse_patch(spark: SparkSession, d: str) -> DataFrame:
    return rules.inverse(chain(spark, d))


def stale_patches(spark: SparkSession, d: str) -> DataFrame:
    """Patches whose earlier value isn't what they meet."""
    current = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit(None).cast("long").alias("value"))
    return rules.stale(chain(spark, d), current, ["key"])


def line_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Lines that occur twice or more over all texts."""
    return lines.dictionary(lines.lines(table(spark, d, "documents")), "line")


def line_encode(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each text by rule and left over."""
    rows = lines.lines(table(spark, d, "documents"))
    got = lines.encode(rows, lines.dictionary(rows, "line"))
    return got.groupBy("doc_id").agg(F.count("rule_id").alias("n_rules"), F.count("residual").alias("n_residual"), F.coalesce(F.sum(F.octet_length("residual")), F.lit(0)).cast("long").alias("residual_bytes"))


def line_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Texts put together again from the dictionary and the lines left over."""
    rows = lines.lines(table(spark, d, "documents"))
    book = lines.dictionary(rows, "line")
    return lines.rebuild(lines.encode(rows, book), book)


def token_ngram_gain(spark: SparkSession, d: str) -> DataFrame:
    """The 512 phrases that a dictionary gains most by."""
    return lines.phrase_gains(table(spark, d, "documents"))


def pack_choice(spark: SparkSession, d: str) -> DataFrame:
    """The smallest way to store each text."""
    return rules.choose(lines.pack_sizes(table(spark, d, "documents")), "doc_id")


def greedy_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts encoded by the longest phrases and decoded again."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    best = [r[0] for r in lines.phrase_gains(docs, keep=64).select("phrase").collect()]  # a dictionary of 64
    return lines.ungreedy(lines.greedy(docs, best), best)


def compression_claims(spark: SparkSession, d: str) -> DataFrame:
    """Raw and chosen bytes per language, and whether a claim of compression holds."""
    got = rules.choose(lines.pack_sizes(table(spark, d, "documents")), "doc_id").join(table(spark, d, "documents").select("doc_id", F.lower("lang").alias("lang")), "doc_id")
    return rules.compressible(got.groupBy("lang").agg(F.sum("raw_bytes").alias("raw_bytes"), F.sum("bytes").alias("compact_bytes")))


def bit_reads(spark: SparkSession, d: str) -> DataFrame:
    """Bits 0, 7 and 12 of the payloads of records."""
    rows = table(spark, d, "durable_record").filter("octet_length(payload) >= 2")
    bit = lambda i: F.sum(bit_of(F.col("payload"), F.lit(i))).alias(f"n_{i}")
    return rows.agg(bit(0), bit(7), bit(12))


_FUNCTIONS = (
    relation_derive, relation_masked, crystallize, crystal_counters, crystal_revoked, hot_edges, motif_crystals, archive_index, coalesced_spans_gap, coalesced_spans_bounded,
    read_costs, page_numbers, fetch_equivalence, checksum_sampled, top_candidates, payload_for_wave, matrix_layers, mixed_matrix, prefix_family, family_pack, patch_compaction, inverse_patch, stale_patches,
    line_dictionary, line_encode, line_rebuild, token_ngram_gain, pack_choice, greedy_round_trip, compression_claims, bit_reads,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_EDGES.items())
_OBS = f"""o AS (SELECT event_id, user_id, [t, t2, t3] AS p FROM (SELECT *, lead(t, 1) OVER w AS t2, lead(t, 2) OVER w AS t3 FROM (SELECT event_id, user_id, ts, CASE event_type {_CASE} END AS t FROM events WHERE user_id IS NOT NULL)
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE t3 IS NOT NULL)"""
_RULES = "rl(a, b, r) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{r}')" for (a, b), r in RELATIONS.items()) + ")"
_BLOCK = EDGE_TYPES[10]


def _derive(path: str) -> str:
    """Relations of three types by two look-ups."""
    return f"""{_RULES},
x AS (SELECT *, {path} AS q FROM o),
y AS (SELECT x.*, CASE WHEN q[1] = '{_BLOCK}' OR q[2] = '{_BLOCK}' THEN 'BLOCKED_PATH' ELSE coalesce(a.r, 'UNKNOWN_PATH') END AS r1 FROM x LEFT JOIN rl a ON a.a = q[1] AND a.b = q[2]),
z AS (SELECT y.event_id, CASE WHEN r1 = 'BLOCKED_PATH' OR q[3] = '{_BLOCK}' THEN 'BLOCKED_PATH' ELSE coalesce(b.r, 'UNKNOWN_PATH') END AS relation, r1 = 'BLOCKED_PATH' OR q[3] = '{_BLOCK}' AS blocked,
  CASE WHEN r1 = 'UNKNOWN_PATH' THEN 1 ELSE 0 END + CASE WHEN r1 <> 'BLOCKED_PATH' AND q[3] <> '{_BLOCK}' AND b.r IS NULL THEN 1 ELSE 0 END AS unknown_count, CASE WHEN r1 = 'BLOCKED_PATH' THEN 1 ELSE 2 END AS step_count
  FROM y LEFT JOIN rl b ON b.a = r1 AND b.b = q[3])"""


_CRYSTALS = f"WITH {_OBS}, c AS (SELECT p, count(*) AS n, min(event_id) AS f FROM o WHERE NOT list_contains(p, '{_BLOCK}') GROUP BY 1)"
_POINTERS = "p AS (SELECT * FROM (SELECT source AS file, doc_id AS record_id, CAST(coalesce(sum(coalesce(n_chars, 0)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", coalesce(n_chars, 0) AS length FROM documents WHERE source IS NOT NULL) WHERE length > 0)"
_LINES = "ln AS (SELECT doc_id, unnest(l) AS line FROM (SELECT doc_id, list_filter(list_concat(list_transform(string_split(text, chr(10))[:-2], lambda s: s || chr(10)), [string_split(text, chr(10))[-1]]), lambda s: s <> '') AS l FROM documents WHERE text IS NOT NULL))"
_CHAIN = "ch AS (SELECT event_id AS seq, user_id AS key, CASE WHEN event_id % 50 = 0 THEN -1 ELSE lag(a) OVER (PARTITION BY user_id ORDER BY event_id) END AS before, a AS after FROM (SELECT event_id, user_id, CAST(floor(coalesce(value, 0)) AS BIGINT) AS a FROM events WHERE user_id IS NOT NULL))"
_PACK = f"""{_LINES},
f AS (SELECT doc_id, sum(n) AS n, sum(CASE WHEN n >= 2 THEN b + 4 + 2 * n ELSE b + 3 END) AS family FROM (SELECT doc_id, line, count(*) AS n, strlen(line) AS b FROM ln GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT d.doc_id, strlen(d.text) AS raw_bytes, unnest([{{'m': 'RAW', 'b': strlen(d.text)}}, {{'m': 'RAW_INDEX', 'b': strlen(d.text) + 4 * coalesce(f.n, 0) + 8}}, {{'m': 'LINE_FAMILY', 'b': coalesce(f.family, 0) + 16}}]) AS c FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id WHERE d.text IS NOT NULL),
k AS (SELECT doc_id, c.m AS mode, CAST(c.b AS BIGINT) AS bytes, raw_bytes FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c.b, c.m <> 'RAW', c.m) = 1)"""
_PREFIX = "'9606.ENSP' || lpad(CAST(o_orderkey AS VARCHAR), 11, '0') || '|STATUS=OK|SOURCE=G1|VALUE=' || lpad(CAST(o_orderkey % 97 AS VARCHAR), 2, '0') || chr(10)"

SQL = {
    "relation_derive": f"WITH {_OBS}, {_derive('p')} SELECT CAST(event_id AS VARCHAR) AS path_id, relation, blocked, unknown_count, step_count FROM z",
    "relation_masked": f"WITH {_OBS}, {_derive("list_transform(p, lambda t: CASE WHEN t IN ('PROJECT_CONTEXT', 'DOWN_EVIDENCE', 'IS_NOT_EDGE') THEN t ELSE 'MASKED_OUT_EDGE' END)")} SELECT relation, blocked, count(*) AS n_paths, CAST(sum(unknown_count) AS BIGINT) AS n_unknown FROM z GROUP BY 1, 2",
    "crystallize": _CRYSTALS + f""", b AS (SELECT p, n FROM c WHERE n >= 50 ORDER BY n DESC, p LIMIT 20)
SELECT 'CRYSTAL_' || upper(left(sha256('CRYSTAL|' || array_to_string(b.p, '|')), 24)) AS crystal_id, array_to_string(b.p, ',') AS signature, n AS support_count, CAST(n AS DOUBLE) AS weighted_support,
  (SELECT string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FROM (SELECT event_id FROM o WHERE o.p = b.p ORDER BY event_id LIMIT 4)) AS provenance_path_ids,
  (SELECT string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY event_id) FROM (SELECT event_id, user_id FROM o WHERE o.p = b.p ORDER BY event_id LIMIT 4)) AS provenance_record_ids FROM b""",
    "crystal_counters": _CRYSTALS + " SELECT (SELECT count(*) FROM o) AS n_input, (SELECT count(*) FROM o WHERE list_contains(p, 'IS_NOT_EDGE')) AS skipped_blocked, CAST(coalesce(sum(n) FILTER (n < 50), 0) AS BIGINT) AS skipped_low_support FROM c",
    "crystal_revoked": _CRYSTALS + " SELECT CASE WHEN p[1] = 'LATERAL_SIMILAR_CASE' THEN 'REVOKED' ELSE 'ACTIVE' END AS status, count(*) AS n_crystals, CAST(sum(n) AS BIGINT) AS support FROM c WHERE n >= 50 GROUP BY 1",
    "hot_edges": "SELECT t AS edge_type, count(*) AS n_edges, CAST(sum(w) AS BIGINT) AS sum_weight, count(DISTINCT dst) AS n_targets FROM (SELECT 4 AS t, 750 AS w, 2000000000 + event_id % 4096 AS dst FROM events UNION ALL SELECT 5, 900, 3000000000 + event_id % 8192 FROM events UNION ALL SELECT 7, 700, 3000000000 + event_id % 8192 FROM events) GROUP BY 1",
    "motif_crystals": "SELECT concat_ws(':', (2000000000 + event_id % 4096) % 64, (3000000000 + event_id % 8192) % 64, (4000000000 + event_id % 2048) % 64) AS motif, count(*) AS support, min(event_id) AS first_event FROM events GROUP BY 1 HAVING count(*) >= 3",
    "archive_index": "SELECT n AS node_id, count(*) AS n_events, min(event_id) AS first_event FROM (SELECT event_id, unnest([1000000000 + event_id, 2000000000 + event_id % 4096, 3000000000 + event_id % 8192, 4000000000 + event_id % 2048]) AS n FROM events) GROUP BY 1",
    "coalesced_spans_gap": f"""WITH {_POINTERS}, q AS (SELECT *, CASE WHEN "offset" - max("offset" + length) OVER (PARTITION BY file ORDER BY "offset", record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 2000 THEN 0 ELSE 1 END AS fresh FROM p WHERE length > 1500),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY "offset", record_id) AS s FROM q)
SELECT file, min("offset") AS span_offset, max("offset" + length) - min("offset") AS span_length, count(*) AS n_records FROM g GROUP BY file, s""",
    "fetch_equivalence": "SELECT CAST(NULL AS VARCHAR) AS side, CAST(NULL AS BIGINT) AS n WHERE false",
    "checksum_sampled": "SELECT doc_id AS position FROM documents WHERE text IS NOT NULL AND text <> '' AND doc_id % 8 = 0 AND doc_id % 3 = 0",
    "top_candidates": "SELECT DISTINCT energy_score + 0.0 AS energy_score, rank, node_id, record_id FROM ranked_candidate WHERE energy_score IS NOT NULL AND NOT isnan(energy_score) AND rank IS NOT NULL ORDER BY energy_score DESC, rank, node_id, record_id LIMIT 100",
    "matrix_layers": """WITH m AS (SELECT k AS key, k // 512 AS r, k % 512 AS c FROM range(512 * 512) t(k)), x AS (SELECT DISTINCT p_partkey * 37 % 262144 AS key FROM part), y AS (SELECT DISTINCT s_suppkey * 37 % 262144 AS key FROM supplier),
v AS (SELECT m.key, CASE WHEN y.key IS NOT NULL THEN 'G4_PATCH' WHEN x.key IS NOT NULL THEN 'G2_EXCEPTION' ELSE 'G1_RULE' END AS source_layer, CAST(CASE WHEN y.key IS NOT NULL THEN 9 WHEN x.key IS NOT NULL THEN 7
  WHEN (xor(xor(r * 1315423911, c * 2654435761), r + c) & 7) IN (0, 3) THEN 1 ELSE 0 END AS INTEGER) AS value FROM m LEFT JOIN x ON m.key = x.key LEFT JOIN y ON m.key = y.key)
SELECT source_layer, value, count(*) AS n_cells, CAST(sum(key) AS BIGINT) AS sum_key FROM v GROUP BY 1, 2""",
    "prefix_family": f"SELECT o_orderkey AS idx, CASE WHEN o_orderstatus = 'F' THEN 'X|' || o_orderpriority ELSE {_PREFIX} END AS value, CASE WHEN o_orderstatus = 'F' THEN 'G2_EXCEPTION' ELSE 'G1_RULE' END AS source_layer FROM orders",
    "family_pack": """WITH b AS (SELECT CAST(l_linenumber AS BIGINT) AS file, l_orderkey AS record, bool_or(l_returnflag = 'R') AS x FROM lineitem GROUP BY 1, 2),
v AS (SELECT file, CASE WHEN x THEN 'G2_EXCEPTION' ELSE 'G1_RULE' END AS source_layer, CASE WHEN x THEN 'R' ELSE 'PACK|F=' || lpad(CAST(file AS VARCHAR), 3, '0') || '|R=' || lpad(CAST(record AS VARCHAR), 8, '0') || '|TYPE=A|STATUS=OK|GROUP='
  || lpad(CAST((record // 128) % 64 AS VARCHAR), 2, '0') || '|VALUE=' || lpad(CAST((record * 17 + file * 31) % 1000 AS VARCHAR), 3, '0') || chr(10) END AS value FROM b)
SELECT file, source_layer, count(*) AS n_records, CAST(sum(length(value)) AS BIGINT) AS n_chars, max(value) AS last FROM v GROUP BY 1, 2""",
    "patch_compaction": f"WITH {_CHAIN}, l AS (SELECT key, arg_max(after, seq) AS v FROM ch GROUP BY 1), x AS (SELECT c_custkey AS key, CAST(floor(c_acctbal) AS BIGINT) AS v FROM customer) SELECT coalesce(l.key, x.key) AS key, CASE WHEN l.key IS NOT NULL THEN l.v ELSE x.v END AS value FROM x FULL JOIN l ON x.key = l.key WHERE value IS DISTINCT FROM coalesce(l.key, x.key) % 100",
    "inverse_patch": f"WITH {_CHAIN} SELECT (SELECT max(seq) FROM ch) + 1 - seq AS seq, key, after AS before, before AS after FROM ch",
    "stale_patches": f"WITH {_CHAIN} SELECT seq, key, before, after FROM (SELECT *, lag(after) OVER (PARTITION BY key ORDER BY seq) AS p FROM ch) WHERE before IS DISTINCT FROM p",
    "line_dictionary": f"WITH {_LINES} SELECT line, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, sha256(line), line) - 1 AS rule_id FROM ln GROUP BY line HAVING count(*) >= 2",
    "line_encode": f"WITH {_LINES}, k AS (SELECT line FROM ln GROUP BY 1 HAVING count(*) >= 2) SELECT doc_id, count(k.line) AS n_rules, count(*) - count(k.line) AS n_residual, CAST(coalesce(sum(CASE WHEN k.line IS NULL THEN strlen(ln.line) END), 0) AS BIGINT) AS residual_bytes FROM ln LEFT JOIN k ON ln.line = k.line GROUP BY 1",
    "line_rebuild": "SELECT doc_id, text FROM documents WHERE text <> ''",
    "pack_choice": f"WITH {_PACK} SELECT doc_id, mode, bytes, raw_bytes FROM k",
    "compression_claims": f"WITH {_PACK}, t AS (SELECT lower(d.lang) AS lang, CAST(sum(raw_bytes) AS BIGINT) AS raw_bytes, CAST(sum(bytes) AS BIGINT) AS compact_bytes FROM k JOIN documents d ON k.doc_id = d.doc_id GROUP BY 1) SELECT *, round(raw_bytes / compact_bytes, 9) AS ratio, compact_bytes < raw_bytes AS claim FROM t",
    "bit_reads": "SELECT CAST(sum(get_bit(CAST(payload AS BIT), 7)) AS BIGINT) AS n_0, CAST(sum(get_bit(CAST(payload AS BIT), 0)) AS BIGINT) AS n_7, CAST(sum(get_bit(CAST(payload AS BIT), 11)) AS BIGINT) AS n_12 FROM durable_record WHERE octet_length(payload) >= 2",
    "greedy_round_trip": "SELECT doc_id, text FROM documents WHERE text IS NOT NULL",
}
