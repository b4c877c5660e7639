"""Registered queries of vector search, structural features, trust-filtered and hybrid rankings, and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.catalog import sqltext as S
from tidegraph.catalog.graph import EVERY, order_seeds
from tidegraph.catalog.ledgers import trust_current
from tidegraph.operators import hybrid, metrics, structural, vectors, wave
from tidegraph.plans.lineage import cut
from tidegraph.sources.graph import SPACE, durable_edges, node, order_edges
from tidegraph.sources.tables import table

DIMENSION = 64
#: Added before rounding sums, so that none lies halfway between two roundings.
OFF_TIES = 1.23e-8
CUSTOMERS = 3 * SPACE


def vector_column(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    bad = vectors.invalid(rows, DIMENSION).select("vec_id")
    return rows.join(bad, "vec_id", "left_anti")


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vector_column(spark, d).filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "vec")


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors to every hundredth vector."""
    return vectors.search(vector_column(spark, d), query_vectors(spark, d), 10, "vec_id").select("query_id", "id", F.round("similarity", 9).alias("similarity"), "rank")


def cosine_scoped(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest among the vectors of the query's own label."""
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    mine = labels.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "label")
    allowed = mine.join(labels, "label").select("query_id", F.col("vec_id").alias("id"))
    rows = vectors.search(vector_column(spark, d), query_vectors(spark, d), 5, "vec_id", allowed=allowed)
    return rows.select("query_id", "id", F.round("similarity", 9).alias("similarity"), "rank")


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    """Squared norms, and whether the vector may be stored."""
    rows = table(spark, d, "embeddings")
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.select("vec_id", F.round(norm, 6).alias("squared_norm"), (F.size("embedding") == DIMENSION).alias("right_size"))


def vector_puts(spark: SparkSession, d: str) -> DataFrame:
    """Putting half of the vectors again, a few changed: outcomes per label."""
    rows = table(spark, d, "embeddings")
    had = rows.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("record_id"), F.col("embedding").alias("vec"), F.lit(1).cast("long").alias("generation"))
    new = rows.select(F.col("vec_id").alias("record_id"), F.when(F.col("vec_id") % 6 == 0, F.reverse("embedding")).otherwise(F.col("embedding")).alias("vec"))
    got = vectors.put(had, new).join(rows.select(F.col("vec_id").alias("record_id"), "label"), "record_id")
    return got.groupBy("label", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("generation").alias("generations"))


def semantic_trusted(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest active records, where each vector stands for the record of the same number. All are ranked before
    the filter, so that ten come out wherever ten are active."""
    states = trust_current(spark, d).withColumn("record_id", F.col("record_id").cast("long"))
    rows = hybrid.with_trust(vector_column(spark, d).withColumnRenamed("vec_id", "record_id"), states).filter(hybrid.trusted("ACTIVE_ONLY"))
    got = vectors.search(rows, query_vectors(spark, d), 10)
    return got.select("query_id", "id", F.round("similarity", 9).alias("similarity"), "rank")


def scope(spark: SparkSession, d: str, k: int, order: tuple[str, ...] = ("energy", "node"), among: DataFrame | None = None, always: DataFrame | None = None) -> DataFrame:
    """Customers that a wave from every hundredth customer reaches through nations: of those in ``among``, the first ``k``
    per anchor by ``order`` besides those in ``always``, which is all that a ranking of ``k`` by this order can use."""
    every = (CUSTOMERS, CUSTOMERS + SPACE)
    rows = wave.best_first(order_edges(spark, d, {4, 8, 10}), order_seeds(spark, d), 6, 0.2, k + 1, (4, 8), order=order, among=among or every, always=always)
    rows = rows.filter((F.col("node_id") >= every[0]) & (F.col("node_id") < every[1]) & (F.col("seed") != F.col("node_id")))
    return rows.select((F.col("seed") - CUSTOMERS).alias("anchor"), (F.col("node_id") - CUSTOMERS).alias("record_id"), "node_id", "energy")


def customer_trust(spark: SparkSession, d: str) -> DataFrame:
    return trust_current(spark, d).withColumn("record_id", F.col("record_id").cast("long"))


def topological_query(spark: SparkSession, d: str) -> DataFrame:
    """Ten records per anchor by wave energy, of those known to be hypotheses at least."""
    states, trust = cut(customer_trust(spark, d)), hybrid.trusted("MATURITY_AT_LEAST", "HYPOTHESIS")
    known = states.filter(trust).select((F.col("record_id") + CUSTOMERS).alias("node_id"))
    rows = hybrid.topological(scope(spark, d, 10, among=known), states, 10, trust, "exclude")
    return rows.select("anchor", "record_id", "energy", "maturity", "rank")


def _hybrid(spark: SparkSession, d: str, weights: hybrid.Weights) -> DataFrame:
    """Records without a vector score by their wave alone, or all nothing where it has no weight, so ten of them are enough."""
    own = table(spark, d, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("vec"))
    s = cut(scope(spark, d, 10, ("energy", "node") if weights.wave else ("node",), always=own.select((F.col("vec_id") + CUSTOMERS).alias("node_id"))))
    pairs = s.select(F.col("anchor").alias("query_id"), F.col("record_id").alias("id"))
    anchors = own.select(F.col("vec_id").alias("query_id"), "vec").join(pairs.select("query_id").distinct(), "query_id", "left_semi")
    both = cut(vectors.pair_cosines(pairs, anchors, own, {"external": None, "native": 8}, "vec_id"))
    named = lambda c: both.filter(F.col(c).isNotNull()).select(F.col("query_id").alias("anchor"), F.col("id").alias("record_id"), F.col(c).alias("similarity"))
    rows = hybrid.fuse(s, named("external"), named("native"), customer_trust(spark, d), 10, weights, hybrid.trusted("ANY"))
    return rows.select("anchor", "record_id", F.round("score", 9).alias("score"), "maturity", "validity", "rank")


def hybrid_rank(spark: SparkSession, d: str) -> DataFrame:
    """Wave, external and native similarity fused with equal weights."""
    return _hybrid(spark, d, hybrid.Weights())


def hybrid_ablation(spark: SparkSession, d: str) -> DataFrame:
    """The same without the wave."""
    return _hybrid(spark, d, hybrid.Weights(0.0, 2.0, 1.0))


def structural_features(spark: SparkSession, d: str) -> DataFrame:
    """Features 0 to 23 and 40 to 47 of every node of the durable graph."""
    rows = structural.feature_rows(durable_edges(spark, d))
    return rows.groupBy("node_id", "feature").agg(F.sum("value").alias("value")).filter("value <> 0").withColumn("value", F.round(F.col("value") + OFF_TIES, 6))


def structural_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Unit structural vectors with wave features for the receipts' seeds."""
    from tidegraph.catalog.graph import receipt_seeds

    edges, seeds = durable_edges(spark, d), receipt_seeds(spark, d)
    waves = wave.best_first(edges, seeds, 3, 0.001, 256, tuple(range(1, 10)))
    near = structural.feature_rows(edges, waves).join(seeds, "node_id", "left_semi")
    rows = structural.vectors(near, seeds)
    return rows.select("node_id", F.size("vec").alias("dimension"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 5).alias("squared_norm"))


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """How often the nearest vectors share the query's label."""
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    got = vectors.search(vector_column(spark, d), query_vectors(spark, d), 10, "vec_id", same=False)
    got = got.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q")), "query_id").join(labels.select(F.col("vec_id").alias("id"), "label"), "id")
    per = metrics.retrieval(got.select("query_id", "rank", (F.col("q") == F.col("label")).alias("relevant")), 10)
    return metrics.overall(per)


_FUNCTIONS = (
    cosine_topk, cosine_scoped, vector_norms, vector_puts, semantic_trusted, topological_query, hybrid_rank, hybrid_ablation, structural_features, structural_vectors, retrieval_metrics,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_DOT = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))"
_NORM = lambda x: f"list_sum(list_transform({x}.v, lambda q: q * q))"
_VECTORS = "v AS (SELECT vec_id, label, list_transform(embedding, lambda q: CAST(q AS DOUBLE)) AS v FROM embeddings)"
_SIM = f"{_DOT} / (sqrt({_NORM('a')}) * sqrt({_NORM('b')}))"
_NEAR = f"n AS (SELECT a.vec_id AS query_id, b.vec_id AS id, a.label = b.label AS same, {_SIM} AS s FROM v a, v b WHERE a.vec_id % {EVERY} = 0)"
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)"

from tidegraph.catalog.ledgers import TRUST_SQL  # noqa: E402

_SCOPE = (
    f"{S.order_edges({4, 8, 10})},\n{S.attenuated('e')},\n"
    + S.wave("a", f"SELECT node_id AS seed, node_id FROM (SELECT CAST(3000000000 + c_custkey AS BIGINT) AS node_id FROM customer WHERE c_custkey % {EVERY} = 0)", 6, 0.2, (4, 8), "seed", factor="((f.energy * e.att) * e.w0) * CAST(1.0 AS DOUBLE)")
    + """,
sc AS (SELECT seed - 3000000000 AS anchor, node_id - 3000000000 AS record_id, round(max(energy), 12) AS energy FROM lv
  WHERE node_id >= 3000000000 AND node_id < 4000000000 AND seed <> node_id GROUP BY 1, 2)"""
)


def _fused(w: float, x: float, n: float) -> str:
    sim = lambda k: f"(SELECT a.vec_id AS anchor, b.vec_id AS record_id, greatest(0.0, least(1.0, ({_SIM} + 1.0) / 2.0)) AS s FROM {k} a, {k} b WHERE a.vec_id % {EVERY} = 0)"
    return f"""WITH {TRUST_SQL},
{_SCOPE},
{_VECTORS}, v8 AS (SELECT vec_id, label, v[1:8] AS v FROM v),
h AS (SELECT sc.anchor, sc.record_id, ({w} * greatest(0.0, least(1.0, sc.energy)) + coalesce({x} * x.s, 0.0) + coalesce({n} * y.s, 0.0))
  / nullif({w} + CASE WHEN x.s IS NULL THEN 0.0 ELSE {x} END + CASE WHEN y.s IS NULL THEN 0.0 ELSE {n} END, 0.0) AS score
  FROM sc LEFT JOIN {sim('v')} x ON sc.anchor = x.anchor AND sc.record_id = x.record_id LEFT JOIN {sim('v8')} y ON sc.anchor = y.anchor AND sc.record_id = y.record_id)
SELECT anchor, h.record_id, round(coalesce(score, 0.0), 9) AS score, coalesce(maturity, 'RAW') AS maturity, coalesce(validity, 'ACTIVE') AS validity,
  row_number() OVER (PARTITION BY anchor ORDER BY coalesce(score, 0.0) DESC, h.record_id) AS rank FROM h LEFT JOIN current t ON h.record_id = CAST(t.record_id AS BIGINT) QUALIFY rank <= 10"""


_TYPE = lambda side, base: f"SELECT {side} AS node_id, edge_type % 8 + {base} AS feature, sum(weight) AS value FROM e GROUP BY 1, 2"
SQL = {
    "cosine_topk": f"WITH {_VECTORS}, {_NEAR} SELECT query_id, id, round(s, 9) AS similarity, {_RANK} AS rank FROM n QUALIFY rank <= 10",
    "cosine_scoped": f"WITH {_VECTORS}, {_NEAR} SELECT query_id, id, round(s, 9) AS similarity, {_RANK} AS rank FROM n WHERE same QUALIFY rank <= 5",
    "vector_norms": f"WITH {_VECTORS} SELECT vec_id, round({_NORM('v')}, 6) AS squared_norm, len(v) = 64 AS right_size FROM v",
    "vector_puts": """SELECT label, CASE WHEN vec_id % 2 = 1 THEN 'INSERTED' WHEN vec_id % 6 = 0 AND list_reverse(embedding) <> embedding THEN 'UPDATED' ELSE 'UNCHANGED' END AS outcome,
count(*) AS n, CAST(sum(CASE WHEN vec_id % 6 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS generations FROM embeddings GROUP BY 1, 2""",
    "semantic_trusted": f"""WITH {TRUST_SQL},
{_VECTORS}, {_NEAR}
SELECT query_id, id, round(s, 9) AS similarity, {_RANK} AS rank FROM n LEFT JOIN current t ON n.id = CAST(t.record_id AS BIGINT) WHERE coalesce(validity, 'ACTIVE') = 'ACTIVE' QUALIFY rank <= 10""",
    "topological_query": f"""WITH {TRUST_SQL},
{_SCOPE}
SELECT anchor, sc.record_id, energy, maturity, row_number() OVER (PARTITION BY anchor ORDER BY energy DESC, sc.record_id) AS rank
FROM sc JOIN current t ON sc.record_id = CAST(t.record_id AS BIGINT) WHERE maturity <> 'RAW' QUALIFY rank <= 10""",
    "hybrid_rank": _fused(1.0, 1.0, 1.0),
    "hybrid_ablation": _fused(0.0, 2.0, 1.0),
    "structural_features": f"""WITH {S.durable_edges()},
o AS (SELECT src, count(*) AS c, sum(weight) AS w FROM e GROUP BY 1), i AS (SELECT dst, count(*) AS c, sum(weight) AS w FROM e GROUP BY 1),
p AS (SELECT DISTINCT src, dst FROM e),
f AS (SELECT src AS node_id, 0 AS feature, ln(1 + c) AS value FROM o UNION ALL SELECT dst, 1, ln(1 + c) FROM i UNION ALL SELECT src, 2, w / c FROM o UNION ALL SELECT dst, 3, w / c FROM i
  UNION ALL SELECT p.src, 4, count(*) FROM p JOIN p q ON p.src = q.dst AND p.dst = q.src GROUP BY 1
  UNION ALL SELECT src, 5, count(*) FROM p GROUP BY 1 UNION ALL SELECT dst, 6, count(*) FROM p GROUP BY 1
  UNION ALL SELECT e.src, 7, ln(1 + sum(greatest(i.c - 1, 0))) FROM e JOIN i ON e.dst = i.dst GROUP BY 1
  UNION ALL {_TYPE('src', 8)} UNION ALL {_TYPE('dst', 16)}
  UNION ALL SELECT a.src, (a.edge_type * 131 + b.edge_type * 17) % 8 + 40, sum(a.weight * b.w) FROM e a JOIN (SELECT src, edge_type, sum(weight) AS w FROM e GROUP BY 1, 2) b ON a.dst = b.src GROUP BY 1, 2)
SELECT node_id, feature, round(value + {OFF_TIES}, 6) AS value FROM (SELECT node_id, CAST(feature AS INTEGER) AS feature, sum(value) AS value FROM f GROUP BY 1, 2) WHERE value <> 0""",
    "retrieval_metrics": f"""WITH {_VECTORS}, {_NEAR}, r AS (SELECT query_id, same, {_RANK} AS rank FROM n WHERE query_id <> id QUALIFY rank <= 10),
q AS (SELECT query_id, sum(CASE WHEN same THEN 1 ELSE 0 END) AS k, max(CASE WHEN rank = 1 AND same THEN 1 ELSE 0 END) AS top1, coalesce(max(CASE WHEN same THEN 1.0 / rank END), 0.0) AS rr,
  sum(CASE WHEN same THEN 1.0 / log2(rank + 1) ELSE 0 END) AS dcg FROM r GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(k / 10.0), 9) AS precision, round(avg(top1), 9) AS top1, round(avg(rr), 9) AS reciprocal_rank,
  round(avg(CASE WHEN k > 0 THEN dcg / list_sum(list_transform(range(1, CAST(k AS BIGINT) + 1), lambda i: 1.0 / log2(i + 1))) ELSE 0 END), 9) AS ndcg, count(*) FILTER (k = 0) AS zero_hits FROM q""",
}
