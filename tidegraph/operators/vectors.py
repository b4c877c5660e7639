"""Vector columns and exact cosine search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.config import MAX_DIMENSION
from tidegraph.functions.hashing import content_id
from tidegraph.operators.wave import ranked

#: Query vectors held by a task at once; more are done in further passes.
QUERY_BLOCK = 4_096
#: Cells of a tile of queries by vectors.
TILE = 1 << 20


def space_id(provider: Column, model: Column, revision: Column, dimension: Column) -> Column:
    """A vector space's id from what defines it."""
    return content_id(provider, model, revision, dimension)


def invalid(vectors: DataFrame, dimension: int, vec: str = "vec") -> DataFrame:
    """Rows whose vector is null, of another dimension, of zero length, or holds a null, NaN or infinite part."""
    if not 0 < dimension <= MAX_DIMENSION:
        raise ValueError(f"dimensions are 1..{MAX_DIMENSION}")
    v = F.col(vec)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    none = F.forall(v, lambda x: x == 0)
    return vectors.filter(v.isNull() | (F.size(v) != dimension) | odd | none)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision, added up in the order of the parts; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def put(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """Effect of putting ``new`` (record_id, vec): outcome INSERTED, UPDATED or UNCHANGED, and the generation.

    Unchanged are parts that are written alike: -0.0 isn't 0.0 here, and NaN is NaN."""
    had = vectors.select("record_id", F.col("vec").alias("had"), F.col("generation").alias("g"))
    rows = new.join(had, "record_id", "left")
    outcome = F.when(F.col("had").isNull(), "INSERTED").when(F.col("had").cast("string").eqNullSafe(F.col("vec").cast("string")), "UNCHANGED").otherwise("UPDATED")
    return rows.select("record_id", "vec", outcome.alias("outcome"), (F.coalesce("g", F.lit(0)) + F.when(outcome == "UNCHANGED", 0).otherwise(1)).cast("long").alias("generation"))


def import_batch(imports: DataFrame, batch: DataFrame) -> DataFrame:
    """Per idempotency key of ``batch`` (key, record_id, vec): DUPLICATE if it was imported with the same digest, CONFLICT if
    with another or if it repeats a record, else NEW."""
    row = F.xxhash64("record_id", F.col("vec").cast("string"))
    digest = batch.groupBy("key").agg(F.sum(F.pmod(row, F.lit(1 << 40))).cast("long").alias("digest"), F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("d"))
    out = digest.join(imports.select("key", F.col("digest").alias("had")), "key", "left")
    status = F.when(F.col("n") != F.col("d"), "CONFLICT").when(F.col("had").isNull(), "NEW").when(F.col("had") == F.col("digest"), "DUPLICATE").otherwise("CONFLICT")
    return out.select("key", "digest", status.alias("status"))


def _by_size(ids: pd.Series, vecs: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors of each dimension; null vectors fall away."""
    sized: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids, vecs, strict=True):
        if v is not None and len(v):
            mine = sized.setdefault(len(v), ([], []))
            mine[0].append(i)
            mine[1].append(v)
    return {n: (np.array(i), np.asarray(v, np.float64)) for n, (i, v) in sized.items()}


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, added up in the order of their parts."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def _nearest(qids: np.ndarray, qs: np.ndarray, ids: np.ndarray, vs: np.ndarray, k: int, same: bool) -> pd.DataFrame:
    """The ``k`` nearest of a tile per query. A matrix product finds all that can be among them, up to its rounding; their
    cosines are then added up in order, so that the ranking doesn't depend on how the product was blocked."""
    nq, nv = np.sqrt(_in_order(qs, qs)), np.sqrt(_in_order(vs, vs))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        rough = (qs @ vs.T) / (nq[:, None] * nv[None, :])
    rough[~np.isfinite(rough)] = -np.inf
    if not same:
        rough[qids[:, None] == ids[None, :]] = -np.inf
    least = np.partition(rough, -k, axis=1)[:, -k] if k < len(ids) else np.full(len(qids), -2.0)
    row, col = np.nonzero(rough >= np.maximum(least - 1e-9, -2.0)[:, None])
    exact = _in_order(qs[row], vs[col]) / (nq[row] * nv[col])
    order = np.lexsort((ids[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return pd.DataFrame({"query_id": qids[row[keep]], "id": ids[col[keep]], "similarity": exact[keep]})


def pair_cosines(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, heads: dict[str, int | None], vec_id: str = "record_id", vec: str = "vec") -> DataFrame:
    """(query_id, id, a column for each head): cosines of given pairs (query_id, id), each over the first parts that its head
    names (None: all). A pair of a vector that is missing, or of two dimensions, is left out; a head in which a vector has
    no length is null.

    The pairs meet the vectors first and take them along alone; query vectors are broadcast while they are counted to be
    few. All heads come out of one pass over batches, added up in the order of the parts.
    """
    kinds = dict(pairs.dtypes)
    q = queries.select("query_id", F.col("vec").alias("__q")).filter("__q IS NOT NULL")
    if q.count() <= QUERY_BLOCK:
        q = F.broadcast(q)
    rows = pairs.select("query_id", "id").join(vectors.select(F.col(vec_id).alias("id"), F.col(vec).alias("__v")), "id").join(q, "query_id")
    rows = rows.filter(F.size("__q") == F.size("__v")).select("query_id", "id", "__q", "__v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf["__v"].map(len)):
                a, b = (np.array(part[c].tolist(), np.float64) for c in ("__q", "__v"))
                out = part[["query_id", "id"]].copy()
                for name, n in heads.items():
                    x, y = a[:, :n], b[:, :n]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        cos = _in_order(x, y) / (np.sqrt(_in_order(x, x)) * np.sqrt(_in_order(y, y)))
                    out[name] = pd.Series(cos, out.index).where(np.isfinite(cos), None)
                yield out

    return rows.mapInPandas(run, ", ".join([f"query_id {kinds['query_id']}", f"id {kinds['id']}", *[f"{h} double" for h in heads]]))


def search(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "record_id", vec: str = "vec", same: bool = True, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` vectors nearest to each query (query_id, vec) by exact cosine, similarity
    descending and id ascending. Vectors that are null, zero or of another dimension match nothing; nor do such queries.
    ``allowed`` (query_id, id) restricts each query to its own candidates. ``same=False`` leaves out a query's own id.

    All queries meet all vectors, in tiles: each pass holds QUERY_BLOCK queries in every task, whose vectors keep their
    own ``k`` per query before anything is shuffled. Parts are added in order in double precision, so that equal vectors
    tie exactly wherever they are.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if allowed is not None:
        q = queries.select("query_id", F.col("vec").alias("__q"))
        rows = allowed.join(q, "query_id").join(vectors.select(F.col(vec_id).alias("id"), F.col(vec).alias("__v")), "id")
        rows = rows.filter(F.size("__q") == F.size("__v")).withColumn("similarity", cosine(F.col("__q"), F.col("__v"))).filter("similarity IS NOT NULL AND NOT isnan(similarity)")
        rows = rows.select("query_id", "id", "similarity")
    else:
        spark = vectors.sparkSession
        kind = dict(vectors.dtypes)[vec_id]
        many = queries.select("query_id", "vec").filter("vec IS NOT NULL")
        n = many.count()
        rows = None
        numbered = ranked(many, [F.col("query_id")], None) if n > QUERY_BLOCK else None
        for at in range(0, max(n, 1), QUERY_BLOCK):
            block = many if numbered is None else numbered.filter(F.col("rank").between(at + 1, at + QUERY_BLOCK)).drop("rank")
            held = spark.sparkContext.broadcast(block.toPandas())

            def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
                sized = _by_size(held.value["query_id"], held.value["vec"])
                for pdf in batches:
                    for size, (ids, vs) in _by_size(pdf["id"], pdf["v"]).items():
                        if size in sized:
                            qids, qs = sized[size]
                            step = max(1, TILE // len(ids))
                            for a in range(0, len(qids), step):
                                yield _nearest(qids[a : a + step], qs[a : a + step], ids, vs, k, same)

            qkind = dict(queries.dtypes)["query_id"]
            found = vectors.select(F.col(vec_id).alias("id"), F.col(vec).alias("v")).mapInPandas(run, f"query_id {qkind}, id {kind}, similarity double")
            rows = found if rows is None else rows.union(found)
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
