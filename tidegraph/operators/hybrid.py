"""Trust filters and rankings that fuse wave energy, vector similarity and structure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.text import maturity_rank
from tidegraph.operators.wave import ranked


@dataclass(frozen=True)
class Weights:
    """Weights of the wave, the external and the native component: finite, not negative, not all zero."""

    wave: float = 1.0
    external: float = 1.0
    native: float = 1.0

    def __post_init__(self) -> None:
        all_ = (self.wave, self.external, self.native)
        if any(not (0 <= w < float("inf")) for w in all_) or not any(all_):
            raise ValueError("weights must be finite, not negative and not all zero")


def with_trust(rows: DataFrame, states: DataFrame, unknown: str = "raw") -> DataFrame:
    """Rows with maturity and validity of their record. Records without a state count as RAW and ACTIVE, or are left out
    (``unknown`` raw or exclude)."""
    s = states.select("record_id", "maturity", "validity")
    if unknown == "exclude":
        return rows.join(s, "record_id")
    if unknown != "raw":
        raise ValueError(f"unknown policy {unknown}")
    return rows.join(s, "record_id", "left").withColumns({"maturity": F.coalesce("maturity", F.lit("RAW")), "validity": F.coalesce("validity", F.lit("ACTIVE"))})


def trusted(kind: str, at_least: str = "RAW") -> Column:
    """The filter ANY, ACTIVE_ONLY, MATURITY_AT_LEAST or VERIFIED_ACTIVE_ONLY over maturity and validity."""
    active = F.col("validity") == "ACTIVE"
    return {
        "ANY": F.lit(True),
        "ACTIVE_ONLY": active,
        "MATURITY_AT_LEAST": maturity_rank(F.col("maturity")) >= maturity_rank(F.lit(at_least)),
        "VERIFIED_ACTIVE_ONLY": active & (F.col("maturity") == "VERIFIED"),
    }[kind]


def unit(cosine: Column) -> Column:
    """A cosine as 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine + 1.0) / 2.0))


def topological(scope: DataFrame, states: DataFrame, k: int, trust: Column, unknown: str = "raw") -> DataFrame:
    """Per anchor, the ``k`` records of a wave scope with the greatest energy that pass the trust filter."""
    rows = with_trust(scope, states, unknown).filter(trust)
    return ranked(rows, [F.col("energy").desc(), F.col("record_id")], k, ["anchor"])


def fuse(scope: DataFrame, external: DataFrame, native: DataFrame, states: DataFrame, k: int, weights: Weights, trust: Column, unknown: str = "raw") -> DataFrame:
    """Per anchor, the ``k`` best records by the weighted mean of the components that are there.

    ``scope`` has anchor, record_id, energy; ``external`` and ``native`` have anchor, record_id, similarity, each perhaps
    without some records, which then count by their other components alone. Trust filters and never scores. Ties go to
    the smaller record_id.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    key = ["anchor", "record_id"]
    rows = scope.select(*key, "node_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "energy")).alias("wave"))
    rows = rows.join(external.select(*key, unit(F.col("similarity")).alias("external")), key, "left").join(native.select(*key, unit(F.col("similarity")).alias("native")), key, "left")
    total, over = F.col("wave") * weights.wave, F.lit(weights.wave)
    for c, w in (("external", weights.external), ("native", weights.native)):
        total = total + F.coalesce(F.col(c) * w, F.lit(0.0))
        over = over + F.when(F.col(c).isNotNull(), w).otherwise(0.0)
    rows = rows.withColumn("score", F.when(over > 0, total / over).otherwise(0.0))
    rows = with_trust(rows, states, unknown).filter(trust)
    return ranked(rows, [F.col("score").desc(), F.col("record_id")], k, ["anchor"])
