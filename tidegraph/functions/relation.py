"""Folding a path of edge types into one relation, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.config import BLOCKED, BLOCKER, EDGE_TYPES, EMPTY, MASKED, RELATIONS, UNKNOWN


def type_names(path: Column) -> Column:
    """Names of an array of edge type ids; null for an unknown id."""
    names = F.create_map(*[F.lit(x) for i, n in EDGE_TYPES.items() for x in (i, n)])
    return F.transform(path, lambda t: names[t])


def derive(path: Column, rules: dict[tuple[str, str], str] | None = None) -> Column:
    """struct(relation, blocked, unknown_count, step_count) of an array of edge type names, by a left fold.

    An empty path gives the empty relation, a single type itself. A blocking type anywhere blocks the path; folding stops
    there, so later steps count no more. A pair without a rule gives the unknown relation and counts.
    """
    rules = RELATIONS if rules is None else rules
    table = F.create_map(*[F.lit(x) for (a, b), r in sorted(rules.items()) for x in (f"{a}|{b}", r)])
    stop = F.lit(EDGE_TYPES[BLOCKER])
    start = F.struct(F.lit(None).cast("string").alias("relation"), F.lit(False).alias("blocked"), F.lit(0).alias("unknown_count"), F.lit(-1).alias("step_count"))

    def step(acc: Column, x: Column) -> Column:
        shut = (acc["relation"] == stop) | (x == stop)
        met = F.coalesce(table[F.concat_ws("|", acc["relation"], x)], F.lit(UNKNOWN))
        first = acc["step_count"] < 0
        relation = F.when(first, x).when(shut, F.lit(BLOCKED)).otherwise(met)
        unknown = acc["unknown_count"] + F.when(~first & ~F.coalesce(shut, F.lit(False)) & (met == UNKNOWN), 1).otherwise(0)
        new = F.struct(relation.alias("relation"), (F.coalesce(shut, F.lit(False)) & ~first).alias("blocked"), unknown.alias("unknown_count"), (acc["step_count"] + 1).alias("step_count"))
        return F.when(acc["blocked"], acc).otherwise(new)

    def end(acc: Column) -> Column:
        alone = (acc["step_count"] == 0) & (acc["relation"] == stop)
        relation = F.when(acc["step_count"] < 0, F.lit(EMPTY)).when(alone, F.lit(BLOCKED)).otherwise(acc["relation"])
        return F.struct(relation.alias("relation"), (acc["blocked"] | F.coalesce(alone, F.lit(False))).alias("blocked"), acc["unknown_count"].alias("unknown_count"), F.greatest(acc["step_count"], F.lit(0)).alias("step_count"))

    return F.aggregate(path, start, step, end)


def masked(path: Column, allowed: Iterable[str]) -> Column:
    """The path with types that are neither allowed nor blocking replaced by a placeholder."""
    keep = [*allowed, EDGE_TYPES[BLOCKER]]
    return F.transform(path, lambda t: F.when(t.isin(*keep), t).otherwise(F.lit(MASKED)))


def rule_conflicts(rules: DataFrame) -> DataFrame:
    """(left, right) with more than one result among rule rows (left, right, result, commutative)."""
    both = rules.select("left", "right", "result").union(rules.filter("commutative AND left <> right").select("right", "left", "result"))
    return both.groupBy("left", "right").agg(F.count_distinct("result").alias("n_results")).filter("n_results > 1")
