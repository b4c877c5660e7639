"""References to records that are missing, deleted or arrive later."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.plans.lineage import cut
from tidegraph.plans.skew import salted_join


Pairs = Sequence[tuple[str, str]]


def orphans(
    refs: DataFrame, targets: DataFrame, keys: Pairs | dict[str, Pairs], match: str = "simple", ref_id: str | None = None, moment: str | None = None
) -> DataFrame:
    """The rows of ``refs`` whose key names no row of ``targets``, with ``null_mask`` (bit i: the i-th key column is null).

    ``keys`` pairs each reference column with its target column; a dictionary declares several keys by name, each of
    which a row may break, and adds the name as ``ref_column``. References are grouped by their null mask; each mask is
    anti-joined on its non-null columns alone, masks that agree in these in one join. ``match`` follows the SQL
    standard: ``simple``: a key with any null refers to nothing and is never an orphan; ``full``: all null refers to
    nothing, partly null is always an orphan; ``partial``: the non-null part must agree with some target. A key of nulls
    alone is never an orphan. Repeated references come out as often as they stand there. Hot keys are split (``ref_id``:
    a column to split by, else all columns).

    With ``moment``, a column of times, targets stand for spans of life (``begin`` to before ``end``, see ``lifetimes``)
    and one must hold the moment. Then ``reason`` is added: ``missing`` if no target agrees, ``deleted`` if one that does
    began earlier, ``late`` if all begin later (a partly null key that ``full`` refuses is ``missing``).
    """
    if match not in ("simple", "full", "partial"):
        raise ValueError(f"unknown match {match}")
    named = keys if isinstance(keys, dict) else {"": keys}
    columns = list(dict.fromkeys(r for pairs in named.values() for r, _ in pairs))
    mask = F.lit(0)
    for i, r in enumerate(columns):
        mask = mask + F.when(F.col(r).isNull(), F.lit(1 << i)).otherwise(F.lit(0))
    marked = refs.withColumn("null_mask", mask)
    kept = [*refs.columns, "null_mask", *["ref_column"] * isinstance(keys, dict)]
    if moment:
        marked, targets = cut(marked), cut(targets)
    groups: dict[tuple[str, ...], DataFrame] = {}
    for name, pairs in named.items():
        own = sum(1 << columns.index(r) for r, _ in pairs)
        for bits in product((0, 1), repeat=len(pairs)):
            number = sum(b << columns.index(r) for (r, _), b in zip(pairs, bits, strict=True))
            used = [k for k, b in zip(pairs, bits, strict=True) if not b]
            if not used or (number and match == "simple"):
                continue
            mine = marked.filter(F.col("null_mask").bitwiseAND(F.lit(own)) == number)
            on = () if number and match == "full" else tuple(f"__t_{t}" for _, t in used)
            mine = mine.select("*", *([F.lit(name).alias("ref_column")] if isinstance(keys, dict) else []), *[F.col(r).alias(f"__t_{t}") for r, t in used if on])
            groups[on] = groups[on].unionByName(mine) if on in groups else mine
    spread = F.col(ref_id) if ref_id else F.struct(*refs.columns)
    out: DataFrame | None = None
    for on, mine in groups.items():
        if on:
            there = targets.select(*[F.col(t.removeprefix("__t_")).alias(t) for t in on], *["begin", "end"] * bool(moment)).dropna(subset=list(on))
            mine = _at_moment(mine, there, list(on), spread, moment) if moment else salted_join(mine, there.distinct(), list(on), "left_anti", spread)
        elif moment:
            mine = mine.withColumn("reason", F.lit("missing"))
        mine = mine.select(*kept, *["reason"] * bool(moment))
        out = mine if out is None else out.unionByName(mine)
    assert out is not None
    return out


def _at_moment(refs: DataFrame, spans: DataFrame, on: list[str], spread: Column, moment: str) -> DataFrame:
    """References that no span of their key holds at their moment, with ``reason``. The anti-join runs first, on key and
    moment; only its few survivors, kept, meet the first begin of their key."""
    held = F.col("__begin") <= F.col(moment)
    spans = spans.withColumnsRenamed({"begin": "__begin", "end": "__end"})
    out = cut(salted_join(refs, spans.filter("__begin < __end"), on, "left_anti", spread, held & (F.col(moment) < F.col("__end"))))
    first = spans.groupBy(*on).agg(F.min(F.when(F.col("__begin") < F.col("__end"), F.col("__begin"))).alias("__first"), F.lit(True).alias("__known"))
    out = salted_join(out, first, on, "left", spread)
    return out.withColumn("reason", F.when(F.col("__known").isNull(), "missing").when(F.col("__first") <= F.col(moment), "deleted").otherwise("late"))


def lifetimes(rows: DataFrame, key: Column, record: Column, begin: str, end: str | None = None, salts: int = 32) -> DataFrame:
    """(key, begin, end): the disjoint spans in which some record of the key is live; end null: for ever.

    A record lives from the earliest ``begin`` of its rows until its earliest ``end``; one that ends before it begins
    keeps an empty span (begin = end), so that its key counts as known. Spans are merged within salted parts of a key
    first and across them after, so that a key with very many records isn't sorted in one task.
    """
    far = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    stop = F.coalesce(F.min(F.col(end).cast("timestamp_ntz")), far) if end else far
    spans = rows.select(key.alias("key"), record.alias("record"), *dict.fromkeys([begin, *[end] * bool(end)])).filter("key IS NOT NULL")
    spans = spans.groupBy("key", "record").agg(F.min(F.col(begin).cast("timestamp_ntz")).alias("b"), stop.alias("e"))
    spans = spans.select("key", F.pmod(F.xxhash64("record"), F.lit(salts)).alias("part"), "b", F.greatest("b", "e").alias("e"))

    def merged(df: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("b", "e")
        reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
        df = df.withColumn("isle", F.when(F.col("b") <= reach, 0).otherwise(1))
        df = df.withColumn("isle", F.sum("isle").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return df.groupBy(*by, "isle").agg(F.min("b").alias("b"), F.max("e").alias("e")).drop("isle")

    return merged(merged(spans, ["key", "part"]).drop("part"), ["key"]).select("key", F.col("b").alias("begin"), F.col("e").alias("end"))


def first_deliveries(refs: DataFrame, ref_key: str, columns: dict[str, Column], moment: str) -> DataFrame:
    """(ref_key, moment, columns): each reference once, as of its earliest ``moment``; rows with one ``ref_key`` are
    deliveries of the same. ``columns``: the values by name, null where a value is no reference."""
    rows = refs.select(ref_key, *[v.alias(c) for c, v in columns.items()], F.col(moment).cast("timestamp_ntz").alias("moment"))
    first = rows.groupBy(ref_key).agg(F.min(F.struct("moment", *columns)).alias("r"))
    return first.select(F.col(ref_key).cast("string").alias("ref_key"), "r.*")
