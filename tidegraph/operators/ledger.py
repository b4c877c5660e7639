"""Replaying append-only ledgers: states by transitions, chains, versions, lineage, counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.text import MATURITY
from tidegraph.plans.lineage import cut

# States of a record as maturity x validity (and untracked, state 0), and the operations on them.
VALIDITY = ["ACTIVE", "DISPUTED", "EXPIRED", "REVOKED", "SUPERSEDED"]
STATES = [None, *((m, v) for m in MATURITY for v in VALIDITY)]
OPERATIONS = ["PROPOSE", "PROMOTE", "DISPUTE", "EXPIRE", "REVOKE", "SUPERSEDE"]


def transition_table() -> np.ndarray:
    """For each operation and state the next state; -1 where the operation is illegal. A table of data, from one rule a row."""
    number = {s: i for i, s in enumerate(STATES)}
    out = np.full((len(OPERATIONS), len(STATES)), -1)
    out[0, 0] = number["RAW", "ACTIVE"]
    for i, m in enumerate(MATURITY):
        at = lambda v, m=m: number[m, v]
        if i + 1 < len(MATURITY):
            out[1, at("ACTIVE")] = number[MATURITY[i + 1], "ACTIVE"]
        out[2, at("ACTIVE")] = at("DISPUTED")
        out[3, [at("ACTIVE"), at("DISPUTED")]] = at("EXPIRED")
        open_ = [at("ACTIVE"), at("DISPUTED"), at("EXPIRED")]
        out[4, open_], out[5, open_] = at("REVOKED"), at("SUPERSEDED")
    return out


def replay(events: DataFrame, key: str, sequence: str, operation: str, partitions: int | None = None) -> DataFrame:
    """Events with ``legal``, ``previous_state`` and ``next_state`` (numbers in STATES), applied in sequence per key; an illegal
    event, also of an unknown operation, leaves the state as it is. Repeated sequences count in the order of operations.

    An operation is a function on the few states and functions compose, so a key with very many events isn't one task:
    sorted ranges of (key, sequence) each give one composed function per key; those of a key, applied in order, give the
    state that each range begins with; then every range replays its own events.
    """
    table = transition_table()
    n = len(STATES)
    step = np.where(table >= 0, table, np.arange(n)[None, :])
    number = {o: i for i, o in enumerate(OPERATIONS)}
    parts = partitions or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.repartitionByRange(parts, key, sequence, operation).sortWithinPartitions(key, sequence, operation)
    rows = cut(rows.withColumn("__part", F.spark_partition_id()))
    kinds = dict(events.dtypes)
    identity = np.arange(n)

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, f, out = (None, None), identity, []
        for pdf in batches:
            for p, k, o in zip(pdf["__part"], pdf[key], pdf[operation], strict=True):
                if at != (p, k):
                    if at[0] is not None:
                        out.append((*at, f.tolist()))
                    at, f = (p, k), identity
                if o in number:
                    f = step[number[o]][f]
        if at[0] is not None:
            out.append((*at, f.tolist()))
        yield pd.DataFrame(out, columns=["__part", key, "f"])

    functions = rows.select("__part", key, operation).mapInPandas(compose, f"__part int, {key} {kinds[key]}, f array<int>")
    # A key spans at most ``partitions`` ranges, so its functions fit one row.
    w = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.aggregate(F.collect_list("f").over(w), F.lit(0), lambda s, f: F.get(f, s))
    starts = functions.withColumn("__begin", begin).drop("f")
    marked = rows.join(starts.select(F.col("__part").alias("__p"), F.col(key).alias("__k"), "__begin"), (F.col("__part") == F.col("__p")) & F.col(key).eqNullSafe(F.col("__k"))).drop("__p", "__k")
    marked = marked.repartition("__part", key).sortWithinPartitions("__part", key, sequence, operation)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = (None, None), 0
        for pdf in batches:
            legal, before, after = [], [], []
            for p, k, o, b in zip(pdf["__part"], pdf[key], pdf[operation], pdf["__begin"], strict=True):
                if at != (p, k):
                    at, state = (p, k), b
                before.append(state)
                ok = o in number and table[number[o], state] >= 0
                state = int(table[number[o], state]) if ok else state
                legal.append(ok)
                after.append(state)
            yield pdf.drop(columns=["__part", "__begin"]).assign(legal=legal, previous_state=before, next_state=after)

    kept = ", ".join(f"`{c}` {t}" for c, t in events.dtypes)
    return marked.select(*events.columns, "__part", "__begin").mapInPandas(apply, f"{kept}, legal boolean, previous_state int, next_state int")


def state_names(state: Column) -> tuple[Column, Column]:
    """Maturity and validity of a state number; null for untracked."""
    some = state > 0
    maturity = F.get(F.array(*[F.lit(m) for m in MATURITY]), F.floor((state - 1) / len(VALIDITY)).cast("int"))
    return F.when(some, maturity).alias("maturity"), F.when(some, F.get(F.array(*[F.lit(v) for v in VALIDITY]), (state - 1) % len(VALIDITY))).alias("validity")


def current_states(replayed: DataFrame, key: str, sequence: str) -> DataFrame:
    """(record_id, maturity, validity) after the last legal event of each key; map-side combine keeps hot keys cheap."""
    last = replayed.filter("legal").groupBy(key).agg(F.max(F.struct(sequence, "next_state")).getField("next_state").alias("s"))
    return last.select(F.col(key).alias("record_id"), *state_names(F.col("s")))


def latest(rows: DataFrame, keys: list[str], sequence: str, columns: list[str]) -> DataFrame:
    """The columns of each key's row with the highest sequence; of equal ones the greatest columns."""
    best = rows.groupBy(*keys).agg(F.max(F.struct(sequence, *columns)).alias("b"))
    return best.select(*keys, F.col(f"b.{sequence}").alias(sequence), *[F.col(f"b.{c}").alias(c) for c in columns])


def chain_breaks(events: DataFrame, sequence: str, digest: str, previous: str, clock: str) -> DataFrame:
    """(sequence, reason) where a global chain breaks: SEQUENCE (no row before it, but the first), DIGEST (its previous digest
    isn't the digest before), CLOCK (time doesn't grow).

    Dense sequences let every row find the row before it by an equi-join on sequence - 1, which spreads over the cluster
    where a lag over the whole ledger would sort it in one task.
    """
    first = events.agg(F.min(sequence)).scalar()
    before = events.select((F.col(sequence) + 1).alias(sequence), F.col(digest).alias("__d"), F.col(clock).alias("__c"), F.lit(True).alias("__has"))
    rows = events.join(before, sequence, "left").filter(F.col(sequence) != first)
    reason = F.when(F.col("__has").isNull(), "SEQUENCE").when(~F.col(previous).eqNullSafe(F.col("__d")), "DIGEST").when(~F.coalesce(F.col(clock) > F.col("__c"), F.lit(False)), "CLOCK")
    return rows.select(sequence, reason.alias("reason")).filter("reason IS NOT NULL")


def version_gaps(events: DataFrame, keys: list[str], version: str) -> DataFrame:
    """(keys, n_versions, max_version, n_missing): keys whose distinct versions aren't 1, 2, 3 and so on."""
    per = events.dropna(subset=[*keys, version]).groupBy(*keys).agg(F.count_distinct(version).alias("n_versions"), F.max(version).alias("max_version"))
    return per.withColumn("n_missing", F.col("max_version") - F.col("n_versions")).filter("n_missing <> 0")


def thresholds(votes: DataFrame, request: list[str], voter: str, weight: Column, quorum: DataFrame, excluded: str | None = None) -> DataFrame:
    """(request, weight, n_voters, reached): distinct voters' weights against each request's quorum (request, quorum).

    A voter counts once a request, with the greatest weight; the voter named by the column ``excluded`` doesn't count.
    """
    rows = votes if excluded is None else votes.filter(F.col(voter) != F.col(excluded))
    one = rows.groupBy(*request, voter).agg(F.max(weight).alias("w"))
    per = one.groupBy(*request).agg(F.sum("w").alias("weight"), F.count(F.lit(1)).alias("n_voters"))
    out = quorum.join(per, request, "left")
    return out.select(*request, F.coalesce("weight", F.lit(0)).alias("weight"), F.coalesce("n_voters", F.lit(0)).alias("n_voters"), (F.coalesce("weight", F.lit(0)) >= F.col("quorum")).alias("reached"))


def permitted(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """Requests with ``reason``: null if their policy (policy_id, authority, operations bits, min_evidence, max_evidence, verifier,
    unique_provenance) allows them, else what stands against it first: POLICY, AUTHORITY, OPERATION, EVIDENCE, VERIFIER, PROVENANCE."""
    p = policies.select("policy_id", *[F.col(c).alias(f"__{c}") for c in ("authority", "operations", "min_evidence", "max_evidence", "verifier", "unique_provenance")], F.lit(True).alias("__has"))
    rows = requests.join(p, "policy_id", "left")
    n = F.size("evidence")
    bit = F.call_function("shiftleft", F.lit(1), F.array_position(F.array(*[F.lit(o) for o in OPERATIONS]), F.col("operation")).cast("int") - 1)
    ids = F.transform("evidence", lambda e: e["provenance_id"])
    reason = (
        F.when(F.col("__has").isNull(), "POLICY").when(~F.col("authority").eqNullSafe(F.col("__authority")), "AUTHORITY")
        .when(F.coalesce(bit.bitwiseAND(F.col("__operations")), F.lit(0)) == 0, "OPERATION")
        .when((n < F.col("__min_evidence")) | (n > F.col("__max_evidence")), "EVIDENCE").when(~F.col("verifier").eqNullSafe(F.col("__verifier")), "VERIFIER")
        .when(F.col("__unique_provenance") & (F.size(F.array_distinct(ids)) < n), "PROVENANCE")
    )
    return rows.select(*requests.columns, reason.alias("reason"))


def open_journal(journal: DataFrame, key: str, sequence: str, stage: str, final: tuple[str, ...]) -> DataFrame:
    """Keys whose latest stage isn't final, with that stage."""
    return latest(journal, [key], sequence, [stage]).filter(~F.col(stage).isin(*final))


def metrics(events: DataFrame, by: list[str], amounts: list[str]) -> DataFrame:
    """Counts and sums by kind and outcome."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n_events"), *[F.sum(a).alias(f"sum_{a}") for a in amounts])


def prometheus(rows: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Counter rows as lines of the text exposition format."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    pairs = [F.concat(F.lit(f'{k}="'), esc(k), F.lit('"')) for k in labels]
    return rows.select(F.concat(F.lit(name + "{"), F.concat_ws(",", *pairs), F.lit("} "), F.col(value).cast("string")).alias("line"))
