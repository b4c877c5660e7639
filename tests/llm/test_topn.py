from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tidegraph.llm import topn

SCHEMA = "receipt_id long, seed_node long, node_id long, record_id long, energy_score double, rank int, position string"
RECEIPTS = "receipt_id long, seed_nodes array<long>, preset string"


def brute(rows, receipts, n):
    seeds = {(r, s) for r, ss, _ in receipts for s in ss or [] if s is not None and r is not None}
    groups: dict = {}
    key = lambda s, k: (-s, k is None, k or 0)
    for r, s, node, rec, score, rank, _ in rows:
        if (r, s) in seeds and score is not None and not math.isnan(score):
            item = groups.setdefault((r, s), {})
            new = key(score + 0.0, rank)
            item[node, rec] = min(item.get((node, rec), new), new)
    out = []
    for g, items in groups.items():
        order = sorted((v, i[0] is None, i[0] or 0, i[1] is None, i[1] or 0, i) for i, v in items.items())
        out += [(*g, *x[-1], p) for p, x in enumerate(order[:n], 1)]
    return sorted(out, key=repr)


def data(seed=1):
    r = random.Random(seed)
    score = lambda: r.choice([None, float("nan"), -0.0, 0.0, 0.5, 0.5, float("inf"), r.random()])
    rows = [(r.choice([1, 1, 1, 1, 2, 3, None]), r.choice([7, 7, 8, None]), r.choice([None, *range(8)]), r.randrange(9), score(), r.choice([None, 1, 2]), "clash") for _ in range(900)]
    return rows, [(1, [7, 8, 7, None], "a"), (1, [7], None), (2, None, "b"), (3, [8], "c"), (None, [7], "d")]


def test_equals_brute_force_whatever_is_hot(spark):
    rows, receipts = data()
    a, b = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(receipts, RECEIPTS)
    want = brute(rows, receipts, 5)
    for hot in (1, 30, 10_000):
        got = topn.best_candidates(a, b, 5, hot_rows=hot, parts=4)
        assert sorted(((r["receipt_id"], r["seed_node"], r["node_id"], r["record_id"], r["position"]) for r in got.collect()), key=repr) == want


def test_plain_top_n_with_null_groups_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (None, 2), ("a", 5)], "g string, v int")
    for hot in (1, 100):
        got = sorted(((r["g"], r["v"], r["position"]) for r in topn.top_n(df, ["g"], [F.col("v").desc()], 2, hot, 0.0, 3).collect()), key=repr)
        assert got == [("a", 5, 1), (None, 2, 1), (None, 2, 2)]
    assert topn.top_n(df.limit(0), ["g"], [F.col("v")], 2).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(df, ["g"], [F.col("v")], 0)


def test_no_task_sees_a_group_whole_that_holds_a_third_of_the_rows(spark):
    n = 30_000
    rows = [(1, 1, i, i, float(i * 7919 % 1000), i) for i in range(n // 3)] + [(i % 500, 2, i, i, float(i % 37), None) for i in range(n - n // 3)]
    candidates = spark.createDataFrame(rows, "receipt_id long, seed_node long, node_id long, record_id long, energy_score double, rank int")
    group = ["receipt_id", "seed_node"]
    one = topn.one_candidate(candidates, group, ["node_id", "record_id"], "energy_score", "rank")
    order = [F.col("energy_score").desc(), F.col("rank").asc_nulls_last(), F.col("node_id"), F.col("record_id")]
    salted = one.filter("seed_node = 1").repartitionByRange(8, *[F.col(g) for g in group], *order).withColumn("part", F.spark_partition_id())
    spread = salted.groupBy("part").count().agg(F.max("count")).first()[0]
    assert spread < n // 3 / 3
    receipts = spark.createDataFrame([(1, [1, 2]), (7, [2])], "receipt_id long, seed_nodes array<long>")
    got = topn.best_candidates(candidates, receipts, hot_rows=1000, hot_share=0.01)
    best = sorted((r for r in rows if r[:2] == (1, 1)), key=lambda r: (-r[4], r[5], r[2], r[3]))[:5]
    assert sorted(tuple(r)[2:4] for r in got.filter("receipt_id = 1 AND seed_node = 1").collect()) == sorted(r[2:4] for r in best)
    assert got.count() == 15
