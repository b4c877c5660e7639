"""Best-first searches in compressed rows against the search by a heap."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.catalog import graph as queries
from tidegraph.operators import bestfirst, subgraph, wave
from tidegraph.operators.bestfirst import Rows, Search
from tidegraph.plans.lineage import cut, cut_by
from tidegraph.sources.graph import durable_records
from tidegraph.sources.tables import table

SCHEMA = "src long, dst long, edge_type int, weight double"
MASK = (1, 3, 4, 5)


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(5)
    return spark.createDataFrame([(r.randrange(15), r.randrange(15), r.choice([1, 3, 4, 5, 7, 10]), r.choice([0.5, 1.0, 0.25, 0.8])) for _ in range(120)], SCHEMA).cache()


@pytest.fixture(scope="module")
def seeds(spark):
    return spark.createDataFrame([(0,), (3,), (3,), (7,), (99,)], "node_id long").cache()


def test_merged_wave_takes_no_more_than_each_seeds_first_rows(graph, seeds):
    every = wave.best_first(graph, seeds, 3, 0.05, None, MASK)
    want = [tuple(r) for r in wave.merged_best(every, 6).orderBy("rank").collect()]
    assert want and [tuple(r) for r in wave.merged_wave(graph, seeds, 3, 0.05, 6, MASK).orderBy("rank").collect()] == want


def test_compressed_rows_give_the_rows_of_each_seeds_own_search(graph, seeds):
    """Held rows are searched in numpy, those of a seed by a heap: first rows, paths and lengths agree."""
    for top_k in (4, None):
        held, own = (sorted(map(tuple, wave.best_first(graph, seeds, 3, 0.05, top_k, MASK, kernel_edges=n).collect())) for n in (1000, 0))
        assert held and held == own
    search = Search(Rows.of(*wave.columns(graph), frozenset(MASK)), 3, 0.05, {t: 0.9 for t in MASK}, 1.0)
    assert len(search.run(0)[0]) > 1 and len(search.run(99)[0]) == 0


def test_chosen_rows_are_the_first_of_an_order_besides_those_always_wanted(graph, seeds):
    every = wave.best_first(graph, seeds, 3, 0.05, None, MASK).collect()
    always = graph.sparkSession.createDataFrame([(2,), (11,)], "node_id long")
    for order in (("energy", "node"), ("node",)):
        want = set()
        for seed in (0, 3, 7):
            mine = sorted((r for r in every if r["seed"] == seed and 1 <= r["node_id"] < 13), key=lambda r: [{"energy": -r["energy"], "node": r["node_id"]}[o] for o in order])
            want |= {(seed, r["node_id"]) for r in mine if r["node_id"] in (2, 11)} | {(seed, r["node_id"]) for r in [r for r in mine if r["node_id"] not in (2, 11)][:3]}
        for n in (1000, 0):
            got = wave.best_first(graph, seeds, 3, 0.05, 3, MASK, kernel_edges=n, order=order, among=(1, 13), always=always)
            assert {(r["seed"], r["node_id"]) for r in got.collect()} == want


def test_grow_takes_more_edges_than_a_worker_holds(graph, seeds):
    got = [sorted(map(tuple, subgraph.grow(graph, seeds, 3, 0.05, 5, MASK, kernel_edges=n).collect())) for n in (1000, 0)]
    assert got[0] == got[1] and len({r[0] for r in got[0]}) == 4


def test_nodes_added_up_in_tasks_equal_those_of_all_rows(graph, seeds):
    want, _ = subgraph.of_waves(wave.best_first(graph, seeds, 3, 0.05, None, MASK), graph)
    for n in (1000, 0):
        assert sorted(map(tuple, wave.reached(graph, seeds, 3, 0.05, MASK, kernel_edges=n).collect())) == sorted(map(tuple, want.collect()))
    nodes, inner = subgraph.around(graph, seeds, 3, 0.05, MASK)
    ids = {r["node_id"] for r in nodes.collect()}
    assert sorted(map(tuple, inner.select(graph.columns).collect())) == sorted(tuple(r) for r in graph.collect() if r["src"] in ids and r["dst"] in ids)


def test_counters_agree_with_each_seeds_own_search(graph, seeds):
    held, own = (sorted(map(tuple, wave.best_first(graph, seeds, 2, 0.1, 3, MASK, stats=True, kernel_edges=n).collect())) for n in (1000, 0))
    assert held == own and sum(r[4] for r in held) > 0


def found(graph, seeds, n):
    """Rows, counters and nodes of searches over no more than ``n`` edges held by a worker."""
    rows = wave.best_first(graph, seeds, 3, 0.05, 4, MASK, kernel_edges=n)
    stats = wave.best_first(graph, seeds, 2, 0.1, 3, MASK, stats=True, kernel_edges=n)
    nodes = wave.reached(graph, seeds, 3, 0.05, MASK, kernel_edges=n)
    return [sorted(map(tuple, x.collect())) for x in (rows, stats, nodes)]


def test_more_edges_than_a_worker_holds_are_mapped_not_joined_with_seeds(graph, seeds, monkeypatch):
    held = found(graph, seeds, 1000)

    def fail(*_, **__):
        raise AssertionError("each seed got its own edges")

    monkeypatch.setattr(wave, "hop_levels", fail)
    assert all(held) and found(graph, seeds, 0) == held


def test_mapped_rows_equal_held_ones(graph):
    for mask in (frozenset(MASK), frozenset({9})):
        held = Rows.of(*wave.columns(graph), mask, True)
        mapped = Rows.mapped(wave.written(graph, mask, True), 0.9, True)
        assert all((getattr(held, c) == getattr(mapped, c)).all() and len(getattr(held, c)) == len(getattr(mapped, c)) for c in ("nodes", "first", "dst", "kind", "weight", "masked", "blocked"))


def test_each_seed_gets_its_own_edges_where_no_folder_can_be_mapped(graph, seeds, monkeypatch):
    held = found(graph, seeds, 1000)
    monkeypatch.setattr(wave, "shared_path", lambda spark: None)
    assert found(graph, seeds, 0) == held


def test_scope_of_a_large_graph_is_mapped_not_joined_with_anchors(graph, seeds, monkeypatch):
    records = seeds.sparkSession.createDataFrame([(f"r{i}", i) for i in range(15)], "record_id string, node_id long")
    scope = lambda: sorted(map(tuple, wave.wave_scope(graph, records, seeds, 3, 0.05, 4, MASK).collect()))
    held = scope()

    def fail(*_, **__):
        raise AssertionError("each anchor got its own edges")

    monkeypatch.setattr(wave, "hop_levels", fail)
    monkeypatch.setattr(wave, "BROADCAST_EDGES", 0)
    assert held and scope() == held


def test_more_edges_than_a_worker_holds_are_not_kept_hop_by_hop_before_they_are_mapped(graph, seeds, monkeypatch):
    held = found(graph, seeds, 1000)

    def fail(*_, **__):
        raise AssertionError("edges in reach were kept besides the mapped ones")

    monkeypatch.setattr(wave, "reachable", fail)
    assert all(held) and found(graph, seeds, 0) == held


def test_what_is_kept_leaves_no_shuffle_files(spark):
    """Each kept step would hold its shuffle on disk until the driver collects its garbage."""

    def shuffles():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        names = set()
        while blocks.hasNext():
            name = blocks.next().getName()
            if name.startswith("shuffle_"):
                names.add(name)
        return names

    rows = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    for keep in (cut, lambda df: cut_by(df, "k")):
        before = shuffles()
        kept, until = keep(rows), time.monotonic() + 20
        while shuffles() - before and time.monotonic() < until:
            time.sleep(0.2)
        assert not shuffles() - before
        assert sorted(map(tuple, kept.collect())) == [(k, 10) for k in range(100)]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_types_of_direct_edges_are_looked_up_for_few_rows_without_shuffling_edges(graph, seeds, monkeypatch):
    records = seeds.sparkSession.createDataFrame([(f"r{i}", i) for i in range(15)], "record_id string, node_id long")
    scope = lambda: wave.wave_scope(graph, records, seeds, 3, 0.05, 4, MASK)
    few = scope()
    joins = [line for line in few._jdf.queryExecution().executedPlan().toString().splitlines() if "LeftSemi" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)
    got = sorted(map(tuple, few.collect()))
    assert any(r[5] for r in got) and any(r[6] for r in got)
    monkeypatch.setattr(wave, "BROADCAST_NODES", 0)
    assert sorted(map(tuple, scope().collect())) == got


def test_records_without_payloads_are_the_same(spark):
    d = "/root/testdata/sf0.001"
    want = sorted(map(tuple, durable_records(spark, d).select("record_id", "logical_id", "node_id").collect()), key=str)
    assert want and sorted(map(tuple, durable_records(spark, d, ("logical_id", "node_id")).collect()), key=str) == want


def receipts_seeds(spark, d="/root/testdata/sf0.001"):
    return {n for r in table(spark, d, "wave_query_receipt").collect() for n in r["seed_nodes"] or () if n is not None and n >= 0}


def test_topk_searches_from_the_seeds_of_every_receipt(spark):
    want = receipts_seeds(spark)
    got = queries.best_first_topk(spark, "/root/testdata/sf0.001").collect()
    assert want and {r["seed"] for r in got} == want


def test_searches_for_first_rows_give_those_of_whole_searches(monkeypatch):
    """Ties, hubs, repeated targets and step limits: what is dropped on the way never was a first row."""
    monkeypatch.setattr(bestfirst, "HUB", 4)
    r, att = np.random.default_rng(7), {t: 0.5 + t / 20 for t in MASK}
    for steps, weights in ((3, [0.25, 0.5, 0.8, 1.0]), (6, np.arange(1, 500) / 500), (4, [0.9])):
        src, dst, kind, weight = r.zipf(1.4, 3000) % 80, r.integers(0, 80, 3000), r.choice([*MASK, 10], 3000, p=[0.24] * 4 + [0.04]), r.choice(weights, 3000)
        rows = bestfirst.Rows.of(src, dst, kind, weight, frozenset(MASK))
        for most in (1, 3, 10):
            whole, first = (Search(rows, steps, 0.05, att, 1.0) for _ in range(2))
            for seed in range(80):
                some = []
                for s, n in ((whole, None), (first, most)):
                    at, _ = s.run(seed, n)
                    at = at[bestfirst.chosen(rows.nodes[at], bestfirst.rounded(s.best[at]), s.depth[at], most, ("energy", "length", "node"), None, None)]
                    some.append([x.tolist() for x in (at, bestfirst.rounded(s.best[at]), s.depth[at], *s.paths(at))])
                assert some[0] == some[1]
            assert first.firsts


def test_subgraphs_are_grown_around_the_seeds_of_every_receipt(spark):
    want = receipts_seeds(spark)
    got = queries.floating_subgraph(spark, "/root/testdata/sf0.001").collect()
    assert want and {r["root"] for r in got} == want and len(got) == len(want) and not any(r["problem"] for r in got)


def test_streams_of_edges_looked_up_equal_those_of_joined_ones(graph, seeds, monkeypatch):
    monkeypatch.setattr(subgraph, "BATCH_EDGES", 3)
    nodes = subgraph.grow(graph, seeds, 3, 0.05, 5, MASK)
    some = graph.union(graph.limit(20)).union(graph.sparkSession.createDataFrame([(99, 99, 1, 0.5), (None, 3, 1, 0.5)], SCHEMA))
    for edges in (some, some.limit(0)):
        held, joined = (sorted(map(tuple, subgraph.export(nodes, edges, n).collect())) for n in (1000, -1))
        assert len(held) == 4 and held == joined


def test_growing_leaves_out_edges_of_hubs_without_losing_nodes(monkeypatch):
    r, att = np.random.default_rng(3), np.array([0.5 + t / 20 for t in range(10)])
    src, dst, kind, weight = r.zipf(1.4, 3000) % 80, r.integers(0, 80, 3000), r.choice(MASK, 3000), r.choice([0.25, 0.5, 0.8, 0.31], 3000)
    rows = bestfirst.Rows.of(src, dst, kind, weight, frozenset(MASK))
    for top_k in (1, 4, 12):
        got = []
        for hub in (4, 10**9):
            monkeypatch.setattr(subgraph, "HUB", hub)
            hubs = {}
            got.append([subgraph._grow(rows, x, 3, 0.05, att, 1.0, top_k, False, hubs) for x in range(80)])
            assert bool(hubs) == (hub == 4)
        assert got[0] == got[1]


def test_evidence_is_found_for_the_seeds_of_every_receipt(spark):
    d = "/root/testdata/sf0.001"
    edges, records = queries.durable_edges(spark, d), {r["node_id"] for r in durable_records(spark, d, ("logical_id", "node_id")).collect()}
    seeds = spark.createDataFrame([(n,) for n in receipts_seeds(spark)], "node_id long")
    rows = wave.best_first(edges, seeds, 3, 0.05, 257, (1, 2, 3, 4, 5)).filter("seed <> node_id").collect()
    want = {(r["seed"], r["node_id"]) for r in rows if r["node_id"] in records}
    got = queries.wave_scope_evidence(spark, d).collect()
    assert want and {(r["anchor"], r["node_id"]) for r in got} == want
