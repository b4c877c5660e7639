"""Waves, adjacency and subgraphs on golden and random graphs."""

from __future__ import annotations

import heapq
import random

import pytest
from pyspark.sql import functions as F

from tidegraph.config import ATTENUATION
from tidegraph.operators import edges as E
from tidegraph.operators import subgraph, wave
from tidegraph.sources.graph import typed_graph

SCHEMA = "src long, dst long, edge_type int, weight double"
GOLDEN = [(1, 2, 1, 0.95), (1, 3, 2, 0.90), (2, 4, 3, 0.90), (3, 5, 4, 0.85), (4, 6, 5, 0.80), (3, 2, 6, 0.70), (2, 1, 1, 0.50)]


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(3)
    data = [(r.randrange(12), r.randrange(12), r.choice([1, 3, 4, 5, 5, 10]), round(r.random(), 2)) for _ in range(70)]
    return data, spark.createDataFrame(data, SCHEMA)


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id long")


def brute_best_first(data, seed, steps, theta, mask, rigor=1.0):
    att = dict(enumerate(ATTENUATION["default"], 1))
    best, path, heap = {seed: 1.0}, {seed: ()}, [(-1.0, seed, 0, ())]
    shut = {(s, d) for s, d, t, _ in data if t == 10}
    order = sorted(data, key=lambda e: (e[0], e[2], e[1], e[3]))
    while heap:
        e, n, k, p = heapq.heappop(heap)
        if -e + 1e-15 < best[n] or k >= steps:
            continue
        for s, d, t, w in order:
            if s == n and t in mask and t != 10 and (s, d) not in shut:
                x = -e * att[t] * w * rigor
                if x >= theta and x > best.get(d, -1.0) + 1e-15:
                    best[d], path[d] = x, (*p, t)
                    heapq.heappush(heap, (-x, d, k + 1, path[d]))
    return {n: (round(x, 12), list(path[n])) for n, x in best.items() if x >= theta}


def test_golden_scope(spark):
    got = wave.best_first(spark.createDataFrame(GOLDEN, SCHEMA), seeds(spark, 1), 3, 0.001, None, range(1, 10))
    assert {r["node_id"]: (r["energy"], r["best_path"]) for r in got.collect()} == {
        1: (1.0, []), 2: (0.665, [1]), 4: (0.2394, [1, 3]), 3: (0.225, [2]), 6: (0.172368, [1, 3, 5]), 5: (0.1434375, [2, 4]),
    }


def test_a_binding_step_limit_tells_the_two_waves_apart(spark):
    data = [(0, 1, 1, 0.9), (0, 2, 1, 0.5), (1, 2, 1, 0.9), (2, 3, 1, 0.9)]
    df = spark.createDataFrame(data, SCHEMA)
    hop = wave.hop_wave(df, seeds(spark, 0), 2, 0.01, None)
    assert {r["node_id"]: round(r["energy"], 12) for r in hop.collect()} == {0: 1.0, 1: 0.9, 2: 0.81, 3: 0.45}
    flat = df.withColumn("weight", F.col("weight") / 0.7)
    first = wave.best_first(flat, seeds(spark, 0), 2, 0.01, None, (1,))
    assert {r["node_id"]: round(r["energy"], 9) for r in first.collect()} == {0: 1.0, 1: 0.9, 2: 0.81}


def test_best_first_equals_brute_force_held_whole_and_by_seed(spark, graph):
    data, df = graph
    for limit in (1_000_000, 0):
        for steps, theta, rigor in ((2, 0.05, 1.0), (4, 0.01, 1.2)):
            got: dict = {}
            for r in wave.best_first(df, seeds(spark, 0, 1, 5, 77), steps, theta, None, (1, 3, 4, 5), rigor, kernel_edges=limit).collect():
                got.setdefault(r["seed"], {})[r["node_id"]] = (r["energy"], r["best_path"])
            assert got == {s: brute_best_first(data, s, steps, theta, (1, 3, 4, 5), rigor) for s in (0, 1, 5, 77)}


def test_metamorphic_properties(spark, graph):
    _, df = graph
    run = lambda theta=0.05, k=None, mask=(1, 3, 4, 5), rigor=1.0: wave.best_first(df, seeds(spark, 0), 4, theta, k, mask, rigor).collect()
    assert run() == run()
    assert {r["node_id"] for r in run(0.2)} <= {r["node_id"] for r in run(0.05)}
    assert {r["node_id"] for r in run()} <= {r["node_id"] for r in run(rigor=1.1)}
    assert all(set(r["best_path"]) <= {1, 4} for r in run(mask=(1, 4)))
    assert len(run(k=3)) == 3 and run(k=3) == run()[:3] or len(run()) < 3
    stats = wave.best_first(typed_graph(spark, 2000), seeds(spark, 0), 2, 0.01, 10, (4, 5), stats=True).collect()[0]
    assert stats["blocked"] > 0 and stats["after_top_k"] <= 10


def test_scope_merge_and_recall(spark, graph):
    data, df = graph
    records = spark.createDataFrame([(f"r{i}", i) for i in range(12)], "record_id string, node_id long")
    got = wave.wave_scope(df, records, seeds(spark, 0, 3), 3, 0.01, 100, (1, 3, 4, 5)).collect()
    assert all(r["anchor"] != r["node_id"] for r in got)
    for r in got:
        assert r["direct_out"] == sorted({t for s, d, t, _ in data if (s, d) == (r["anchor"], r["node_id"])})
        assert r["direct_in"] == sorted({t for s, d, t, _ in data if (d, s) == (r["anchor"], r["node_id"])})
    rows = wave.best_first(df, seeds(spark, 0, 3), 3, 0.01, None, (1, 3, 4, 5))
    best: dict = {}
    for r in rows.collect():
        best[r["node_id"]] = max(best.get(r["node_id"], 0), r["energy"])
    assert {r["node_id"]: r["energy"] for r in wave.merged_best(rows, None).collect()} == best
    compact = spark.createDataFrame([(0, 1, 1, 200), (0, 2, 1, 200), (1, 3, 1, 250), (2, 3, 1, 250), (3, 0, 1, 255), (0, 4, 255, 255)], "src long, dst long, edge_type int, attenuation long")
    e1 = (65535 * 200) >> 8
    e3 = min(65535, 2 * ((e1 * 250) >> 8))
    fired = {r["node_id"]: r["energy"] for r in wave.saturating_recall(compact, seeds(spark, 0), 1000, 10).collect()}
    assert fired == {0: 65535, 1: e1, 2: e1, 3: e3}


def test_scans_and_checks(spark, graph):
    data, df = graph
    both = {(s, d, t, round(w * 1e6)) for s, d, t, w in data if 3 in (s, d)}
    assert set(map(tuple, E.edges_of(df, 3, "both").collect())) == both
    assert E.edges_of(df, 3, "both", limit=2).count() == min(2, len(both))
    assert E.parse_mask("UP_RULE, 5") == (1, 5) and E.parse_mask(None) == (4, 5, 7)
    for bad in (lambda: E.parse_mask("NOPE"), lambda: E.edges_of(df, 1, "up"), lambda: wave.check(65, 0, 1), lambda: wave.check(1, float("nan"), 1), lambda: wave.check(1, 0, 0)):
        with pytest.raises(ValueError):
            bad()
    ordered = spark.createDataFrame([(1, 1, 1, 0), (1, 2, 1, 1), (0, 9, 1, 2)], "src long, dst long, edge_type int, seq long")
    assert [r["seq"] for r in E.unsorted_rows(ordered, "seq").collect()] == [2]
    assert wave.ranked(df, [F.col(c) for c in df.columns], None).agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first()[0:3] == (1, 70, 70)


def test_subgraph_streams(spark, graph):
    data, df = graph
    nodes = subgraph.grow(df, seeds(spark, 0), 3, 0.01, 5, (1, 3, 4, 5))
    assert nodes.count() <= 5
    out = subgraph.export(nodes, df)
    good = subgraph.decode(out).collect()[0]
    assert good["problem"] is None and {n["node_id"] for n in good["content"]["nodes"]} == {r["node_id"] for r in nodes.collect()}
    text = out.collect()[0]["stream"]
    bad = spark.createDataFrame([(0, text.replace('"version":1', '"version":2')), (1, text.replace("TIDE", "EDIT")), (2, text.replace('\\"depth\\":0', '\\"depth\\":1')), (3, text + " "), (4, None)], "root long, stream string")
    assert [r["problem"] for r in subgraph.decode(bad).orderBy("root").collect()] == ["VERSION", "MAGIC", "HASH", "CANONICAL", "MAGIC"]
    start = df.filter("false")
    done = spark.createDataFrame([], "stream_hash string")
    e1, h1 = subgraph.patch(start, done, out)
    e2, h2 = subgraph.patch(e1, h1, out)
    assert e1.count() == e2.count() > 0 and h1.count() == h2.count() == 1


def test_empty_graph(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert [tuple(r)[:2] for r in wave.hop_wave(none, seeds(spark, 4), 3, 0.1, 5).collect()] == [(4, 1.0)]
    assert [r["node_id"] for r in wave.best_first(none, seeds(spark, 4), 3, 0.1, 5, (1,)).collect()] == [4]
    assert wave.best_first(none, seeds(spark), 3, 0.1, 5, (1,)).count() == 0


def brute_hops(data, seed, steps, theta):
    front, best = {seed: (1.0, -1, 0)}, {seed: (-1.0, 0, -1, 0)}
    for hop in range(1, steps + 1):
        nxt = {}
        for s, d, t, w in data:
            if s in front and front[s][0] * w >= theta:
                x = (-(front[s][0] * w), s, t)
                nxt[d] = min(nxt.get(d, x), x)
        front = {d: (-e, s, t) for d, (e, s, t) in nxt.items()}
        for d, (e, s, t) in nxt.items():
            best[d] = min(best.get(d, (e, hop, s, t)), (e, hop, s, t))
    return {d: (-e, h, s, t) for d, (e, h, s, t) in best.items() if -e >= theta}


def test_hop_waves_equal_brute_force_however_edges_are_kept(spark, graph, monkeypatch):
    data, df = graph
    want = {s: brute_hops(data, s, 5, 0.05) for s in (0, 3, 99)}
    grouped = seeds(spark, 0, 3, 99).withColumn("seed", F.col("node_id"))

    def rows(out):
        got: dict = {}
        for r in out.collect():
            got.setdefault(r["seed"], {})[r["node_id"]] = (r["energy"], r["hop"], r["predecessor"], r["edge_type"])
        return got

    assert rows(wave.hop_wave(df, grouped, 5, 0.05, None, None, ["seed"])) == want
    monkeypatch.setattr(wave, "heavy_keys", lambda some, keys: some.select(*keys).distinct())
    assert rows(wave.hop_wave(df, grouped, 5, 0.05, None, None, ["seed"])) == want
    held = wave.HeldGraph(df)
    assert rows(held.hop_waves(grouped, 5, 0.05, 1000)) == want
    top = sorted(map(tuple, held.hop_waves(grouped, 2, 0.05, 3).collect()))
    assert top == sorted(map(tuple, wave.hop_wave(df, grouped, 2, 0.05, 3, None, ["seed"]).collect()))
    with pytest.raises(ValueError):
        wave.HeldGraph(df, most=3)


def test_held_waves_join_beyond_the_bound(spark, graph):
    df = graph[1]
    want = sorted(map(tuple, wave.HeldGraph(df).hop_waves(seeds(spark, 1, 2), 2, 0.05, 3).collect()))
    for most in (3, 1000):
        got = wave.held_waves(df, seeds(spark, 1, 2, 2), 2, 0.05, 3, most=most)
        assert want and sorted(map(tuple, got.collect())) == want


def test_edges_of_many_nodes(spark, graph):
    df = graph[1]
    for direction in ("out", "in", "both"):
        want = {tuple(r) for n in (1, 4) for r in E.edges_of(df, n, direction).collect()}
        got = [tuple(r) for r in E.edges_of(df, seeds(spark, 1, 4, 4, None), direction).collect()]
        assert want and len(got) == len(want) and set(got) == want
