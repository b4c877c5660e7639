"""Vectors, rankings, paths, payload plans, rules, lines and ledgers."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tidegraph.functions import hashing, relation
from tidegraph.operators import hybrid, ledger, lines, metrics, mutations, paths, payload, rules, structural, vectors


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_search_equals_brute_force_with_ties_nulls_and_other_sizes(spark):
    r = random.Random(2)
    data = [(i, [round(r.gauss(0, 1), 2) for _ in range(4)]) for i in range(60)] + [(60, [1.0, 1.0, 0.0, 0.0]), (61, [2.0, 2.0, 0.0, 0.0]), (62, None), (63, [0.0] * 4), (64, [1.0])]
    df = spark.createDataFrame(data, "record_id long, vec array<double>").repartition(5)
    q = spark.createDataFrame([(1000, [1.0, 1.0, 0.0, 0.0]), (1, data[1][1]), (1001, None)], "query_id long, vec array<double>")

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b)))

    want = {}
    for i, v in ((1000, [1.0, 1.0, 0.0, 0.0]), (1, data[1][1])):
        best = sorted((-cos(v, w), j) for j, w in data if w and len(w) == 4 and any(w))[:7]
        want[i] = [j for _, j in best]
    got: dict = {}
    for x in vectors.search(df, q, 7).orderBy("rank").collect():
        got.setdefault(x["query_id"], []).append(x["id"])
    assert got == want
    allowed = spark.createDataFrame([(1000, 60), (1000, 61), (1000, 3), (1000, 63), (1000, 9999)], "query_id long, id long")
    assert [x["id"] for x in vectors.search(df, q, 5, allowed=allowed).orderBy("rank").collect()][:2] == [60, 61]
    assert sorted(x["record_id"] for x in vectors.invalid(df, 4).collect()) == [62, 63, 64]
    with pytest.raises(ValueError):
        vectors.search(df, q, 0)


def test_search_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    data = [(i, [float(i), 1.0]) for i in range(8)]
    df = spark.createDataFrame(data, "record_id long, vec array<double>")
    q = df.withColumnRenamed("record_id", "query_id")
    got = {r["query_id"]: r["id"] for r in vectors.search(df, q, 1).collect()}
    assert got == {i: i for i in range(8)}


def test_puts_and_imports(spark):
    had = spark.createDataFrame([("a", [1.0], 4), ("b", [2.0], 1)], "record_id string, vec array<float>, generation long")
    new = spark.createDataFrame([("a", [1.0]), ("b", [3.0]), ("c", [5.0])], "record_id string, vec array<float>")
    assert [(r[0], r[2], r[3]) for r in rows(vectors.put(had, new))] == [("a", "UNCHANGED", 4), ("b", "UPDATED", 2), ("c", "INSERTED", 1)]
    batch = spark.createDataFrame([("k1", "a", [1.0]), ("k2", "a", [1.0]), ("k2", "a", [2.0])], "key string, record_id string, vec array<float>")
    first = vectors.import_batch(spark.createDataFrame([], "key string, digest long"), batch)
    assert {r["key"]: r["status"] for r in first.collect()} == {"k1": "NEW", "k2": "CONFLICT"}
    assert {r["key"]: r["status"] for r in vectors.import_batch(first, batch).collect()}["k1"] == "DUPLICATE"


def test_fusion_counts_missing_components_out(spark):
    scope = spark.createDataFrame([(0, "a", 1, 0.8), (0, "b", 2, 1.4), (0, "c", 3, 0.1)], "anchor long, record_id string, node_id long, energy double")
    ext = spark.createDataFrame([(0, "a", 0.0)], "anchor long, record_id string, similarity double")
    nat = spark.createDataFrame([(0, "a", 1.0), (0, "c", -1.0)], "anchor long, record_id string, similarity double")
    states = spark.createDataFrame([("c", "VERIFIED", "REVOKED")], "record_id string, maturity string, validity string")
    got = hybrid.fuse(scope, ext, nat, states, 10, hybrid.Weights(1, 1, 2), hybrid.trusted("ACTIVE_ONLY"))
    assert {r["record_id"]: round(r["score"], 12) for r in got.collect()} == {"a": round((0.8 + 0.5 + 2) / 4, 12), "b": 1.0}
    assert hybrid.fuse(scope, ext, nat, states, 10, hybrid.Weights(), hybrid.trusted("VERIFIED_ACTIVE_ONLY"), "exclude").count() == 0
    for bad in ((0, 0, 0), (-1, 1, 1), (float("nan"), 1, 1)):
        with pytest.raises(ValueError):
            hybrid.Weights(*bad)


def test_structural_vectors(spark):
    edges = spark.createDataFrame([(1, 2, 1, 0.5), (2, 1, 1, 0.5), (1, 3, 8, 1.0)], "src long, dst long, edge_type int, weight double")
    got = {(r[0], r[1]): r[2] for r in structural.feature_rows(edges).collect() if r[2]}
    assert got[1, 0] == pytest.approx(math.log(3)) and got[1, 4] == 1 and got[1, 9] == 0.5 and got[1, 8] == 1.0 and got[1, 2] == 0.75
    assert got[1, (131 + 17) % 8 + 40] == 0.25 and got[2, (131 + 17) % 8 + 40] == 0.25 and got[2, (131 + 17 * 8) % 8 + 40] == 0.5
    nodes = spark.createDataFrame([(1,), (9,)], "node_id long")
    vec = {r[0]: r[1] for r in structural.vectors(structural.feature_rows(edges), nodes).collect()}
    assert abs(sum(x * x for x in vec[1]) - 1) < 1e-5
    assert [i for i, x in enumerate(vec[9]) if x] == [24, 36]


def test_relations(spark):
    cases = [
        ([], "EMPTY_PATH", False, 0, 0), (["UP_RULE"], "UP_RULE", False, 0, 0), (["IS_NOT_EDGE"], "BLOCKED_PATH", True, 0, 0),
        (["UP_RULE", "CODE_PATTERN", "DOWN_EVIDENCE"], "RULE_CODE_EVIDENCE_PATH", False, 0, 2), (["UP_RULE", "UP_RULE", "UP_RULE"], "UNKNOWN_PATH", False, 2, 2),
        (["UP_RULE", "UP_RULE", "IS_NOT_EDGE", "UP_RULE"], "BLOCKED_PATH", True, 1, 2), (None, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)], "id int, edge_types array<string>, relation string")
    got = paths.relations(df).orderBy("id").collect()
    assert [(r["relation"], r["blocked"], r["unknown_count"], r["step_count"]) for r in got] == [c[1:] for c in cases]
    r = spark.createDataFrame([("a", "b", "x", True), ("b", "a", "y", False)], "left string, right string, result string, commutative boolean")
    assert [tuple(x)[:2] for x in relation.rule_conflicts(r).collect()] == [("b", "a")]


def test_crystals(spark):
    ev, sim = "DOWN_EVIDENCE", "LATERAL_SIMILAR_CASE"
    data = [("p1", [sim, ev], ["r1", "r2"], 1.0, False, 1), ("p2", [sim, ev], ["r3"], 1.0, False, 2), ("p3", [sim, ev], [], 1.0, None, 3), ("p4", [sim, ev], ["x"], 1.0, True, 4), ("p5", [ev], ["y"], 1.0, False, 5), ("p6", None, None, None, None, 6)]
    df = spark.createDataFrame(data, "path_id string, edge_types array<string>, record_ids array<string>, weight double, blocked boolean, seq long")
    got = paths.crystallize(df, 3, links=2).collect()
    assert len(got) == 1 and got[0]["support_count"] == 3 and got[0]["provenance_path_ids"] == ["p1", "p2"] and got[0]["provenance_record_ids"] == ["r1", "r2"]
    assert tuple(paths.crystal_counters(df, 3).first()) == (6, 2, 1)
    gone = spark.createDataFrame([(got[0]["crystal_id"], "why", ["e"]), (got[0]["crystal_id"], "", ["e"])], "crystal_id string, reason string, evidence_ids array<string>")
    assert [r["status"] for r in paths.revoke(paths.crystallize(df, 3), gone).collect()] == ["REVOKED"]


def test_spans_equal_brute_force(spark):
    r = random.Random(4)
    data = [(f, i, r.randrange(3000), r.randrange(1, 60)) for f in (0, 1) for i in range(80)]
    df = spark.createDataFrame(data, "file int, record_id long, offset long, length long")
    want = {}
    for f in (0, 1):
        begin = end = None
        for o, i, n in sorted((o, i, n) for g, i, o, n in data if g == f):
            if begin is None or o - end > 20 or max(end, o + n) - begin > 200:
                begin, end = o, o
            end = max(end, o + n)
            want.setdefault((f, begin), [set(), 0])
            want[f, begin][0].add(i)
            want[f, begin][1] = end - begin
    got: dict = {}
    for x in payload.bounded_spans(df, 20, 200).collect():
        got.setdefault((x["file"], x["span_offset"]), [set(), x["span_length"]])[0].add(x["record_id"])
    assert got == want
    free = payload.gap_spans(df, 20)
    far = payload.bounded_spans(df, 20, 1 << 40).select("file", "span_offset", "span_length").distinct()
    assert payload.differences(free.select("file", "span_offset", "span_length"), far).count() == 0
    assert payload.top_records(spark.createDataFrame([], "energy_score double, rank int, node_id long, record_id long"), 0).count() == 0
    crc = spark.createDataFrame([(0, b"a", 1), (1, b"a", 1), (8, b"a", 3904355907)], "position long, payload binary, crc long")
    assert [payload.checksum_failures(crc, m).count() for m in ("full", "sampled", "off")] == [2, 1, 0]


def test_layers_patches_and_inverse(spark):
    base = spark.range(5).withColumnRenamed("id", "key")
    x = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "key long, value long")
    p = spark.createDataFrame([(2, 200)], "key long, value long")
    got = {r["key"]: (r["value"], r["source_layer"]) for r in rules.layered(base, ["key"], F.lit(0).cast("long"), x, p).collect()}
    assert got == {0: (0, "G1_RULE"), 1: (10, "G2_EXCEPTION"), 2: (200, "G4_PATCH"), 3: (None, "G2_EXCEPTION"), 4: (0, "G1_RULE")}
    chain = spark.createDataFrame([(1, 1, 10, 11), (2, 1, 11, 0), (3, 4, None, 7), (4, 2, 99, 5)], "seq long, key long, before long, after long")
    folded = rules.compact(x, chain, ["key"], F.lit(0).cast("long"))
    assert rows(folded) == [(2, 5), (3, None), (4, 7)]
    assert [r["seq"] for r in rules.stale(chain, x, ["key"]).collect()] == [4]
    back = rules.compact(folded, rules.inverse(chain), ["key"], F.lit(0).cast("long"))
    assert (1, 10) in rows(back)
    sizes = spark.createDataFrame([("a", "RAW", 5), ("a", "B", 5), ("b", "RAW", 9), ("b", "B", 3), ("b", "A", 3)], "key string, mode string, bytes long")
    assert [r[:3] for r in rows(rules.choose(sizes, "key"))] == [("a", "RAW", 5), ("b", "A", 3)]


def test_lines_round_trip_with_odd_texts(spark):
    texts = ["a\nb\n", "a\nb", "", None, "\n\n", "a\r\nb\n" * 3, "x" * 5000 + "\n", "nul\x00\n", "ü\n€😀\n"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, line string")
    one = lines.lines(df)
    book = lines.dictionary(one, "line")
    back = {r["doc_id"]: r["text"] for r in lines.rebuild(lines.encode(one, book), book).collect()}
    assert back == {i: t for i, t in enumerate(texts) if t and "\x00" not in t}
    some = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    coded = lines.greedy(some, ["a", "a\n", "b\n", "😀"])
    assert {r["doc_id"]: r["text"] for r in lines.ungreedy(coded, ["a", "a\n", "b\n", "😀"]).collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_replay_equals_a_sequential_fold_with_a_hot_key(spark):
    table = ledger.transition_table()
    r = random.Random(6)
    data = [("hot" if r.random() < 0.5 else f"k{r.randrange(20)}", i, r.choice([*ledger.OPERATIONS, "ODD"])) for i in range(600)]
    df = spark.createDataFrame([(k, s, o, 1) for k, s, o in r.sample(data, len(data))], "record_id string, sequence long, operation string, legal0 int")
    state, want = {}, {}
    for k, s, o in data:
        before = state.get(k, 0)
        n = ledger.OPERATIONS.index(o) if o in ledger.OPERATIONS else None
        ok = n is not None and table[n, before] >= 0
        state[k] = int(table[n, before]) if ok else before
        want[s] = (bool(ok), before, state[k])
    got = ledger.replay(df, "record_id", "sequence", "operation", partitions=7)
    assert {x["sequence"]: (x["legal"], x["previous_state"], x["next_state"]) for x in got.collect()} == want
    assert ledger.replay(df.limit(0), "record_id", "sequence", "operation").count() == 0


def test_chains_versions_votes_and_policies(spark):
    chain = spark.createDataFrame([(1, "a", None, 1), (2, "b", "a", 2), (3, "c", "x", 3), (5, "e", "d", 9), (6, "f", "e", 9)], "seq long, d string, p string, t long")
    assert rows(ledger.chain_breaks(chain, "seq", "d", "p", "t")) == [(3, "DIGEST"), (5, "SEQUENCE"), (6, "CLOCK")]
    v = spark.createDataFrame([("a", 1), ("a", 3), ("b", 1), ("b", 2), ("b", 2), (None, 4)], "o string, v long")
    assert rows(ledger.version_gaps(v, ["o"], "v")) == [("a", 2, 3, 1)]
    votes = spark.createDataFrame([(1, "x", 2, "z"), (1, "x", 2, "z"), (1, "z", 5, "z"), (2, "y", 1, "z")], "q long, who string, w long, asker string")
    quorum = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "q long, quorum long")
    assert rows(ledger.thresholds(votes, ["q"], "who", F.col("w"), quorum, "asker")) == [(1, 2, 1, True), (2, 1, 1, False), (3, 0, 0, False)]
    ev = "array<struct<evidence_id: string, provenance_id: string>>"
    req = spark.createDataFrame(
        [(1, "p", "A", "PROMOTE", "v", [("1", "s"), ("2", "s")]), (2, "p", "A", "PROMOTE", "v", [("1", "s")]), (3, "p", "B", "PROMOTE", "v", [("1", "s")]), (4, "q", "A", "PROMOTE", "v", []), (5, "p", "A", "REVOKE", "v", [("1", "s")]), (6, "p", "A", "PROMOTE", "v", []), (7, "p", "A", "PROMOTE", "w", [("1", "s")])],
        f"id long, policy_id string, authority string, operation string, verifier string, evidence {ev}",
    )
    pol = spark.createDataFrame([("p", "A", 0b10, 1, 3, "v", True)], "policy_id string, authority string, operations int, min_evidence int, max_evidence int, verifier string, unique_provenance boolean")
    assert [r["reason"] for r in ledger.permitted(req, pol).orderBy("id").collect()] == ["PROVENANCE", None, "AUTHORITY", "POLICY", "OPERATION", "EVIDENCE", "VERIFIER"]


def test_mutations_and_digests(spark):
    b = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None)], "k long, c string")
    assert rows(mutations.batch_status(b, ["k"], ["c"])) == [(1, 2, "DUPLICATE"), (2, 2, "CONFLICT"), (3, 1, "SINGLE")]
    d = lambda df: hashing.state_digest(df, ["k", "c"]).first()["digest"]
    assert d(b) == d(b.repartition(7).orderBy("c")) != d(b.limit(4))
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("../c", "3"), ("d", "4")], "path string, digest string")
    there = spark.createDataFrame([("a", "1"), ("b", "9")], "path string, digest string")
    assert {r["path"]: r["action"] for r in mutations.backup_conflicts(files, there).collect()} == {"a": "SAME", "b": "CONFLICT", "../c": "UNSAFE", "d": "RESTORE"}
    x = 0x0123456789ABCDEF
    y = x ^ (x >> 30)
    y = y * hashing.MIX_1 % 2**64
    y ^= y >> 27
    y = y * hashing.MIX_2 % 2**64
    import numpy as np

    assert int(hashing.mix64(np.array([x], np.uint64))[0]) == y ^ (y >> 31)


def test_metrics(spark):
    data = [(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, False), (2, 2, False)]
    got = {r["query_id"]: r for r in metrics.retrieval(spark.createDataFrame(data, "query_id long, rank int, relevant boolean"), 3).collect()}
    assert got[1]["reciprocal_rank"] == 1.0 and got[2]["ndcg"] == 0.0
    assert abs(got[1]["ndcg"] - (1 + 0.5) / (1 + 1 / math.log2(3))) < 1e-12


def test_a_record_longer_than_a_page_takes_pages_of_its_own(spark):
    df = spark.createDataFrame([("a", 1, 4), ("a", 2, 25), ("a", 3, 10), ("a", 4, 3), ("b", 1, 20), ("b", 2, 1)], "file string, record_id long, length long")
    assert rows(payload.pages(df, 10)) == [("a", 1, 0, 0), ("a", 2, 1, 0), ("a", 3, 4, 0), ("a", 4, 5, 0), ("b", 1, 0, 0), ("b", 2, 2, 0)]


def test_costs_and_fetches_are_of_all_pointers(spark, monkeypatch):
    from tidegraph.catalog import stores

    df = spark.createDataFrame([(i, "s", "x" * 9, 9) for i in range(30)], "doc_id long, source string, text string, n_chars long")
    monkeypatch.setattr(stores, "table", lambda *_: df)
    assert stores.read_costs(spark, "").select("naive_reads", "naive_bytes").collect() == [(30, 270)]
    met, fetch = [], payload.fetch
    monkeypatch.setattr(payload, "fetch", lambda p, docs: met.append(p.count()) or fetch(p, docs))
    assert stores.fetch_equivalence(spark, "").collect() == [] and met == [30]


def test_a_snapshot_digest_moves_with_every_content_column(spark):
    records, edges = [("r1", 1, b"x"), ("r2", 2, None)], [(1, 2, 3, 0.5), (2, 1, 4, 0.25)]
    r = lambda rows: spark.createDataFrame(rows, "record_id string, node_id long, payload binary")
    e = lambda rows: spark.createDataFrame(rows, "src long, dst long, edge_type int, weight double")
    got = lambda a, b: {x["relation"]: x["digest"] for x in mutations.snapshot(r(a), e(b)).collect()}
    first = got(records, edges)
    assert got(records[::-1], edges[::-1]) == first
    for other in ([("r1", 1, b"y"), records[1]], [("r1", 3, b"x"), records[1]], [("r9", 1, b"x"), records[1]]):
        assert got(other, edges)["records"] != first["records"]
    for other in ([(1, 2, 3, 0.75), edges[1]], [(1, 2, 5, 0.5), edges[1]], [(1, 9, 3, 0.5), edges[1]], [(9, 2, 3, 0.5), edges[1]]):
        assert got(records, other)["edges"] != first["edges"]


def test_artifacts_are_registered_invalidated_and_reopened_by_their_source(spark):
    inventory = spark.createDataFrame([("csr", "a", "COMPLETE", "h1"), ("csr", "b", "COMPLETE", "h0"), ("csr", "c", "INVALIDATED", "h1")], "kind string, artifact_id string, state string, source_hash string")
    new = spark.createDataFrame([("csr", "a", "h1"), ("csr", "b", "h1"), ("csr", "c", "h1"), ("csr", "d", "h1"), ("csr", "e", "h1"), ("csr", "e", "h2"), ("csr", None, "h1")], "kind string, artifact_id string, source_hash string")
    got = {x["artifact_id"]: x["outcome"] for x in mutations.register(inventory, new).collect()}
    assert got == {"a": "UNCHANGED", "b": "CONFLICT", "c": "REGISTERED", "d": "REGISTERED", "e": "CONFLICT"}
    after = mutations.invalidate(inventory, spark.createDataFrame([("csr", "b"), ("other", "a")], "kind string, artifact_id string"))
    assert sorted((x["artifact_id"], x["state"]) for x in after.collect()) == [("a", "COMPLETE"), ("b", "INVALIDATED"), ("c", "INVALIDATED")]
    assert [x["artifact_id"] for x in mutations.reopenable(after, "h1").collect()] == ["a"]
    assert mutations.reopenable(after, "h2").count() == 0


def test_a_vector_put_compares_bits(spark):
    had = spark.createDataFrame([(1, [0.0, 1.0], 1), (2, [2.0], 3)], "record_id long, vec array<float>, generation long")
    new = spark.createDataFrame([(1, [-0.0, 1.0]), (2, [2.0]), (3, [1.0])], "record_id long, vec array<float>")
    assert {x["record_id"]: (x["outcome"], x["generation"]) for x in vectors.put(had, new).collect()} == {1: ("UPDATED", 2), 2: ("UNCHANGED", 3), 3: ("INSERTED", 1)}


def test_pair_cosines_equal_the_scoped_search(spark, monkeypatch):
    r = random.Random(12)
    vecs = [(i, [r.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4 if i % 5 else 3)] if i % 7 else None) for i in range(40)]
    v = spark.createDataFrame(vecs, "record_id long, vec array<double>")
    q = v.select(F.col("record_id").alias("query_id"), "vec")
    pairs = spark.createDataFrame([(a, b) for a in range(41) for b in range(0, 41, 3)], "query_id long, id long")
    want = {(x["query_id"], x["id"]): x["similarity"] for x in vectors.search(v, q, 1000, allowed=pairs).collect()}
    for block in (4096, 0):
        monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
        got = {(x["query_id"], x["id"]): x["whole"] for x in vectors.pair_cosines(pairs, q, v, {"whole": None, "head": 2}).collect()}
        assert {k: c for k, c in got.items() if c is not None} == want
