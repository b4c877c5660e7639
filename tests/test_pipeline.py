"""Problems 1, 2, 3 and 5 on small fixtures, against brute force."""

from __future__ import annotations

import json
import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidegraph.operators import changefeed, frequency, hierarchy, orphans
from tidegraph.plans.skew import salted_join

T0 = datetime(2025, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 1. Frequencies


def brute_summary(values, percentiles):
    v = sorted(x for x in values if x is not None)
    c = Counter(v)
    mode = min(c, key=lambda x: (-c[x], x)) if c else None
    return [len(values), len(v), len(c), mode, c[mode] if c else None, v[0] if v else None, v[-1] if v else None, *[v[max(1, math.ceil(p * len(v) - 1e-9)) - 1] if v else None for p in percentiles]]


def test_summary_equals_brute_force_with_a_hot_key_nulls_and_ties(spark):
    r = random.Random(1)
    data = [(r.choice([1, 1, 1, 1, 2, 3, None]), r.choice(["a", None]), r.choice([None, -0.0, 0.0, 0.5, 0.5, r.random()]), "x") for _ in range(3000)]
    df = spark.createDataFrame(data, "k long, t string, w double, n string")
    got = {(r[0], r[1]): list(r)[2:] for r in frequency.summarize(df, ["k", "t"], "w", (0.1, 0.5, 0.99), partitions=5).collect()}
    groups = defaultdict(list)
    for k, t, w, _ in data:
        groups[k, t].append(None if w is None else w + 0.0)
    assert got == {g: brute_summary(v, (0.1, 0.5, 0.99)) for g, v in groups.items()}


def test_summary_of_an_empty_table_and_of_nulls_alone(spark):
    empty = spark.createDataFrame([], "k long, w double")
    assert frequency.summarize(empty, ["k"], "w").count() == 0
    nulls = spark.createDataFrame([(1, None)], "k long, w double")
    assert rows(frequency.summarize(nulls, ["k"], "w")) == [(1, 1, 0, 0, None, None, None, None, None, None)]


def test_heavy_hitters_count_every_row_in_both_numbers(spark):
    df = spark.createDataFrame([(1, 1, 0.1)] * 2 + [(1, 1, None)] + [(None, 1, 0.2)] * 7, "src long, t int, w double")
    assert [tuple(r)[:2] for r in frequency.heavy_hitters(df, ["src", "t"], "w", 4).collect()] == [(1, 1)]
    assert frequency.heavy_hitters(df, ["src", "t"], "w", 3).count() == 0


# 2. Hierarchies


def brute_tree(events):
    parents = defaultdict(set)
    for node, ps in events:
        n = (node or "").strip().lower()
        if n:
            parents[n] |= {p.strip().lower() for p in ps or [] if p and p.strip()}
    links = {n: {p for p in ps if p in parents} for n, ps in parents.items()}
    reach = {}
    for n in links:
        seen, todo = set(), list(links[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += links[x]
        reach[n] = seen
    cycle = {n: min(m for m in reach[n] if n in reach[m]) for n in links if n in reach[n]}
    out = {(n, c, -1): None for n, c in cycle.items()}
    for root in (n for n in links if not links[n]):
        layer, done, d = {root: (root,)}, {root}, 0
        out[root, root, 0] = [root]
        while layer:
            d += 1
            nxt = {}
            for n in links:
                if n not in done and n not in cycle:
                    best = min((layer[p] for p in links[n] if p in layer), default=None)
                    if best:
                        nxt[n] = (*best, n)
            done |= set(nxt)
            out |= {(n, root, d): list(p) for n, p in nxt.items()}
            layer = nxt
    below = {}
    for n in links:
        if n not in cycle:
            layer, d, seen = {n}, 0, {n}
            while layer:
                d += 1
                layer = {c for c in links if c not in seen and c not in cycle and links[c] & layer}
                seen |= layer
                below |= {(n, c): d for c in layer}
    return out, below


def random_events(r, n):
    out = []
    for i in range(n):
        ps = [f"N{r.randrange(max(1, i - 6), i + 1):03d}" for _ in range(r.choice([0, 1, 1, 1, 2]))] if i else []
        if r.random() < 0.08:
            ps.append(f"n{r.randrange(n):03d} ")
        if r.random() < 0.1:
            ps += [None, "", "gone", *ps]
        out.append((r.choice([f"n{i:03d}", f" N{i:03d}\t"]), r.choice([ps, ps, ps or None])))
    return out + [(None, ["n001"]), ("  ", None), ("n005", ["n005"] if r.random() < 0.3 else [])]


def test_hierarchy_equals_brute_force(spark):
    for seed, n in ((3, 40),):
        data = random_events(random.Random(seed), n)
        df = spark.createDataFrame([(a, b, "clash") for a, b in data], "provenance_id string, ps array<string>, node string")
        want, below = brute_tree(data)
        got = hierarchy.hierarchy(df, "provenance_id", "ps", with_path=True)
        assert {(r[0], r[1], r[2]): (list(r[3]) if r[3] else None) for r in got.collect()} == want
        nodes, links = hierarchy.clean_links(df, "provenance_id", "ps")
        down = hierarchy.descendants(hierarchy.peel(nodes, links).links)
        assert {(r[0], r[1]): r[2] for r in down.collect()} == below


def test_hierarchy_of_nothing_and_of_cycles_alone(spark):
    schema = "provenance_id string, ps array<string>"
    assert hierarchy.hierarchy(spark.createDataFrame([], schema), "provenance_id", "ps").count() == 0
    ring = spark.createDataFrame([("b", ["a"]), ("a", ["b"]), ("c", ["c"]), ("d", ["a"])], schema)
    assert rows(hierarchy.hierarchy(ring, "provenance_id", "ps")) == [("a", "a", -1), ("b", "a", -1), ("c", "c", -1)]


def test_rounds_grow_with_the_logarithm_of_the_depth(spark):
    n = 250
    data = [(f"k{i:05}", [f"k{i - 1:05}"] if i else []) for i in range(n)]
    data += [(f"w{i:05}", ["k00000"]) for i in range(500)] + [(f"r{i:03}", [f"r{(i + 1) % 40:03}"]) for i in range(40)] + [("top", None), ("r007", ["top"]), ("under", ["r030"])]
    nodes, links = hierarchy.clean_links(spark.createDataFrame(data, "provenance_id string, ps array<string>"), "provenance_id", "ps")
    peeled = hierarchy.peel(nodes, links)
    assert len(peeled.rounds) < 40
    got = {(r["node"], r["root_id"]): r["depth"] for r in hierarchy.assign(peeled).collect()}
    assert got == {(f"k{i:05}", "k00000"): i for i in range(n)} | {(f"w{i:05}", "k00000"): 1 for i in range(500)} | {("top", "top"): 0}
    assert {(r["node"], r["root_id"]) for r in peeled.cycles.collect()} == {(f"r{i:03}", "r000") for i in range(40)}


# 3. Orphans


def test_composite_keys_by_null_mask_and_match_semantics(spark):
    refs = spark.createDataFrame([(1, 1, 1), (2, 1, 9), (3, None, 1), (4, None, 9), (5, None, None), (6, 9, None), (1, 1, 1)], "id long, a long, b long")
    targets = spark.createDataFrame([(1, 1, "z"), (2, 2, "z"), (None, 9, "z")], "x long, y long, id string")
    ids = lambda m: sorted(r["id"] for r in orphans.orphans(refs, targets, [("a", "x"), ("b", "y")], m).collect())
    assert ids("simple") == [2]
    assert ids("full") == [2, 3, 4, 6]
    assert ids("partial") == [2, 6]


def test_reasons_equal_brute_force(spark):
    r = random.Random(5)
    at = lambda h: T0 + timedelta(hours=h)
    records = [(f"r{r.randrange(30)}", r.choice([1, 2, 3, 4, None]), at(r.randrange(50)), r.choice([None, None, at(r.randrange(20, 80))])) for _ in range(90)]
    refs = [(i, r.choice([1, 2, 3, 4, 5, None]), at(r.randrange(80))) for i in range(200)]
    of = defaultdict(lambda: [None, None])
    for rec, n, a, e in records:
        if n is not None:
            x = of[n, rec]
            x[0] = a if x[0] is None else min(x[0], a)
            x[1] = x[1] if e is None else e if x[1] is None else min(x[1], e)
    want = {}
    for i, k, m in refs:
        mine = [(b, e or datetime.max) for (n, _), (b, e) in of.items() if n == k]
        if k is None or any(b <= m < e for b, e in mine):
            continue
        want[i] = "missing" if not mine else "deleted" if any(b <= m and b < e for b, e in mine) else "late"
    spans = orphans.lifetimes(spark.createDataFrame(records, "rec string, node long, b timestamp_ntz, e timestamp_ntz"), F.col("node"), F.col("rec"), "b", "e", salts=3)
    refs = spark.createDataFrame([(*x, "clash") for x in refs], "ref_key long, key long, moment timestamp_ntz, begin string")
    got = orphans.orphans(refs, spans, [("key", "key")], "simple", "ref_key", "moment").collect()
    assert {x["ref_key"]: x["reason"] for x in got} == want and len(got) == len(want)


def test_partly_null_keys_and_several_keys_at_their_moment(spark):
    at = lambda h: T0 + timedelta(hours=h)
    spans = spark.createDataFrame([(1, 1, at(0), at(10)), (1, 2, at(20), at(30)), (2, None, at(0), at(99))], "x long, y long, begin timestamp_ntz, end timestamp_ntz")
    refs = spark.createDataFrame([(1, 1, 1, at(5)), (2, 1, 1, at(15)), (3, 1, None, at(25)), (4, 1, None, at(15)), (5, None, 2, at(5)), (6, None, 7, at(5)), (7, None, None, at(5))], "id long, a long, b long, moment timestamp_ntz")
    got = lambda keys, m: rows(orphans.orphans(refs, spans, keys, m, "id", "moment").select("id", "null_mask", *["ref_column"] * isinstance(keys, dict), "reason"))
    pair = [("a", "x"), ("b", "y")]
    assert got(pair, "simple") == [(2, 0, "deleted")]
    assert got(pair, "partial") == [(2, 0, "deleted"), (4, 2, "deleted"), (5, 1, "late"), (6, 1, "missing")]
    assert got(pair, "full") == [(2, 0, "deleted"), (3, 2, "missing"), (4, 2, "missing"), (5, 1, "missing"), (6, 1, "missing")]
    assert got({"one": [("a", "x")], "two": [("b", "y")]}, "simple") == [(2, 0, "one", "deleted"), (2, 0, "two", "deleted"), (4, 2, "one", "deleted"), (5, 1, "two", "late"), (6, 1, "two", "missing")]


def test_no_references_and_no_targets(spark):
    none = spark.createDataFrame([], "id long, a long")
    one = spark.createDataFrame([(1, 7)], "id long, a long")
    assert orphans.orphans(none, one, [("a", "a")]).count() == 0
    assert [r["id"] for r in orphans.orphans(one, none, [("a", "a")]).collect()] == [1]


def test_salted_join_equals_plain_join_with_a_hot_key(spark):
    a = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(900)] + [(None, -1)], "k long, v long")
    b = spark.createDataFrame([(k, k * 2) for k in range(0, 400)] + [(1, 99), (None, 0)], "k long, w long")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = rows(a.join(b, "k", how))
        assert rows(salted_join(a, b, ["k"], how, F.col("v"), share=0.1, rows=10, salts=7)) == want
        got = salted_join(a, b, ["k"], how, F.col("v"), F.col("w") >= 0, share=0.1, rows=10, salts=7)
        assert rows(got) == want


# 5. Changes


def brute_replay(frames):
    best = {}
    for lsn, kind, txn, payload in frames:
        if lsn is None:
            continue
        try:
            body, whole = json.loads(payload), True
        except (TypeError, ValueError):
            body, whole = {}, False
        if lsn not in best or (whole and not best[lsn][3]):
            best[lsn] = (kind.upper(), txn and txn.lower(), body, whole)
    by = defaultdict(list)
    for lsn in sorted(best):
        by[best[lsn][1]].append((lsn, *best[lsn]))
    done = []
    for txn, fs in by.items():
        commit = next((f for f in fs if f[1] == "COMMIT"), None)
        if txn is None or commit is None or any(f[1] == "ABORT" and f[0] < commit[0] for f in fs):
            continue
        ops = [f for f in fs if f[1].startswith(("PUT", "DELETE")) and f[0] < commit[0]]
        if commit[3].get("op_count") is not None and len(ops) == int(commit[3]["op_count"]):
            done.append((commit[0], ops))
    state = {}
    for _, ops in sorted(done, key=lambda x: x[0]):
        for lsn, kind, _, body, _ in ops:
            key = f"r:{body['record_id']}" if kind.endswith("RECORD") and "record_id" in body else None
            if kind.endswith("EDGE") and "src" in body:
                key = "e:" + ":".join(str(int(body[k])) for k in ("src", "dst", "edge_type", "weight_million"))
            if key:
                state.pop(key, None)
                if kind.startswith("PUT"):
                    state[key] = lsn
    return state


def test_replay_equals_brute_force(spark):
    r = random.Random(7)
    frames, lsn = [], 0
    open_: list[list] = []
    for t in range(120):
        ops = []
        for _ in range(r.randrange(1, 4)):
            kind = r.choice(["PUT_RECORD", "DELETE_RECORD", "PUT_EDGE", "DELETE_EDGE"])
            body = {"record_id": f"k{r.randrange(25)}", "body": 'a"{', "node_id": r.choice([5, "5"])} if kind.endswith("RECORD") else {"dst": r.choice([1, "1"]), "src": r.randrange(9), "edge_type": 1, "weight_million": 0}
            ops.append((kind, json.dumps(body)))
        n = len(ops) + (r.random() < 0.1)
        end = r.choice(["COMMIT", "COMMIT", "COMMIT", "ABORT", None])
        seq = [("BEGIN", json.dumps({"op_count": n})), *ops, *([(end, json.dumps({"op_count": str(n)}) if end == "COMMIT" else None)] if end else []), *([("PUT_RECORD", '{"record_id":"late"}')] if r.random() < 0.1 else [])]
        open_.append([f"{t:032X}", seq])
    while open_:
        i = r.randrange(min(4, len(open_)))
        txn, seq = open_[i]
        kind, body = seq.pop(0)
        lsn += 1
        if r.random() < 0.15 and body:
            frames.append((lsn, kind.lower(), txn.lower(), body[: len(body) // 2]))
        frames += [(lsn, kind, txn, body)] * r.choice([1, 1, 2])
        if not seq:
            open_.pop(i)
    frames += [(None, "PUT_RECORD", "0" * 32, '{"record_id":"x"}'), (lsn + 1, "CHECKPOINT", "0" * 32, None), (lsn + 2, "PUT_RECORD", None, '{"record_id":"y"}')]
    r.shuffle(frames)
    df = spark.createDataFrame([(a, b, c, d and d.encode(), 1) for a, b, c, d in frames], "lsn long, frame_type string, transaction_id string, payload binary, j int")
    got = {x["entity"]: x["lsn"] for x in changefeed.replay(df).filter("NOT is_deleted").collect()}
    assert got == brute_replay(frames) and len(got) > 5


def test_fold_keeps_tombstones_and_takes_a_base_in_any_order(spark):
    schema = "k string, s long, op string, v int"
    changes = [("a", 3, "D", None), ("a", 2, "P", 1), ("b", 1, "P", 5), ("b", 1, "P", 5), (None, 9, "P", 1), ("c", None, "P", 1), ("d", 4, "P", 2), ("d", 4, "D", None)]
    base = spark.createDataFrame([("a", 0), ("z", 7)], "k string, v int")
    want = [("a", 3, True, None), ("b", 1, False, 5), ("d", 4, True, None), ("z", None, False, 7)]
    for some in (changes, changes[::-1]):
        got = changefeed.fold(spark.createDataFrame(some, schema), ["k"], ["s"], F.col("op") == "D", ["v"], base)
        assert rows(got) == want
    first = changefeed.fold(spark.createDataFrame(changes[:1], schema), ["k"], ["s"], F.col("op") == "D", ["v"])
    again = changefeed.fold(spark.createDataFrame(changes[1:2], schema), ["k"], ["s"], F.col("op") == "D", ["v"], first)
    assert rows(again) == [("a", 3, True, None)]
    assert changefeed.replay(spark.createDataFrame([], "lsn long, frame_type string, transaction_id string, payload binary")).count() == 0
