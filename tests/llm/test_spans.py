from __future__ import annotations

import random
from itertools import combinations

import numpy as np

from tidegraph.llm import spans, winnow


def brute(texts, span):
    grams = {i: {t[a : a + span] for a in range(len(t) - span + 1)} for i, t in texts.items() if t}
    pairs = {(a, b) for a, b in combinations(sorted(grams), 2) if grams[a] & grams[b]}
    shares = {}
    for i, t in texts.items():
        if t is None:
            continue
        others = set().union(*(g for j, g in grams.items() if j != i)) if grams else set()
        covered = set()
        for a in range(len(t) - span + 1):
            if t[a : a + span] in others:
                covered |= set(range(a, a + span))
        shares[i] = (len(t), len(covered))
    return pairs, shares


def corpus(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcde \n é😀") for _ in range(n))
    shared = [word(n) for n in (40, 41, 39, 120, 55)]
    texts = {i: word(r.randrange(30, 150)) for i in range(30)}
    for i in texts:
        for _ in range(r.choice([0, 1, 1, 2])):
            s = r.choice(shared)
            a = r.randrange(len(texts[i]))
            cut = r.choice([0, 0, 1, 10])
            texts[i] = texts[i][:a] + s[cut:] + texts[i][a:]
    texts |= {100: texts[1], 101: texts[1], 102: "x" * 300, 103: "x" * 200, 104: "", 105: None, 106: "short", 107: shared[0] + "!", 108: "?" + shared[0], 109: shared[0]}
    return texts


def test_pairs_and_shares_equal_brute_force_for_light_and_hot_phrases(spark):
    for seed, many in ((1, 200), (2, 1)):
        texts = corpus(seed)
        df = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "doc_id long, text string, phrase string").repartition(4)
        pairs, shares = brute(texts, 40)
        got = spans.Shared(df, span=40, phrase=12, many=many, **({} if many > 1 else {"phrases": 5, "stream": 300}))
        found = [tuple(r) for r in got.pairs().collect()]
        assert len(found) == len(set(found)) and set(found) == pairs
        assert {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in got.shares().collect()} == shares
        same = {i: min(j for j, u in texts.items() if u == t) if t and len(t) >= 40 else i for i, t in texts.items() if t is not None}
        near = {i: len({same[b if a == i else a] for a, b in pairs if i in (a, b)} - {same[i]}) for i in same}
        linked = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got.linked().collect()}
        assert linked == {i: (same[i], near[i]) for i in same}


def test_empty_table_null_ids_and_repeated_ids(spark):
    none = spans.Shared(spark.createDataFrame([], "doc_id long, text string"))
    assert none.pairs().count() == 0 and none.shares().count() == 0
    t = "".join(map(chr, range(400, 700)))
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, t[5:])], "doc_id long, text string")
    assert [tuple(r) for r in spans.Shared(df).pairs().collect()] == [(1, 2)]


def test_winnowing_guarantee():
    r = np.random.default_rng(1)
    shared = r.integers(0, 9, 60).astype(np.uint32)
    for _ in range(50):
        a, b = r.integers(0, 9, r.integers(0, 40)), r.integers(0, 9, r.integers(0, 40))
        x, y = np.concatenate([a, shared]).astype(np.uint32), np.concatenate([shared, b]).astype(np.uint32)
        codes, sizes = np.concatenate([x, y]), np.array([len(x), len(y)])
        text, at, h = winnow.fingerprints(codes, sizes, 20, 41)
        first = {(int(p) - len(a), int(v)) for t, p, v in zip(text, at, h, strict=True) if t == 0}
        second = {(int(p), int(v)) for t, p, v in zip(text, at, h, strict=True) if t == 1}
        assert first & second
    assert all(len(x) == 0 for x in winnow.fingerprints(np.empty(0, np.uint32), np.empty(0, np.int64), 5, 4))
