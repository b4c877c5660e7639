from __future__ import annotations

import random

from tidegraph.llm import leaks

WORDS = "harbour winter Mühle ledger quarry vreemdeling Straße évêque timber morning kettle Brücke widow notice river gate school Kessel market chapel bridge storm letter".split()
SWAP = {"e": "c", "m": "rn", "n": "u", "h": "b", "d": "cl", "s": "ſ", "w": "vv", "l": "1", "r": "v"}


def scan(r, words, width=34, advert=True):
    """Words as a scanned page would have them: misread letters, broken lines, hyphens, adverts between lines."""
    hit = [w.replace(c, SWAP[c], 1) if r.random() < 0.3 and (c := r.choice(w)) in SWAP else w for w in words]
    text, lines = " ".join(hit), []
    while text:
        line, text = text[:width], text[width:]
        lines.append(line + "-" if text and line[-1].isalpha() and text[0].isalpha() else line)
    out = []
    for line in lines:
        out.append(line)
        if advert and r.random() < 0.3:
            out += ["No. 17 -- ==> Best wool, 18 per", "dozen. Apply Yard, Box 9."]
    return r.choice(["\n", "\r\n"]).join(out)


def test_every_planted_passage_is_found_and_no_shorter_one(spark):
    r = random.Random(3)
    pick = lambda n: [r.choice(WORDS) + r.choice(["", "", "stone", "keeper", ","]) for _ in range(n)]
    items = [(i, " ".join(pick(40))) for i in range(12)] + [(50, None), (51, ""), (52, " \n"), (53, "too short to leak"), (54, "?! " * 40)]
    items += [(60, items[0][1].upper().replace(" ", "\n"))]
    pages, want = [], set()
    for i, text in items[:12]:
        words = text.split()
        for n, doc in ((40, 100 + i), (17, 200 + i), (14, 300 + i), (11, 400 + i), (6, 500 + i)):
            a = r.randrange(40 - n + 1)
            body = scan(r, pick(30), advert=False) + "\n" + scan(r, words[a : a + n], advert=n == 40) + "\n" + scan(r, pick(20), advert=False)
            pages.append((doc, body, "clash"))
            if n >= 13:
                want |= {(i, doc)} | ({(60, doc)} if i == 0 else set())
    pages += [(1, None, "x"), (2, "", "x"), (3, " ", "x"), (None, items[0][1], "x"), (4, scan(r, pick(4000)), "x"), (5, "x" * 100_000, "x"), (100, pages[0][1], "x")]
    docs = spark.createDataFrame(pages, "doc_id long, text string, item_id string").repartition(3)
    tests = spark.createDataFrame([(*x, "s") for x in items], "item_id long, text string, doc_id string")
    got = leaks.leaks(docs, tests)
    rows = got.collect()
    found = {(x["item_id"], x["doc_id"]) for x in rows}
    assert len(rows) == len(found) and found == want


def test_search_in_shards_equals_one_broadcast(spark):
    r = random.Random(4)
    words = ["".join(r.sample("covtuqhspzx", 8)) for _ in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words[5:30])), (2, " ".join(words[:9])), (3, " ".join(words[:20][::-1]))], "doc_id long, text string")
    tests = spark.createDataFrame([(7, " ".join(words)), (8, " ".join(words[::-1])), (9, " ".join(words)), (10, None)], "item_id long, text string")
    want = sorted(tuple(r) for r in leaks.leaks(docs, tests).collect())
    assert want == [(7, 1, 25, 40), (8, 3, 20, 40), (9, 1, 25, 40)]
    assert sorted(tuple(r) for r in leaks.leaks(docs, tests, test_chars=100).collect()) == want


def test_every_script_is_searched(spark):
    r = random.Random(8)
    letters = {"Han": (0x4E00, 0x9F00), "Hangul": (0xAC00, 0xD700), "Hebrew": (0x05D0, 0x05EA), "Arabic": (0x0627, 0x063A), "Devanagari": (0x0904, 0x0939), "Greek": (0x03B1, 0x03C9), "Han beyond": (0x20000, 0x2A000)}
    pages, items = [], []
    for k, (low, high) in enumerate(letters.values()):
        words = ["".join(chr(r.randrange(low, high)) for _ in range(4)) for _ in range(20)]
        items.append((k, " ".join(words)))
        pages += [(10 * k, "x y\n" + " ".join(words[2:18])), (10 * k + 1, " ".join(words[:4]) + " other")]
    run = "".join(chr(r.randrange(0x4E00, 0x9F00)) for _ in range(60))
    items.append((90, run))
    pages += [(900, "plain " + run[6:46] + " text"), (901, run[:20])]
    got = leaks.leaks(spark.createDataFrame(pages, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((x["item_id"], x["doc_id"], x["n_words"]) for x in got.collect()) == [*[(k, 10 * k, 16) for k in range(7)], (90, 900, 20)]


def test_clean_texts_against_brute_force(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("cotuqhspzxiv") for _ in range(r.randrange(3, 9)))
    items = [(i, [word() for _ in range(30)]) for i in range(30)]
    pages = []
    for d in range(200):
        body = [word() for _ in range(r.randrange(5, 60))]
        if r.random() < 0.7:
            source, n = r.choice(items)[1], r.randrange(8, 20)
            a = r.randrange(0, 30 - n)
            body[2:2] = source[a : a + n]
        pages.append((d, body))
    want = set()
    for i, words in items:
        parts = {tuple(words[a : a + 13]) for a in range(18)}
        want |= {(i, d) for d, body in pages if any(tuple(body[a : a + 13]) in parts for a in range(len(body) - 12))}
    docs = spark.createDataFrame([(d, " ".join(b)) for d, b in pages], "doc_id long, text string")
    got = leaks.leaks(docs, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    assert want and {(x["item_id"], x["doc_id"]) for x in got.collect()} == want


def test_nothing_to_search(spark):
    docs, none = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leaks.leaks(docs, none).count() == 0
    assert leaks.leaks(docs.limit(0), spark.createDataFrame([(1, "w " * 40)], "item_id long, text string")).count() == 0


def test_folding():
    assert leaks.fold("Große ﬁſh, 𝔊 ro-\nom") == leaks.fold("grosse fish room")
    assert leaks.fold("müde") == leaks.fold("miide") and leaks.fold("clown") == leaks.fold("down")
    assert leaks.fold("­»■ \t—") == ""


def test_a_run_after_a_garbled_word_of_equal_length_is_found(spark):
    words = [f"{w}{x}" for w in WORDS[:20] for x in ("stone", "keeper", "field")]
    page = [*words[:5], "q" * len(leaks.fold(words[5])), *words[6:]]
    docs = spark.createDataFrame([(1, " ".join(page)), (2, " ".join(page[:18]))], "doc_id long, text string")
    got = leaks.leaks(docs, spark.createDataFrame([(7, " ".join(words))], "item_id long, text string"))
    assert [tuple(r) for r in got.filter("doc_id = 1").collect()] == [(7, 1, 54, 60)]
    assert got.filter("doc_id = 2").count() == 0


def test_lines_of_eighteen_letters_between_lines_of_another_column_are_enough(spark):
    r = random.Random(5)
    pick = lambda n: ["".join(r.sample("covtuqhspzx", 9)) for _ in range(n)]
    words, other = pick(14), pick(40)
    lines = [x for k in range(7) for x in (" ".join(words[2 * k : 2 * k + 2]), " ".join(other[3 * k : 3 * k + 3]))]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[:12]))], "doc_id long, text string")
    tests = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert [tuple(x) for x in leaks.leaks(docs, tests).collect()] == [(7, 1, 14, 14)]


def test_a_passage_goes_on_after_any_number_of_inserted_lines(spark):
    r = random.Random(6)
    pick = lambda n: ["".join(r.sample("covtuqhspzx", 9)) for _ in range(n)]
    words = pick(16)
    page = [" ".join(words[:8]), *[" ".join(pick(4)) for _ in range(40)], " ".join(words[8:])]
    docs = spark.createDataFrame([(1, "\n".join(page)), (2, "\n".join(page[:-1]))], "doc_id long, text string")
    tests = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert [tuple(x) for x in leaks.leaks(docs, tests).collect()] == [(7, 1, 16, 16)]
