from __future__ import annotations

import os

import pytest

from tidegraph.llm import blocks, tokens

TEXTS = [
    None, "", " ", "\n\n", "Hello world", "a\x1cb \x1d\x1ec", "x  y   ", "\u0085 q", "<|endoftext|> hi", "I'll 's ''s don'T", "퟿½²³ ٣", "\r\n\r\n x\t\ty", "😀 𝔊 ﬁ​",
    "é é", "word " * 4000, "x" * 20_000, "Hello world", "　  z", "12345 67", "…—„“",
]
pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")


def expected(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.VOCABULARY)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_equal_the_library_and_decode_to_the_text(spark, monkeypatch):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "c", 1), (3, "same id", "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, block int")
    want = sorted(zip([r[0] for r in rows], expected([r[1] for r in rows]), strict=True), key=repr)
    for parts in (1, 4):
        out = tokens.encode(df.repartition(parts))
        assert sorted(((r["doc_id"], list(r["ids"])) for r in out.collect()), key=repr) == want
    back = sorted(((r["doc_id"], r["text"]) for r in tokens.decode(out).collect()), key=repr)
    assert back == sorted(((r[0], r[1] or "") for r in rows), key=repr)


def test_blocks_hold_every_text_once():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"i": list(range(7)), "t": ["aa", None, "b" * 9, "", "c", "dd", "e"]})
    got = list(blocks.blocks(iter([batch, batch]), chars=4, docs=3))
    assert [i for ids, _ in got for i in ids] == [*range(7), *range(7)]
    assert all(len(ids) <= 3 for ids, _ in got) and all(sum(len(t or "") for t in ts) <= 4 or len(ts) == 1 for _, ts in got)


def test_empty_table_and_foreign_ids(spark):
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted((r[0], list(r[1])) for r in tokens.encode(blank).collect()) == [(1, []), (2, [])]
    with pytest.raises(Exception, match="names no token"):
        tokens.decode(spark.createDataFrame([(1, [99_999])], "doc_id long, ids array<int>")).collect()
    assert [r["text"] for r in tokens.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()] == [""]
