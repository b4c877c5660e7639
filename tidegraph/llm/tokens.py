"""Encoding a corpus with a public byte-level BPE vocabulary, each distinct word once, and decoding it again."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.blocks import block_number, blocks
from tidegraph.plans.lineage import cut
from tidegraph.plans.skew import salted_join

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: how this vocabulary's public definition splits text before merging bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as Unicode has it; some regular expression engines count the separators U+001C to U+001F too.
SPACE, NOT_SPACE = r"\p{White_Space}", r"\P{White_Space}"


def splitter():
    import regex

    return regex.compile(PATTERN.replace(r"[^\s\p{L}", rf"[^{SPACE}\p{{L}}").replace(r"\S", NOT_SPACE).replace(r"\s", SPACE))


def _pretokens(doc_id: str):
    schema = pa.schema([("block", pa.int64()), ("code", pa.int32()), ("word", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = splitter().findall
        for number, (ids, texts) in enumerate(blocks(batches)):
            code_of: dict[str, int] = defaultdict(count().__next__)
            sizes, parts = [], []
            for t in texts:
                words = find(t) if t else []
                sizes.append(len(words))
                parts.append(np.fromiter(map(code_of.__getitem__, words), np.int32, len(words)))
            codes = np.concatenate(parts) if parts else np.empty(0, np.int32)
            kind = np.uint16 if len(code_of) <= 65_536 else np.int32
            b, n = block_number(number), len(code_of)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b]), pa.array([None], pa.int32()), pa.array([None], pa.string()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([codes.astype(kind).tobytes()], pa.binary())],
                schema=schema,
            )
            words = list(code_of)
            for at in range(0, n, 20_000):
                some = words[at : at + 20_000]
                k = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, b)), pa.array(np.arange(at, at + k, dtype=np.int32)), pa.array(some, pa.string()), pa.nulls(k, schema.field(3).type), pa.nulls(k, schema.field(4).type), pa.nulls(k, pa.binary())],
                    schema=schema,
                )

    return run


def _encoder(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabulary)
        t.encode_special_tokens = True
        for batch in batches:
            ids = [e.ids for e in t.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def _reassemble(doc_id: str):
    def run(words: pa.Table, docs: pa.Table) -> pa.Table:
        names = [doc_id, "ids"]
        outs = []
        for row in range(docs.num_rows):
            ids = docs.column("doc_ids")[row].values
            sizes = docs.column("sizes")[row].values.to_numpy(zero_copy_only=False)
            n_words = words.num_rows
            raw = docs.column("codes")[row].as_py()
            codes = np.frombuffer(raw, np.uint16 if n_words <= 65_536 else np.int32)
            order = np.argsort(words.column("code").to_numpy())
            lists = words.column("ids").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
            if n_words:
                off = lists.offsets.to_numpy()
                flat = lists.values.to_numpy()
                begin, length = off[:-1][order], np.diff(off)[order]
                per = length[codes]
                ends = np.concatenate([[0], np.cumsum(per)])
                at = np.arange(ends[-1]) - np.repeat(ends[:-1], per) + np.repeat(begin[codes], per)
                out = flat[at].astype(np.int32)
            else:
                ends, out = np.zeros(1, np.int64), np.empty(0, np.int32)
            doc_ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            outs.append(pa.Table.from_arrays([ids.cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends[doc_ends].astype(np.int32)), pa.array(out))], names=names))
        return pa.concat_tables(outs) if outs else pa.table({doc_id: pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})

    return run


def encode(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids array<int>): the token ids of each text, without special tokens; their strings count as plain text.

    Null and empty texts have an empty list. Every row comes out, repeated and null doc_ids too. Other columns are left
    out. ``documents`` must come in the same order when a task is repeated, as a scan does.

    Texts are split into words in blocks. A block holds each of its words once, with a code; its texts are the codes in
    the order of their positions. Distinct words over all blocks are encoded once; their ids go back to the blocks that
    hold them (rows of words in very many blocks are split), where the positions are filled.
    """
    schema = "block long, code int, word string, doc_ids array<long>, sizes array<int>, codes binary"
    pre = cut(documents.select(doc_id, text).mapInArrow(_pretokens(doc_id), schema))
    held = pre.filter("word IS NOT NULL").select("block", "code", "word")
    encoded = held.select("word").distinct().mapInArrow(_encoder(vocabulary), "word string, ids array<int>")
    back = salted_join(held, encoded, ["word"], "inner", F.col("block")).select("block", "code", "ids")
    docs = pre.filter("word IS NULL").select(F.col("block").alias("at"), "doc_ids", "sizes", "codes")
    return back.groupBy("block").cogroup(docs.groupBy("at")).applyInArrow(_reassemble(doc_id), f"{doc_id} long, ids array<int>")


def token_bytes(vocabulary: str = VOCABULARY) -> pa.Array:
    """The bytes of every token, by id; null where an id is free. Byte-level vocabularies write bytes as printable letters."""
    import json

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    table: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in byte_of for c in t)}
    table |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    return pa.array([table.get(i) for i in range(max(table) + 1)], pa.binary())


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from ids, by joining the token-byte table (of the vocabulary's size) to every id in its place.

    An empty or null list gives an empty text. Bytes that form no UTF-8 become replacement characters; an id outside of
    the vocabulary is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(vocabulary)
        for batch in batches:
            lists = batch.column(1).fill_null([])
            ids = lists.flatten()
            odd = len(ids) and (pa.compute.min(ids).as_py() < 0 or pa.compute.max(ids).as_py() >= len(table))
            flat = table.take(ids) if not odd and not ids.null_count else None
            if flat is None or flat.null_count:
                raise ValueError("an id names no token of this vocabulary")
            sizes = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(pa.compute.binary_length(flat).to_numpy(zero_copy_only=False))]).astype(np.int64)
            data = b"".join(flat.to_pylist())
            cuts = ends[sizes]
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[doc_id, "text"])

    return encoded.select(doc_id, ids).mapInArrow(run, f"{doc_id} long, text string")
