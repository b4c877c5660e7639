"""Documents in blocks of bounded size, the unit in which text is handled by Arrow kernels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Code points in a block; a longer text makes a block of its own.
BLOCK_CHARS = 3_000_000
BLOCK_DOCS = 8_192


def block_number(sequence: int) -> int:
    """Unique over the job and the same when a task is repeated: the partition's number and the block's place in it."""
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 32) + sequence


def blocks(batches: Iterator[pa.RecordBatch], chars: int = BLOCK_CHARS, docs: int = BLOCK_DOCS) -> Iterator[tuple[list, list[str | None]]]:
    """(ids, texts) of blocks, from batches of an id and a text column."""
    ids: list = []
    texts: list[str | None] = []
    held = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n = len(t) if t else 0
            if ids and (held + n > chars or len(ids) >= docs):
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t)
            held += n
    if ids:
        yield ids, texts
