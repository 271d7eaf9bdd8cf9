"""Frequencies of the keys of documents as an index, made by each task for runs of its documents."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa

#: A task hands on its index when it has seen so many bytes of text, which bounds its memory.
CHUNK_BYTES = 24 << 20
CHUNK_BITS = 24

#: A row per key and chunk: where in the chunk the documents stand that hold it, and how often; and per chunk one row
#: without key that lists its documents with a number (extra) of each and, on end, a few measures of each.
INDEX = "key string, chunk bigint, places array<int>, counts array<int>, doc_ids array<bigint>, extras array<bigint>, measures array<double>"
_ARROW = pa.schema(
    [
        ("key", pa.string()),
        ("chunk", pa.int64()),
        ("places", pa.list_(pa.int32())),
        ("counts", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())),
        ("extras", pa.list_(pa.int64())),
        ("measures", pa.list_(pa.float64())),
    ]
)
_BATCH = 20_000


class Chunk:
    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.words, self.places, self.counts = array("i"), array("i"), array("i")
        self.doc_ids: list[int | None] = []
        self.extras: list[int] = []
        self.measures: list[float] = []
        self.bytes = 0

    def number(self, key: str) -> int:
        return self.numbers.setdefault(key, len(self.numbers))

    def add(self, doc_id: int | None, extra: int, measures: Iterable[float], counts: Mapping[int, int], size: int) -> None:
        """counts: by number() of the key."""
        place = len(self.doc_ids)
        self.doc_ids.append(doc_id)
        self.extras.append(extra)
        self.measures.extend(measures)
        self.bytes += size
        self.words.extend(counts.keys())
        self.counts.extend(counts.values())
        self.places.extend([place] * len(counts))

    def batches(self, chunk: int) -> Iterator[pa.RecordBatch]:
        words, places, counts = (np.array(x, dtype=np.int32) for x in (self.words, self.places, self.counts))
        order = np.argsort(words, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=len(self.numbers)))]).astype(np.int32)
        listed = [pa.ListArray.from_arrays(offsets, x[order]) for x in (places, counts)]
        n = len(self.numbers)
        keys = pa.array(list(self.numbers), pa.string())
        nothing = [pa.nulls(n, f.type) for f in list(_ARROW)[4:]]
        whole = pa.RecordBatch.from_arrays([keys, pa.array(np.full(n, chunk, dtype=np.int64)), *listed, *nothing], schema=_ARROW)
        for k in range(0, n, _BATCH):
            yield whole.slice(k, _BATCH)
        head = [[None], [chunk], [None], [None], [self.doc_ids], [self.extras], [self.measures]]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(head, _ARROW, strict=True)], schema=_ARROW)


class Chunks:
    """The chunks of one task, numbered apart from those of all others."""

    def __init__(self) -> None:
        from pyspark import TaskContext

        self.next = TaskContext.get().partitionId() << CHUNK_BITS
        self.open = Chunk()

    def full(self) -> Iterator[pa.RecordBatch]:
        if self.open.bytes >= CHUNK_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.open.doc_ids:
            yield from self.open.batches(self.next)
            self.next, self.open = self.next + 1, Chunk()
