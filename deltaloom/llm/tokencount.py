"""Token counts without ids.

Each task turns runs of its documents into frequencies of pre-tokens, in the form of an index: per pre-token the
documents that hold it and how often. The index is dealt out by pre-token in packed buckets. Where a pre-token arrives,
its pieces are counted once and joined to all its frequencies; the products, summed per document, go back to the run
they came from. Pre-tokens that many documents of a run hold are dealt out by run as well, so the commonest are spread
over all buckets: a bucket counts such a pre-token's pieces once more, and no task gets the whole of it.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.text import ids_and_texts
from deltaloom.llm.tokens import Encoder, process_cache, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
#: A run of documents ends at so many bytes of text or so many documents, which bounds a task's memory.
RUN_BYTES, RUN_DOCS = 24 << 20, 200_000
_RUN_BITS = 24
#: A bucket for so many bytes of text, so its task does not grow with the input; and at most so many, as each run deals to
#: all of them. Beyond 512 GB of text a bucket's task reads more, some of it at a time.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 8192
#: A pre-token is common if more than this share of a run's documents hold it.
COMMON = 0.05
#: Sums that a task holds before it hands them on.
HELD_SUMS = 2_000_000

_INDEX = "bucket int, run bigint, packed binary"
_SUMS = "run bigint, packed binary"


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays of unsigned 32-bit integers, or bytes, as one compressed value."""
    parts = [a if isinstance(a, bytes) else a.astype("<u4").tobytes() for a in arrays]
    sizes = np.array([len(parts), *map(len, parts)], dtype="<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(sizes + b"".join(parts))


def unpack(data: bytes) -> list[bytes]:
    plain = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(plain, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(plain, "<u4", n, 4)) + 4 * (n + 1)
    return [plain[a:b] for a, b in zip([4 * (n + 1), *ends[:-1]], ends, strict=True)]


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4")


class _Run:
    """The index of a run of documents."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder
        self.of_part: dict[str, tuple[int, ...]] = {}
        self.numbers: dict[str, int] = {}
        self.keys, self.places, self.counts = array("I"), array("I"), array("I")
        self.doc_ids: list[int | None] = []
        self.n_bytes: list[int] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str) -> None:
        mine: dict[int, int] = {}
        of_part, numbers = self.of_part, self.numbers
        for part, n in Counter(self.encoder.parts(text)).items():
            found = of_part.get(part)
            if found is None:
                found = of_part[part] = tuple(numbers.setdefault(t, len(numbers)) for t in self.encoder.pre_tokens(part))
            for k in found:
                mine[k] = mine.get(k, 0) + n
        size = len(text.encode("utf-8", "surrogatepass"))
        self.keys.extend(mine.keys())
        self.counts.extend(mine.values())
        self.places.extend([len(self.doc_ids)] * len(mine))
        self.doc_ids.append(doc_id)
        self.n_bytes.append(size)
        self.bytes += size

    def full(self) -> bool:
        return self.bytes >= RUN_BYTES or len(self.doc_ids) >= RUN_DOCS

    def rows(self, run: int, buckets: int) -> Iterator[tuple[int, int, bytes]]:
        """A row per bucket: pre-tokens and their postings; and at -1 the documents."""
        written = [t.encode("utf-8", "surrogatepass") for t in self.numbers]
        keys, places, counts = (np.array(x, dtype=np.uint32) for x in (self.keys, self.places, self.counts))
        held = np.bincount(keys, minlength=len(written))
        bucket = np.fromiter(map(zlib.crc32, written), dtype=np.int64, count=len(written))
        bucket = (bucket + np.where(held > COMMON * len(self.doc_ids), run, 0)) % buckets
        order = np.lexsort((places, keys, bucket[keys]))
        keys, places, counts = keys[order], places[order], counts[order]
        by_bucket = np.argsort(bucket, kind="stable")  # pre-tokens in the order of their postings
        key_ends = np.cumsum(np.bincount(bucket, minlength=buckets))
        ends = np.cumsum(np.bincount(bucket[keys], minlength=buckets)) if len(keys) else np.zeros(buckets, dtype=np.int64)
        a = b = 0
        for k in range(buckets):
            if key_ends[k] > b:
                mine = by_bucket[b : key_ends[k]]
                texts = [written[i] for i in mine]
                part = slice(a, ends[k])
                yield k, run, pack(np.array(list(map(len, texts))), b"".join(texts), held[mine], places[part], counts[part])
            a, b = ends[k], key_ends[k]
        there = np.array([d is not None for d in self.doc_ids])
        ids = np.array([d or 0 for d in self.doc_ids], dtype="<i8").tobytes()
        yield -1, run, pack(there, ids, np.array(self.n_bytes))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = {"bucket": pa.int32(), "run": pa.int64(), "packed": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(x, types[n]) for n, x in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def index(docs: DataFrame, path: str, buckets: int) -> DataFrame:
    """(bucket, run, packed): the packed index of all documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, number = process_cache(path).encoder, TaskContext.get().partitionId() << _RUN_BITS
        now = _Run(encoder)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                now.add(doc_id, text.as_py() or "")
                if now.full():
                    yield _batch(list(now.rows(number, buckets)), ["bucket", "run", "packed"])
                    number, now = number + 1, _Run(encoder)
        if now.doc_ids:
            yield _batch(list(now.rows(number, buckets)), ["bucket", "run", "packed"])

    return docs.mapInArrow(run, _INDEX)


def join_pieces(dealt: DataFrame, path: str) -> DataFrame:
    """(run, packed): per run sums of pieces by document, from the buckets of a task; documents pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = process_cache(path).encoder
        pieces: dict[bytes, int] = {}
        sums: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            for number, parts in sums.items():
                n = np.bincount(np.concatenate([p for p, _ in parts]), weights=np.concatenate([x for _, x in parts]))
                places = np.flatnonzero(n)
                yield _batch([(number, pack(np.diff(places, prepend=0), n[places]))], ["run", "packed"])

        for batch in batches:
            for bucket, number, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket < 0:
                    yield _batch([(number, packed)], ["run", "packed"])
                    continue
                lengths, texts, held, places, counts = unpack(packed)
                n, at = [], 0
                for length in _numbers(lengths).tolist():
                    key = texts[at : at + length]
                    at += length
                    if key not in pieces:
                        pieces[key] = len(encoder.encode_pre_token(key.decode("utf-8", "surrogatepass")))
                    n.append(pieces[key])
                products = np.repeat(np.array(n, dtype=np.int64), _numbers(held)) * _numbers(counts)
                found = _numbers(places)
                sums.setdefault(number, []).append((found, products))
                size += len(found)
                if size >= HELD_SUMS:
                    yield from hand_on()
                    sums, size = {}, 0
                if len(pieces) > 1_000_000:
                    pieces = {}
        yield from hand_on()

    return dealt.mapInArrow(run, _SUMS)


def gather(sums: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of the documents of the runs that a task gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents: dict[int, list[bytes]] = {}
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = unpack(packed)
                if len(parts) == 3:
                    documents[number] = parts
                    continue
                places = np.cumsum(_numbers(parts[0]).astype(np.int64))
                total = totals.setdefault(number, np.zeros(0, dtype=np.int64))
                if len(places) and places[-1] >= len(total):
                    totals[number] = total = np.concatenate([total, np.zeros(places[-1] + 1 - len(total), dtype=np.int64)])
                total[places] += _numbers(parts[1])
        for number, (there, ids, n_bytes) in documents.items():
            sizes = _numbers(n_bytes)
            total = np.zeros(len(sizes), dtype=np.int64)
            found = totals.get(number, total)
            total[: len(found)] = found
            doc_ids = pa.array(np.frombuffer(ids, "<i8"), pa.int64(), mask=_numbers(there) == 0)
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(sizes, pa.int64()), pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"])

    return sums.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = 1024, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row of docs.

    Null and empty texts have no bytes and no tokens. Rows that repeat are counted each on its own; a null doc_id stays
    null. No rows give no rows.
    """
    path = path or tokenizer_path(vocabulary)
    plain = ids_and_texts(docs)
    size = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]  # one number
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, -(-size // BUCKET_BYTES)))
    where = F.when(F.col("bucket") < 0, F.pmod("run", F.lit(buckets))).otherwise(F.col("bucket")).cast("int")
    dealt = index(plain, path, buckets).repartitionById(buckets, where)
    found = gather(join_pieces(dealt, path).repartition("run"))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
