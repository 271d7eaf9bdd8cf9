"""Tokenises documents into files of ids, in the order of their doc_id, and reads them back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.llm.blockcoder import block_of, ids_of
from deltaloom.llm.files import get, put
from deltaloom.llm.idfile import BLOCK_IDS, IdFileError, file_of, list_documents, listed_documents, parts_of
from deltaloom.llm.text import ids_and_texts
from deltaloom.llm.tokens import drop_caches, process_cache, tokenizer_path
from deltaloom.sources.scratch import Scratch

VOCABULARY = "byte_bpe_50k.json"
END = 0
#: A file is closed when it holds so many ids.
FILE_IDS = 8 << 20

_MANIFEST = "path string, part int, number int, n_docs bigint, n_ids bigint, bytes bigint"
#: A row for each block of a file, and one for its documents after them.
_PIECES = "part int, number int, piece int, vocabulary int, ids binary, listed binary, n_ids bigint"


def _batch(schema: str, *rows: tuple) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    names, types = zip(*[column.split() for column in schema.split(", ")], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def _pieces(docs: DataFrame, path: str, end: int, file_ids: int) -> DataFrame:
    """The ids of docs(doc_id, text) in their order, by block and file, and each file's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, part, number, piece = process_cache(path), TaskContext.get().partitionId(), 0, 0
        size = cache.encoder.size
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        ids: list[np.ndarray] = []
        held = waiting = 0  # ids in the file, and those of them that are in no block yet

        def blocks(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal ids, waiting, piece
            if waiting < least:
                return
            flat = np.concatenate(ids)
            for at in range(0, waiting - least + 1, BLOCK_IDS):
                block = flat[at : at + BLOCK_IDS]
                yield _batch(_PIECES, (part, number, piece, size, block.tobytes(), None, len(block)))
                piece += 1
            left = flat[at + len(block) :]
            ids, waiting = [left], len(left)

        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), cache.each(batch.column(1), end), strict=True):
                doc_ids.append(doc_id)
                lengths.append(len(found))
                ids.append(found)
                held, waiting = held + len(found), waiting + len(found)
                yield from blocks(BLOCK_IDS)
                if held >= file_ids:
                    yield from blocks(1)
                    yield _batch(_PIECES, (part, number, piece, size, None, list_documents(doc_ids, np.array(lengths)), held))
                    doc_ids, lengths, ids, held, waiting, number, piece = [], [], [], 0, 0, number + 1, 0
        if doc_ids:
            yield from blocks(1)
            yield _batch(_PIECES, (part, number, piece, size, None, list_documents(doc_ids, np.array(lengths)), held))

    return docs.mapInArrow(run, _PIECES)


def write_files(docs: DataFrame, folder: str, path: str, end: int = END, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of docs by ascending doc_id, nulls first; one row per file, in order of (part, number).

    Rows that share a doc_id are ordered by a hash of their text, so that even a doc_id with very many rows is spread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["listed"] is None:
                    blocks.append(row["block"])
                    continue
                data = file_of(blocks, row["listed"], row["vocabulary"])
                where = put(folder, f"{row['part']:06d}-{row['number']:04d}.ids", data)
                yield _batch(_MANIFEST, (where, row["part"], row["number"], len(listed_documents(row["listed"])[0]), row["n_ids"], len(data)))
                blocks = []

    plain = ids_and_texts(docs).withColumn("tie", F.xxhash64("text"))
    ordered = plain.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    block = block_of(docs.sparkSession, F.col("ids"), F.col("vocabulary")).alias("block")
    coded = _pieces(ordered, path, end, file_ids).select("part", "number", "piece", "vocabulary", block, "listed", "n_ids")
    # Coded blocks move once, so that no task holds two Python workers.
    return coded.repartition("part", "number").sortWithinPartitions("part", "number", "piece").mapInArrow(run, _MANIFEST)


def read_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files of a manifest."""
    order = Window.orderBy("part", "number")  # a row per file, not per document
    first = F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    placed = manifest.select("path", first.alias("first"), (F.row_number().over(order) - 1).cast("int").alias("file"))
    pieces = "first bigint, file int, piece int, vocabulary int, block binary, listed binary"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for batch in batches:
            for row in batch.to_pylist():
                found, listed, vocabulary = parts_of(get(row["path"]))
                for piece, block in enumerate(found):
                    yield _batch(pieces, (row["first"], row["file"], piece, vocabulary, block, None))
                yield _batch(pieces, (row["first"], row["file"], len(found), vocabulary, None, listed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        held: list[pa.Buffer] = []
        for batch in batches:
            for first, ids, listed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if listed is None:
                    held.append(ids.as_buffer())
                    continue
                whole, (doc_ids, lengths) = memoryview(b"".join(held)), listed_documents(listed)
                ends, held = np.cumsum(lengths), []
                if len(whole) != 4 * ends[-1]:
                    raise IdFileError("a file has other ids than its documents")
                crcs = [zlib.crc32(whole[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [pa.array(x, pa.int64()) for x in (doc_ids, first + ends - lengths, lengths, crcs)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())
    # A file is a task's, to read and again to decode, so that no task holds two Python workers or two files.
    read = placed.repartitionById(files, F.col("file")).mapInArrow(blocks, pieces)
    read = read.repartitionById(files, F.col("file")).sortWithinPartitions("piece")
    ids = read.select("first", ids_of(manifest.sparkSession, F.col("block"), F.col("vocabulary")).alias("ids"), "listed")
    return ids.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def store_and_read(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, path: str | None = None) -> DataFrame:
    """Writes every document's ids, closed by ``end``, and returns what a reader finds.

    Null and empty texts have the end id alone. start counts the ids of all documents before. Rows that repeat are
    stored each on its own. No documents, no files, no rows.
    """
    scratch = Scratch(docs.sparkSession, "ids")
    manifest = scratch.save(write_files(docs, scratch.path("files"), path or tokenizer_path(vocabulary), end), "manifest")
    return read_files(manifest)
