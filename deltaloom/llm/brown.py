"""Class-based bigrams after Brown: exchange clustering of words, class transitions and word emissions.

The most frequent words, by rank, are clustered first: the driver moves them one after another, against bigram counts of
these words and of groups of all others, until moves add little. Their number and that of the groups are parameters, so
what the driver holds is bounded. A group is the words of equal last two bytes; its class is where its words start, and
where words stay that were seen less than ``min_count`` times, or never.

Every other word is then clustered too, however many there are. Texts lie in chunks as numbers of the chunk's own words.
In a round each chunk counts the classes before and after its words, and deals the counts out to buckets by word; a
bucket adds up what all chunks have of its words, moves them to their best classes against one table of class bigrams,
and sends the classes and counts of its words back to the chunks that asked. The first round moves all words, as they
meet known classes; later ones half of them at a time. The best assignment by the likelihood is kept. The vocabulary is
never gathered: a bucket holds its own words, and there are as many buckets as the vocabulary asks for.

A text's probability is the product, over its words and its end, of the class given the class before and the word given
its class. Words are known by 64-bit hashes; among 10^9 distinct words, 0.03 pairs are expected to share one.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.exchange import END_CLASS, best_classes, cluster, likelihood
from deltaloom.llm.packed import pack, unpack
from deltaloom.llm.text import folded_words, ids_and_texts
from deltaloom.sources.scratch import Scratch


@dataclass(frozen=True)
class BrownModel:
    """folds and held_fold: documents whose crc32(doc_id as text) mod folds is held_fold are not learnt from.
    frequent, groups: words, and groups of other words, that the driver clusters, for up to ``rounds``. min_count: training
    tokens from which on any word is clustered. word_rounds: moves of the other words. Either ends when the likelihood
    grows by less than ``least_gain``. alpha: added to a word's count in its class, and once for words never seen. prior:
    weight of the plain class distribution in a transition. chunk_tokens and chunk_words: a chunk ends at so many tokens,
    or distinct words. bucket_words: words that chunks ask of a bucket, on average."""

    classes: int = 64
    frequent: int = 1000
    groups: int = 256
    rounds: int = 10
    word_rounds: int = 3
    min_count: int = 2
    least_gain: float = 1e-4
    alpha: float = 0.5
    prior: float = 20.0
    folds: int = 7
    held_fold: int = 2
    chunk_tokens: int = 1_000_000
    chunk_words: int = 250_000
    bucket_words: int = 50_000


_BINS = 64
_HELD = 1 << 20
#: Of a chunk: which documents have an id, the ids, numbers of words, tokens (0 for an end), keys and groups of the words.
_CHUNK = ("u1", "<i8", "<u4", "<u4", "<u8", "<u2")
#: Of the words a chunk asks a bucket for: keys, classes, numbers of context codes, codes, how often each.
_CONTEXTS = ("<u8", "u1", "<u2", "<u2", "<u4")
_REPLY = ("u1", "<u8")


def held_out(doc_id: int | None, model: BrownModel) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % model.folds == model.held_fold


def key_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def group_of(word: bytes, model: BrownModel) -> int:
    return zlib.crc32(word[-2:]) % model.groups


def _rows(names: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, names.values(), strict=True)], names=list(names))


# -- chunks ---------------------------------------------------------------------------------------------------------


def text_chunks(docs: DataFrame, model: BrownModel) -> DataFrame:
    """(chunk, words, packed): texts as numbers of the chunk's words, an end before the first and after each."""
    names = {"chunk": pa.int64(), "words": pa.int64(), "packed": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32

        def begun() -> tuple:
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = lambda: len(number) + 1
            return number, [], [], array("I", [0])

        number, doc_ids, sizes, tokens = begun()

        def whole() -> pa.RecordBatch:
            ids = np.array([d or 0 for d in doc_ids], dtype="<i8")
            there = np.array([d is not None for d in doc_ids], dtype="u1")
            keys = np.fromiter(map(xxhash.xxh3_64_intdigest, number), dtype="<u8", count=len(number))
            number.default_factory = None  # which refers back to the words
            groups = np.fromiter((zlib.crc32(w[-2:]) for w in number), dtype="<u4", count=len(number)) % model.groups
            return _rows(names, [(place, len(number), pack(there, ids, np.array(sizes, dtype="<u4"), np.array(tokens, dtype="<u4"), keys, groups.astype("<u2")))])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = folded_words(text.as_py())
                tokens.extend(map(number.__getitem__, found))
                tokens.append(0)
                doc_ids.append(doc_id)
                sizes.append(len(found))
                if len(tokens) >= model.chunk_tokens or len(number) >= model.chunk_words:
                    yield whole()
                    place += 1
                    number, doc_ids, sizes, tokens = begun()
        if doc_ids:
            yield whole()

    return docs.mapInArrow(run, "chunk bigint, words bigint, packed binary")


class _Chunk:
    def __init__(self, packed: bytes, model: BrownModel) -> None:
        there, ids, sizes, tokens, self.keys, self.groups = unpack(packed, *_CHUNK)
        self.doc_ids = [d if t else None for d, t in zip(ids.tolist(), there.tolist(), strict=True)]
        self.sizes, self.tokens = sizes.astype(np.int64), tokens.astype(np.int64)
        self.learnt = np.repeat([not held_out(d, model) for d in self.doc_ids], self.sizes + 1)  # of all tokens but the first

    def counts(self) -> tuple[np.ndarray, int]:
        """How often the training texts have each word, and how many there are."""
        n = np.bincount(self.tokens[1:][self.learnt], minlength=len(self.keys) + 1)
        return n[1:], int(n[0])


def _bucketed(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[int]]:
    """The order of keys by bucket, and where each bucket's begin in it."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    return np.argsort(bucket, kind="stable"), [0, *np.cumsum(np.bincount(bucket, minlength=buckets)).tolist()]


def dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Each bucket's rows in a partition of their own."""
    return rows.repartitionById(buckets, F.col("bucket"))


# -- frequent words -------------------------------------------------------------------------------------------------


def frequent_words(chunks: DataFrame, buckets: int, scratch: Scratch, model: BrownModel) -> tuple[list[tuple[int, int]], int, int, int]:
    """((key, count) of the most frequent words, all training tokens, distinct words, ends of texts)."""
    names = {"bucket": pa.int32(), "packed": pa.binary()}
    top = {"key": pa.int64(), "c": pa.int64(), "v": pa.int64(), "ends": pa.int64()}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                chunk = _Chunk(packed.as_py(), model)
                n, ends = chunk.counts()
                seen = np.flatnonzero(n)
                order, starts = _bucketed(chunk.keys[seen], buckets)
                keys, n = chunk.keys[seen][order], n[seen][order].astype("<u4")
                rows = [(k, pack(keys[a:b], n[a:b], np.zeros(0, "<i8"))) for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False)) if a < b]
                rows.append((0, pack(keys[:0], n[:0], np.array([ends], "<i8"))))
                yield _rows(names, rows)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, ends, held = np.zeros(0, "<u8"), np.zeros(0, np.int64), 0, []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every, at = np.unique(np.concatenate([keys, *[k for k, _ in held]]), return_inverse=True)
            return every, np.bincount(at, weights=np.concatenate([n, *[x for _, x in held]]), minlength=len(every)).astype(np.int64)

        size = 0
        for batch in batches:
            for packed in batch.column(1):
                k, x, e = unpack(packed.as_py(), "<u8", "<u4", "<i8")
                held.append((k, x))
                ends, size = ends + int(e.sum()), size + len(k)
                if size > _HELD:
                    keys, n = merged()
                    held, size = [], 0
        keys, n = merged()
        best = np.lexsort((keys, -n))[: model.frequent]
        rows = [(k, c, None, None) for k, c in zip(keys[best].view(np.int64).tolist(), n[best].tolist(), strict=True)]
        yield _rows(top, [*rows, (None, int(n.sum()), len(keys), ends)])

    sent = dealt(chunks.select("packed").mapInArrow(send, "bucket int, packed binary"), buckets)
    found = scratch.save(sent.mapInArrow(add, "key bigint, c bigint, v bigint, ends bigint"), "top")
    sums = [F.coalesce(F.sum(name), F.lit(0)) for name in ("c", "v", "ends")]
    n, distinct, ends = found.where("key IS NULL").agg(*sums).collect()[0]
    # In few partitions, each of which sends the driver as many rows as it asks for.
    rows = found.where("key IS NOT NULL").select("key", "c").coalesce(_BINS).orderBy(F.desc("c"), "key").limit(model.frequent).collect()
    return [(r["key"] % (1 << 64), r["c"]) for r in rows], n + ends, distinct + int(ends > 0), ends


class _Types:
    """The types of words: 0 is the end, then the frequent words, then the groups; and where the frequent are."""

    def __init__(self, frequent: list[tuple[int, int]], model: BrownModel) -> None:
        keys = np.array([k for k, _ in frequent], dtype="<u8")
        self.by_key = np.argsort(keys)
        self.sorted = keys[self.by_key]
        self.counts = np.array([c for _, c in frequent], dtype=np.int64)
        self.first_group = 1 + len(keys)
        self.n = self.first_group + model.groups

    def of(self, chunk: _Chunk) -> np.ndarray:
        """The type of each of a chunk's words."""
        out = self.first_group + chunk.groups.astype(np.int64)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, chunk.keys), len(self.sorted) - 1)
            there = self.sorted[at] == chunk.keys
            out[there] = 1 + self.by_key[at[there]]
        return out


def type_bigrams(chunks: DataFrame, types: Broadcast, model: BrownModel) -> np.ndarray:
    """How often type b (column) follows type a (row) in the training texts. Executors add up bins of the cells, so the
    driver gets each cell once, of which there are as many as the parameters say."""
    names = {"bin": pa.int32(), "packed": pa.binary()}
    width = -(-(types.value.n ** 2) // _BINS)

    def binned(table: np.ndarray, k: int) -> tuple[int, bytes]:
        at = np.flatnonzero(table)
        return k, pack(at.astype("<u4"), table[at].astype("<i8"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(width * _BINS, dtype=np.int64)
        for batch in batches:
            for packed in batch.column(0):
                chunk = _Chunk(packed.as_py(), model)
                of = np.concatenate([[0], types.value.of(chunk)])[chunk.tokens]
                pairs, n = np.unique((of[:-1] * types.value.n + of[1:])[chunk.learnt], return_counts=True)
                table[pairs] += n
        # Neighbouring cells, as those of the most frequent words, lie in different bins.
        yield _rows(names, [binned(table[k::_BINS], k) for k in range(_BINS)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(width, dtype=np.int64))
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, n = unpack(packed.as_py(), "<u4", "<i8")
                tables[k][at] += n
        yield _rows(names, [binned(table, k) for k, table in tables.items()])

    schema = "bin int, packed binary"
    out = np.zeros((width, _BINS))
    for row in chunks.select("packed").mapInArrow(count, schema).repartitionById(_BINS, F.col("bin")).mapInArrow(add, schema).collect():
        at, n = unpack(bytes(row["packed"]), "<u4", "<i8")
        out[at, row["bin"]] = n
    return out.ravel()[: types.value.n ** 2].reshape(types.value.n, -1)


# -- all other words ------------------------------------------------------------------------------------------------


def _beside(chunks: DataFrame, replies: DataFrame | None) -> DataFrame:
    """(chunk, bucket, packed): each chunk, as bucket -1, and then what buckets have replied to it, in their order."""
    texts = chunks.select("chunk", F.lit(-1).alias("bucket"), "packed")
    if replies is None:
        return texts
    both = texts.unionAll(replies.where("chunk >= 0").select("chunk", "bucket", "packed"))
    return both.repartition(F.col("chunk")).sortWithinPartitions("chunk", "bucket")


class _Known:
    """A chunk whose words have types, classes and, from replies, counts."""

    def __init__(self, chunk: _Chunk, replies: list[bytes], types: _Types, classes: np.ndarray, buckets: int) -> None:
        self.chunk, of = chunk, types.of(chunk)
        #: The words that are not frequent, by bucket.
        others = np.flatnonzero(of >= types.first_group)
        order, self.starts = _bucketed(chunk.keys[others], buckets)
        self.others = others[order]
        word_class, self.counts = classes[of], np.zeros(len(of), dtype=np.int64)
        frequent = np.flatnonzero(of < types.first_group)
        self.counts[frequent] = types.counts[of[frequent] - 1]
        if replies:
            found = [unpack(r, *_REPLY) for r in replies]
            word_class[self.others] = np.concatenate([x[0] for x in found])
            self.counts[self.others] = np.concatenate([x[1] for x in found])
        #: By token number, so the end comes first.
        self.classes = np.concatenate([[END_CLASS], word_class])


def _each(batches: Iterator[pa.RecordBatch], types: Broadcast, buckets: int, model: BrownModel) -> Iterator[tuple[int, _Known]]:
    """The chunks of ``_beside`` in a task."""
    held: tuple[int, bytes, list[bytes]] | None = None
    for batch in batches:
        for place, bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if bucket >= 0:
                held[2].append(packed.as_py())
                continue
            if held:
                yield held[0], _Known(_Chunk(held[1], model), held[2], *types.value, buckets)
            held = place, packed.as_py(), []
    if held:
        yield held[0], _Known(_Chunk(held[1], model), held[2], *types.value, buckets)


def _contexts(known: _Known, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of codes of each of the other words, codes, how often): a word follows class c (code c), precedes it
    (n + c), follows itself (2 n)."""
    chunk, width = known.chunk, 2 * n + 1
    at = np.full(len(chunk.keys) + 1, -1)
    at[known.others + 1] = np.arange(len(known.others))
    of, before, after = known.classes, chunk.tokens[:-1][chunk.learnt], chunk.tokens[1:][chunk.learnt]
    follows, precedes = np.flatnonzero(at[after] >= 0), np.flatnonzero(at[before] >= 0)
    twice = follows[before[follows] == after[follows]]
    seen = [at[after[follows]] * width + of[before[follows]], at[before[precedes]] * width + n + of[after[precedes]], at[after[twice]] * width + 2 * n]
    cells, times = np.unique(np.concatenate(seen), return_counts=True)
    return np.bincount(cells // width, minlength=len(known.others)), cells % width, times


def contexts(chunks: DataFrame, replies: DataFrame | None, types: Broadcast, buckets: int, model: BrownModel, table_only: bool = False) -> DataFrame:
    """(bucket, chunk, packed, codes, ns). Bucket -1 has the chunk's class bigrams: how often (ns) class b follows class a
    (code a n + b). The others get the contexts of their words in the chunk, and of those only held-out texts have."""
    n = model.classes + 1
    names = {"bucket": pa.int32(), "chunk": pa.int64(), "packed": pa.binary(), "codes": pa.list_(pa.int32()), "ns": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, known in _each(batches, types, buckets, model):
            chunk = known.chunk
            of = known.classes[chunk.tokens]
            table = np.bincount((of[:-1] * n + of[1:])[chunk.learnt], minlength=n * n)
            cells = np.flatnonzero(table)
            rows = [(-1, place, None, cells, table[cells])]
            if not table_only:
                sizes, codes, times = _contexts(known, n)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                columns = chunk.keys[known.others], known.classes[known.others + 1].astype("u1"), sizes.astype("<u2")
                codes, times = codes.astype("<u2"), times.astype("<u4")
                for k, (a, b) in enumerate(zip(known.starts, known.starts[1:], strict=False)):
                    if a < b:
                        part = slice(ends[a], ends[b])
                        rows.append((k, place, pack(*[c[a:b] for c in columns], codes[part], times[part]), None, None))
            yield _rows(names, rows)

    return _beside(chunks, replies).mapInArrow(run, "bucket int, chunk bigint, packed binary, codes array<int>, ns array<bigint>")


def class_table(found: DataFrame, n: int) -> np.ndarray:
    pairs = found.where("bucket < 0").select(F.explode(F.arrays_zip("codes", "ns")).alias("x"))
    out = np.zeros(n * n)
    for r in pairs.groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.ns").alias("n")).collect():  # n * n at most
        out[r["code"]] = r["n"]
    return out.reshape(n, n)


def moved(found: DataFrame, table: Broadcast, turn: int, buckets: int, model: BrownModel) -> DataFrame:
    """(chunk, bucket, packed, class_n, class_v): for each chunk the classes and counts of the words it asked for; and, as
    chunk -1, the tokens and words that a bucket has of each class. Turn 0 moves all words, others every second one."""
    n = model.classes + 1
    names = {"chunk": pa.int64(), "bucket": pa.int32(), "packed": pa.binary(), "class_n": pa.list_(pa.int64()), "class_v": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 * n + 1
        keys, now, sums = np.zeros(0, "<u8"), np.zeros(0, "u1"), np.zeros((0, width))
        asked: list[tuple[int, np.ndarray]] = []
        held: list[list[np.ndarray]] = []
        size, bucket = 0, TaskContext.get().partitionId()

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """What is held, added to what was there before; the same words have the same class everywhere."""
            every, first, at = np.unique(np.concatenate([keys, *[h[0] for h in held]]), return_index=True, return_inverse=True)
            cells = [np.repeat(at[len(keys) :], np.concatenate([h[2] for h in held])) * width + np.concatenate([h[3] for h in held])] if held else []
            out = np.bincount(cells[0], weights=np.concatenate([h[4] for h in held]), minlength=len(every) * width).reshape(-1, width) if held else np.zeros((len(every), width))
            out[at[: len(keys)]] += sums
            return every, np.concatenate([now, *[h[1] for h in held]])[first], out

        for batch in batches:
            for place, packed in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                held.append(unpack(packed.as_py(), *_CONTEXTS))
                asked.append((place, held[-1][0]))
                size += len(held[-1][3]) + len(held[-1][0])
                if size > _HELD:
                    keys, now, sums = merged()
                    held, size = [], 0
        if not asked:
            return
        keys, now, sums = merged()
        now = now.astype(np.int64)
        counts = sums[:, :n].sum(1).astype(np.int64)
        may = (counts >= model.min_count) & ((turn == 0) | ((keys >> np.uint64(32)) % np.uint64(2) == turn % 2))
        for k in range(0, len(keys), 2048):
            some = k + np.flatnonzero(may[k : k + 2048])
            if len(some):
                now[some] = best_classes(now[some], sums[some, :n], sums[some, n : 2 * n], sums[some, 2 * n], table.value)
        for place, mine in asked:
            at = np.searchsorted(keys, mine)
            yield _rows(names, [(place, bucket, pack(now[at].astype("u1"), counts[at].astype("<u8")), None, None)])
        known = counts > 0
        yield _rows(names, [(-1, bucket, None, np.bincount(now, weights=counts, minlength=n).astype(np.int64), np.bincount(now[known], minlength=n))])

    return dealt(found.where("bucket >= 0"), buckets).mapInArrow(run, "chunk bigint, bucket int, packed binary, class_n array<bigint>, class_v array<bigint>")


def class_totals(replies: DataFrame, n: int) -> np.ndarray:
    """Tokens and distinct words of each class, of all words that are not frequent."""
    each = replies.where("chunk < 0").select(F.posexplode(F.arrays_zip("class_n", "class_v")).alias("class", "x"))
    out = np.zeros((2, n))
    for r in each.groupBy("class").agg(F.sum("x.class_n").alias("n"), F.sum("x.class_v").alias("v")).collect():  # one row per class
        out[:, r["class"]] = r["n"], r["v"]
    return out


def cluster_words(chunks: DataFrame, types: Broadcast, table: np.ndarray, buckets: int, scratch: Scratch, model: BrownModel) -> tuple[DataFrame, np.ndarray]:
    """(replies, class bigram counts) of the best assignment met. ``table`` is that of the first."""
    spark, n = chunks.sparkSession, model.classes + 1
    replies, scores, best = None, [], None
    for k in range(max(1, model.word_rounds)):
        found = scratch.save(contexts(chunks, replies, types, buckets, model), f"contexts-{k}")
        if k:
            table = class_table(found, n)
        scores.append(likelihood(table))
        if k and (best is None or scores[-1] > best[0]):
            if best:
                scratch.drop(best[3])
            best = scores[-1], replies, table, f"replies-{k - 1}"
        if k > 2 and scores[-1] - scores[-3] < model.least_gain * abs(scores[-1]):
            return best[1], best[2]
        replies = scratch.save(moved(found, spark.sparkContext.broadcast(table), k, buckets, model), f"replies-{k}")
        scratch.drop(f"contexts-{k}")
    last = class_table(scratch.save(contexts(chunks, replies, types, buckets, model, table_only=True), "table"), n)
    return (replies, last) if best is None or likelihood(last) > best[0] else best[1:3]


# -- scores ---------------------------------------------------------------------------------------------------------


def transitions(table: np.ndarray, model: BrownModel) -> np.ndarray:
    """log10 of the probability of a class (column) after a class (row)."""
    plain = (table.sum(0) + 1) / (table.sum() + len(table))
    return np.log10((table + model.prior * plain) / (table.sum(1, keepdims=True) + model.prior))


def text_sums(chunks: DataFrame, replies: DataFrame, types: Broadcast, steps: Broadcast, buckets: int, model: BrownModel) -> DataFrame:
    """doc_id, its number of words, how many of them are known, and the log10 probabilities under the plain frequencies
    and under the classes."""
    names = {"doc_id": pa.int64(), "n": pa.int64(), "known": pa.int64(), "base": pa.float64(), "score": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, weight, ends, all_tokens = steps.value
        for _, known in _each(batches, types, buckets, model):
            chunk, c = known.chunk, known.counts
            emission = np.concatenate([[0.0], np.log10((c + model.alpha) / weight[known.classes[1:]])])
            base = np.log10((np.concatenate([[ends], c]) + 1) / all_tokens)
            seen = np.concatenate([[0], c > 0]).astype(float)
            of, after = known.classes[chunk.tokens], chunk.tokens[1:]
            starts = np.cumsum(np.concatenate([[0], chunk.sizes[:-1] + 1]))
            sums = [np.add.reduceat(x, starts) for x in (seen[after], base[after], emission[after] + table[of[:-1], of[1:]])]
            columns = [chunk.doc_ids, chunk.sizes, sums[0].astype(np.int64), sums[1], sums[2]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, names.values(), strict=True)], names=list(names))

    return _beside(chunks, replies).mapInArrow(run, "doc_id bigint, n bigint, known bigint, base double, score double")


def score(docs: DataFrame, model: BrownModel = BrownModel()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs.

    score is log10 of the text's probability under the classes; base_score that under add-one word frequencies. A text
    without words, null or not, is its end alone. Rows that repeat are learnt from and scored each on its own. A null
    doc_id is in no held-out fold. Without documents there are no rows; with none to learn from, all words are unknown.
    """
    if not 0 < model.classes < 255:
        raise ValueError("there must be 1 to 254 classes")
    spark, scratch, n = docs.sparkSession, Scratch(docs.sparkSession, "brown"), model.classes + 1
    chunks = scratch.save(text_chunks(ids_and_texts(docs), model), "chunks")
    asked = chunks.agg(F.coalesce(F.sum("words"), F.lit(0))).collect()[0][0]  # one number
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-asked // model.bucket_words))
    listed, tokens, vocabulary, ends = frequent_words(chunks, buckets, scratch, model)

    types = _Types(listed, model)
    # Rank by rank into the classes, and so the groups of all other words.
    classes = 1 + np.arange(-1, types.n - 1) % model.classes
    classes[0] = END_CLASS
    classes, table = cluster(type_bigrams(chunks, spark.sparkContext.broadcast(types), model), classes, n, model.rounds, model.least_gain)
    shared = spark.sparkContext.broadcast((types, classes))
    replies, table = cluster_words(chunks, shared, table, buckets, scratch, model)

    of_frequent = classes[1 : types.first_group]
    size = class_totals(replies, n) + np.stack([np.bincount(of_frequent, weights=types.counts, minlength=n), np.bincount(of_frequent, minlength=n)])
    weight = size[0] + model.alpha * (size[1] + 1)
    steps = spark.sparkContext.broadcast((transitions(table, model), weight, ends, float(tokens + vocabulary + 1)))
    found = text_sums(chunks, replies, shared, steps, buckets, model)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(model.folds))
    return found.select(
        "doc_id",
        F.coalesce(fold == model.held_fold, F.lit(False)).alias("held_out"),
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + int(ends > 0)).cast("bigint").alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
