"""Finds benchmark items in training texts: BM25 over an inverted index of the items, block-max pruning, verification.

The roles are turned round: the items are the indexed texts, and every passage of every document is a query. A score is
an item's BM25 score over the distinct words of the passage, as a share of the item's score over all its own words, so
one threshold fits items of any length. Postings are cut into blocks of neighbouring items that keep the greatest impact
of each word; a passage whose sum of block maxima stays below the threshold skips the block. In blocks that remain,
WAND orders the lists by item, skips to the first item whose words' maxima could reach the threshold, and scores it.
The commonest words are set apart while all of them together reach the threshold for no item: a passage of those alone
is skipped at once. Every item above the threshold is retrieved, and then verified word by word.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.text import by_place, ids_and_texts, named, place_of

_WORD = re.compile(r"\w+")
_SENTENCE_END = re.compile(r"[.?!]+\s+")
#: Sums of block maxima that are held at a time, and postings that go into them, or those of one passage.
_CELLS = 1 << 21


@dataclass(frozen=True)
class Search:
    """k1 and b are BM25's. threshold: share of an item's own score at which it is retrieved. overlap: share of the
    five-word shingles of both question and answer, or of the whole item, that the passage must hold. index_bytes: item text per index; more
    items are searched as several indexes, each over all documents."""

    k1: float = 1.2
    b: float = 0.75
    threshold: float = 0.6
    overlap: float = 0.8
    shingle: int = 5
    block_items: int = 4
    index_bytes: int = 32_000_000


def terms(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The answer is the last sentence if a question of some length precedes it, else the last third of the words."""
    cuts = [m.end() for m in _SENTENCE_END.finditer(text.strip())]
    if cuts:
        question, answer = terms(text.strip()[: cuts[-1]]), terms(text.strip()[cuts[-1] :])
        if len(question) >= 5 and len(answer) >= 2:
            return question, answer
    found = terms(text)
    cut = len(found) - len(found) // 3
    return found[:cut], found[cut:]


def shingles(found: list[str], size: int) -> set[tuple[str, ...]]:
    size = min(size, len(found))
    return {tuple(found[k : k + size]) for k in range(len(found) - size + 1)} if size else set()


def containment(part: list[str], passage: list[str], size: int) -> float:
    """Share of the part's shingles that the passage has; 1 for an empty part."""
    wanted = shingles(part, size)
    if not wanted:
        return 1.0
    size = min(size, len(part))
    there = {tuple(passage[k : k + size]) for k in range(len(passage) - size + 1)}
    return len(wanted & there) / len(wanted)


class _RawWords(dict):
    """Ids of the terms of a blank-separated word: one id, -1 for one unknown term, or -2 - k for the k-th odd case."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.vocabulary, self.odd = vocabulary, []

    def __missing__(self, raw: str) -> int:
        found = [self.vocabulary.get(w, -1) for w in _WORD.findall(raw)]
        if len(found) != 1:
            self.odd.append(found)
        self[raw] = out = found[0] if len(found) == 1 else -1 - len(self.odd)
        return out


class Index:
    """An inverted index with block maxima over items (id, text), given the document frequencies of all items."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[str, int], n_items: int, mean_length: float, search: Search) -> None:
        self.search = search
        self.items: list[int] = []
        self.parts: list[tuple[list[str], list[str]]] = []
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        longest = 1
        for item_id, text in items:
            found = terms(text)
            if not found:
                continue
            longest = max(longest, len(found))
            norm = search.k1 * (1 - search.b + search.b * len(found) / mean_length)
            weights = {}
            for term, tf in Counter(found).items():
                df = frequency[term]
                weights[term] = math.log(1 + (n_items - df + 0.5) / (df + 0.5)) * tf * (search.k1 + 1) / (tf + norm)
            total = sum(weights.values())
            k = len(self.items)
            self.items.append(item_id)
            self.parts.append(question_and_answer(text))
            for term, weight in weights.items():
                postings[term].append((k, weight / total))
        self.stride = longest
        self.window = 2 * longest
        self.vocabulary = {term: k for k, term in enumerate(postings)}
        self.n_terms = len(postings)
        self.n_blocks = -(-len(self.items) // search.block_items)
        self._add_blocks(list(postings.values()))
        self._set_common_apart(list(postings.values()))
        self.raw = _RawWords(self.vocabulary)

    def _add_blocks(self, lists: list[list[tuple[int, float]]]) -> None:
        """Per word, one after another, its blocks and their greatest impacts; per block its words' postings."""
        starts, blocks, maxima = [0], [], []
        self.by_block: list[dict[int, list[tuple[int, float]]]] = [defaultdict(list) for _ in range(self.n_blocks)]
        for word, listed in enumerate(lists):
            mine = defaultdict(list)
            for item, impact in listed:
                mine[item // self.search.block_items].append((item, impact))
            for block, part in mine.items():
                self.by_block[block][word] = part
                blocks.append(block)
                maxima.append(max(impact for _, impact in part))
            starts.append(len(blocks))
        self.starts = np.array(starts, dtype=np.int64)
        self.blocks = np.array(blocks, dtype=np.int64)
        self.maxima = np.array(maxima, dtype=np.float64)

    def _set_common_apart(self, lists: list[list[tuple[int, float]]]) -> None:
        """rare: the words of which every item above the threshold must have one."""
        sums = np.zeros(len(self.items))
        self.rare = np.ones(self.n_terms + 1, dtype=bool)
        for word in sorted(range(self.n_terms), key=lambda w: (-len(lists[w]), w)):
            where = [item for item, _ in lists[word]]
            add = np.array([impact for _, impact in lists[word]])
            if (sums[where] + add >= self.search.threshold - 1e-9).any():
                break
            sums[where] += add
            self.rare[word] = False
        self.rare[-1] = False  # where unknown words, id -1, look

    def term_ids(self, text: str | None) -> np.ndarray:
        """The ids of a text's terms in order, -1 for terms of no item."""
        if not text:
            return np.zeros(0, dtype=np.int64)
        raw = text.lower().split()
        ids = np.fromiter(map(self.raw.__getitem__, raw), dtype=np.int64, count=len(raw))
        if len(raw) and ids.min() < -1:
            at = np.flatnonzero(ids < -1)
            pieces, last = [], 0
            for k in at.tolist():
                pieces += [ids[last:k], np.array(self.raw.odd[-2 - ids[k]], dtype=np.int64)]
                last = k + 1
            ids = np.concatenate([*pieces, ids[last:]])
        if len(self.raw) > 400_000:
            self.raw = _RawWords(self.vocabulary)
        return ids

    def _open_blocks(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window, its distinct words, blocks whose maxima reach the threshold) for the windows of a document."""
        with_rare = np.flatnonzero(self.rare[ids])
        if not len(with_rare):
            return
        last = max(0, -(-(len(ids) - self.window) // self.stride))
        # A word is in the window that begins in its stride and in the one before.
        wanted = np.zeros(len(ids) // self.stride + 2, dtype=bool)
        wanted[with_rare // self.stride] = True
        wanted[:-1] |= wanted[1:]
        wanted[last + 1 :] = False
        at = np.flatnonzero(ids >= 0)
        stride, words = at // self.stride, ids[at]
        here, before = wanted[stride], wanted[stride - 1] & (stride > 0)
        keys = np.concatenate([stride[here] * self.n_terms + words[here], (stride[before] - 1) * self.n_terms + words[before]])
        keys.sort()
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        windows, words = keys // self.n_terms, keys % self.n_terms
        sizes = self.starts[words + 1] - self.starts[words]
        ends = np.cumsum(sizes)
        # Some windows and postings at a time, so memory follows neither the text's length nor the items.
        edges = np.flatnonzero(np.concatenate([[True], windows[1:] != windows[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        lasts, span, k = np.append(edges[1:], len(windows)), max(1, _CELLS // self.n_blocks), 0
        while k < len(edges):
            begin, first = int(edges[k]), int(windows[edges[k]])
            before = int(ends[begin] - sizes[begin])
            full = min(int(np.searchsorted(ends[lasts - 1], before + _CELLS, side="right")), int(np.searchsorted(windows[edges], first + span)))
            k = max(k + 1, full)
            mine = slice(begin, int(lasts[k - 1]))
            n = sizes[mine]
            flat = np.arange(int(n.sum())) + np.repeat(self.starts[words[mine]] - ends[mine] + n + before, n)
            bounds = np.bincount(np.repeat(windows[mine] - first, n) * self.n_blocks + self.blocks[flat], weights=self.maxima[flat])
            cells = np.flatnonzero(bounds >= self.search.threshold - 1e-9)
            for w in np.unique(cells // self.n_blocks):
                yield first + int(w), words[slice(*np.searchsorted(windows, [first + w, first + w + 1]))], cells[cells // self.n_blocks == w] % self.n_blocks

    def _wand(self, words: np.ndarray, block: int) -> Iterator[tuple[int, float]]:
        """(item, score) of every item of the block at or above the threshold."""
        held = self.by_block[block]
        cursors = [[0, max(impact for _, impact in held[w]), held[w]] for w in words.tolist() if w in held]
        while True:
            cursors = sorted((c for c in cursors if c[0] < len(c[2])), key=lambda c: c[2][c[0]][0])
            reach, pivot = 0.0, None
            for c in cursors:
                reach += c[1]
                if reach >= self.search.threshold - 1e-9:
                    pivot = c[2][c[0]][0]
                    break
            if pivot is None:
                return
            if cursors[0][2][cursors[0][0]][0] == pivot:
                score = 0.0
                for c in cursors:
                    if c[2][c[0]][0] == pivot:
                        score += c[2][c[0]][1]
                        c[0] += 1
                if score >= self.search.threshold - 1e-9:
                    yield pivot, score
            else:
                for c in cursors:
                    while c[0] < len(c[2]) and c[2][c[0]][0] < pivot:
                        c[0] += 1

    def candidates(self, text: str | None) -> Iterator[tuple[int, int, float]]:
        """(item, first word of the passage, score) of all passages of a text."""
        ids = self.term_ids(text) if self.items else ()
        if len(ids):
            for window, words, blocks in self._open_blocks(ids):
                for block in blocks:
                    for item, score in self._wand(words, int(block)):
                        yield item, window * self.stride, score

    def leaks(self, text: str | None) -> list[tuple[int, int, float, float, float]]:
        """(item_id, first word of the passage, score, question overlap, answer overlap): per item the best passage."""
        best: dict[int, tuple] = {}
        found = None
        for item, start, score in self.candidates(text):
            found = terms(text) if found is None else found
            passage = found[start : start + self.window]
            question, answer = self.parts[item]
            overlaps = [containment(part, passage, self.search.shingle) for part in (question, answer)]
            whole = min(overlaps) >= self.search.overlap or containment(question + answer, passage, self.search.shingle) >= self.search.overlap
            if whole and (item not in best or score > best[item][2]):
                best[item] = (self.items[item], start, score, *overlaps)
        return [best[k] for k in sorted(best)]


def indexes(items: DataFrame, search: Search) -> Iterator[Index]:
    """One index while the item texts are within ``index_bytes``, else as many as that takes, one at a time.

    Sizes are checked before anything is collected, and the driver holds the texts and the index of one slice; the
    document frequencies it looks up are those of the slice's own words among all items.
    """
    listed = named(items, "item_id", "text").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    listed = listed.where(F.col("text").isNotNull()).withColumn("slice_hash", F.xxhash64("item_id", "text"))
    size = listed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]  # one number
    slices = max(1, -(-size // search.index_bytes))

    def found_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [terms(t) for t in batch["text"]]
            yield pd.DataFrame({"slice": batch["slice"], "length": list(map(len, found)), "words": [sorted(set(x)) for x in found]})

    sliced = listed.select(F.pmod("slice_hash", F.lit(slices)).alias("slice"), "text")
    words = sliced.mapInPandas(found_in, "slice bigint, length bigint, words array<string>").where("length > 0")
    n_items, mean = words.agg(F.count(F.lit(1)), F.coalesce(F.avg("length"), F.lit(1.0))).collect()[0]
    each = words.select("slice", F.explode("words").alias("word"))
    frequency = each.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    for k in range(slices):
        part = [(r["item_id"], r["text"]) for r in listed.where(F.pmod("slice_hash", F.lit(slices)) == k).collect()]  # index_bytes, or the largest item
        part.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        wanted = each.where(F.col("slice") == k).select("word").distinct()
        known = {r["word"]: r["df"] for r in (frequency.join(wanted, "word") if slices > 1 else frequency).collect()}  # the slice's words
        yield Index(part, known, max(1, n_items), max(1.0, mean), search)


def find_leaks(docs: DataFrame, items: DataFrame, search: Search = Search()) -> DataFrame:
    """(doc_id, item_id, passage_start, score, question_overlap, answer_overlap) for every item in every document.

    A single changed word can break all shingles of a short answer, so a passage that holds enough of the whole item's
    shingles holds the item too.
    All passages of whole texts are queried. Null and empty texts hold nothing; null items are none; a repeated document
    or item is found again for each row. Without items or documents there are no rows.
    """
    schema = "doc_id bigint, item_id bigint, passage_start bigint, score double, question_overlap double, answer_overlap double"
    plain, out = ids_and_texts(docs), None
    for index in indexes(items, search):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for batch in batches:
                rows = [(None if pd.isna(d) else int(d), *leak) for d, text in zip(batch["doc_id"], batch["text"], strict=True) for leak in index.leaks(text)]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "passage_start", "score", "question_overlap", "answer_overlap"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        one = plain.mapInPandas(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def _is_clean(shared: Broadcast):
    """A column function: whether a text holds no item of the index."""

    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        for batch in texts:
            yield pd.Series([not index.leaks(t) for t in batch], dtype=bool)

    clean.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(clean, "boolean")


def drop_contaminated(docs: DataFrame, items: DataFrame, search: Search = Search()) -> DataFrame:
    """The rows of docs that hold no benchmark item, in docs' columns. Each row is judged alone, without a shuffle: rows
    that repeat all stay or all go, null and empty texts stay. Without items all stay; without documents there are no rows."""
    at, out = f"c{place_of(docs, 'text')}", by_place(docs)
    for index in indexes(items, search):
        clean = _is_clean(docs.sparkSession.sparkContext.broadcast(index))
        out = out.withColumn("clean", clean(F.col(at).cast("string"))).where("clean").drop("clean")
    return out.toDF(*docs.columns)
