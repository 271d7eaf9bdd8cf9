"""Quality by compression: zstandard ratios of whole documents and of fixed chunks, held against limits by length.

What plain text compresses to depends on the corpus, so the limits are taken from texts that are labelled good; the
limits of ``Bands()`` hold where there are no labels, and are so wide that they only catch noise and repetition.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.text import by_place, ids_and_texts, named, place_of, words
from deltaloom.sources.scratch import Scratch

_SYMBOLS = frozenset("#*$%&|<>")


@dataclass(frozen=True)
class Bands:
    """Limits of compressed size over size.

    ``whole``: (from so many bytes, least ratio, greatest ratio); a text below the first entry is not judged, as the
    frame of the format outweighs it. Short texts compress badly however plain they are, so their limits lie higher.
    ``chunk``: least and greatest ratio of each chunk of ``chunk_bytes``; a text falls if two or more of its chunks, and
    over ``bad_share`` of them, are outside. Chunks catch a repetitive or random stretch that a long text dilutes. All
    have that length, the last reaching back into the one before, so one pair of limits serves; a text shorter than a
    chunk is judged whole alone.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (256, 0.32, 0.95),
        (512, 0.28, 0.88),
        (1024, 0.24, 0.80),
        (2048, 0.22, 0.76),
        (4096, 0.20, 0.72),
        (16384, 0.18, 0.68),
    )
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (0.15, 0.78)
    bad_share: float = 0.25
    level: int = 3
    min_words: int = 50
    max_repeat_percent: int = 50
    starts: tuple[int, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "starts", tuple(start for start, _, _ in self.whole))


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    found = words(text)
    if not found:
        return 0, 0, sum(map(text.count, _SYMBOLS)) if text else 0, 0, 0
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = Counter(line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r"))
    return len(found), len(text) - spaces, symbols, sum(lines.values()) - len(lines), repeat_words(found)


def repeat_words(found: list[bytes]) -> int:
    """Word positions inside a three-word window that the text has twice or more."""
    windows = list(zip(found, found[1:], found[2:], strict=False))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    total, covered = 0, 0  # covered: the first position that no window has counted
    for k, window in enumerate(windows):
        if times[window] > 1:
            total += k + 3 - max(k, covered)
            covered = k + 3
    return total


def ratios(text: str | None, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float, float]:
    """The whole text's ratio, and the share of its chunks outside their limits if that is two or more; 1 and 0 where
    there is nothing."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return 1.0, 0.0
    low, high = bands.chunk
    chunks = [chunk_ratio(data, k, bands, packer) for k in chunk_starts(len(data), bands.chunk_bytes)]
    outside = sum(not low <= c <= high for c in chunks)
    return len(packer.compress(data)) / len(data), outside / len(chunks) if outside > 1 else 0.0


def chunk_starts(n: int, size: int) -> list[int]:
    """Where the chunks of n bytes begin: one after another, and the last so that it ends with the text."""
    starts = list(range(0, n - size + 1, size))
    return starts + [n - size] if starts and n % size else starts


def chunk_ratio(data: bytes, start: int, bands: Bands, packer: zstandard.ZstdCompressor) -> float:
    return len(packer.compress(data[start : start + bands.chunk_bytes])) / bands.chunk_bytes


def verdict(n_bytes: int, ratio: float, bad_chunks: float, bands: Bands) -> bool:
    k = bisect_right(bands.starts, n_bytes) - 1
    if k < 0:
        return True
    _, low, high = bands.whole[k]
    return low <= ratio <= high and bad_chunks <= bands.bad_share


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, bad_chunks double, kept boolean"


def judge(text: str | None, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple:
    n, chars, symbols, lines, repeats = base_counts(text)
    failed = n < bands.min_words or 100 * repeats > bands.max_repeat_percent * n
    ratio, bad = ratios(text, bands, packer)
    n_bytes = len((text or "").encode("utf-8", "surrogatepass"))
    return n, chars, symbols, lines, repeats, failed, ratio, bad, not failed and verdict(n_bytes, ratio, bad, bands)


def judged(bands: Bands):
    """A column function: text to the struct of SCHEMA. Each row on its own, so no shuffle and bounded memory."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in texts:
            yield pd.DataFrame([judge(t, bands, packer) for t in batch], columns=names)

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, SCHEMA)


def quality(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """doc_id and the measures and verdict of each row. A null text has no words and fails. No rows give no rows."""
    return named(docs, "doc_id", "text").select("doc_id", judged(bands)(F.col("text").cast("string")).alias("q")).select("doc_id", "q.*")


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of docs that are kept, in docs' columns, each judged alone: rows that repeat all stay or all go, a null or
    empty text goes, and no rows give no rows."""
    found = by_place(docs).withColumn("judged", judged(bands)(F.col(f"c{place_of(docs, 'text')}").cast("string")))
    return found.where("judged.kept").drop("judged").toDF(*docs.columns)


# -- limits from labelled texts ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Fit:
    """How the limits follow from the labelled texts.

    Every row labelled good that passes the base counts, with all of its chunks. The low limit of a length is the
    ``low`` quantile of the good ratios, as junk of repeated symbols and bars compresses better than prose. Few texts
    that are not noise lie above the good ones, so the high limit is the ``high`` quantile and ``above`` times that.
    Lengths (and chunks) of fewer than ``least`` good ones keep the limits of the bands given.
    """

    low: float = 0.01
    high: float = 0.995
    above: float = 1.05
    least: int = 20
    starts: tuple[int, ...] = (256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096, 6144, 8192, 12288, 16384)


def labels_in(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The labels beside the documents; None where there is no such table."""
    try:
        return spark.read.parquet(f"{sf_dir}/labels.parquet")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _good_ratios(docs: DataFrame, labels: DataFrame, bands: Bands, fit: Fit) -> DataFrame:
    """(kind, ratio, times) of the good rows: by the place of their length in ``fit.starts`` for whole texts, and as one
    more kind for chunks. All rows are measured, so only measures move to meet the labels, never texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            out = []
            for doc_id, text in batch.itertuples(index=False):
                found = words(text)
                if len(found) < bands.min_words or 100 * repeat_words(found) > bands.max_repeat_percent * len(found):
                    continue
                data = text.encode("utf-8", "surrogatepass")
                chunks = [chunk_ratio(data, k, bands, packer) for k in chunk_starts(len(data), bands.chunk_bytes)]
                out.append((doc_id, bisect_right(fit.starts, len(data)) - 1, len(packer.compress(data)) / len(data), chunks))
            yield pd.DataFrame(out, columns=["doc_id", "kind", "ratio", "chunks"])

    good = named(labels, "doc_id", "quality").select(F.col("doc_id").cast("bigint").alias("good_id"), "quality").where("good_id IS NOT NULL").groupBy("good_id").agg(F.min("quality").alias("least"))
    measured = ids_and_texts(docs).where("doc_id IS NOT NULL").mapInPandas(run, "doc_id bigint, kind int, ratio double, chunks array<double>")
    met = measured.join(good.where("least = 1"), F.col("doc_id") == F.col("good_id"), "left_semi")
    whole = F.array(F.struct("kind", "ratio"))
    chunks = F.transform("chunks", lambda c: F.struct(F.lit(len(fit.starts)).alias("kind"), c.alias("ratio")))
    return met.select(F.explode(F.concat(whole, chunks)).alias("r")).groupBy("r.kind", "r.ratio").agg(F.count(F.lit(1)).alias("times"))


#: Width of the bins that counts are first taken of; only the values of bins in which a quantile stands come to the driver.
_BIN = 2.0**-13


def _quantiles(found: DataFrame, least: int, shares: tuple[float, ...]) -> dict[int, list[float]]:
    """Exact quantiles, between the two values next to them, of each kind of ``least`` rows or more of (kind, ratio,
    times)."""
    binned = found.withColumn("bin", F.floor(F.col("ratio") / _BIN))
    bins: dict[int, list[tuple[int, int]]] = {}
    for kind, k, n in binned.groupBy("kind", "bin").agg(F.sum("times")).sort("kind", "bin").collect():
        bins.setdefault(kind, []).append((k, n))
    places, wanted = {}, {}
    for kind, here in bins.items():
        ends = np.cumsum([n for _, n in here])
        if (n := int(ends[-1])) < least:
            continue
        for share in shares:
            at = int((n - 1) * share)
            places[kind, share] = at, min(at + 1, n - 1), (n - 1) * share - at
            for rank in places[kind, share][:2]:
                k = int(np.searchsorted(ends, rank, side="right"))
                wanted[kind, rank] = here[k][0], rank - int(ends[k] - here[k][1])
    values: dict[tuple[int, int], list[tuple[float, int]]] = {}
    chosen = sorted({(kind, k) for (kind, _), (k, _) in wanted.items()})
    if chosen:
        inside = F.struct("kind", "bin").isin(*[F.struct(F.lit(kind).alias("kind"), F.lit(k).cast("bigint").alias("bin")) for kind, k in chosen])
        for kind, k, ratio, n in binned.where(inside).select("kind", "bin", "ratio", "times").sort("kind", "ratio").collect():
            values.setdefault((kind, k), []).append((ratio, n))

    def value(kind: int, rank: int) -> float:
        k, left = wanted[kind, rank]
        here = values[kind, k]
        return here[int(np.searchsorted(np.cumsum([n for _, n in here]), left, side="right"))][0]

    out: dict[int, list[float]] = {}
    for (kind, _), (low, high, part) in places.items():
        a, b = value(kind, low), value(kind, high)
        out.setdefault(kind, []).append(a + (b - a) * part)
    return out


def fitted(docs: DataFrame, labels: DataFrame | None, bands: Bands = Bands(), fit: Fit = Fit()) -> Bands:
    """Bands with limits from the labelled good texts; the bands given where there are no labels."""
    if labels is None:
        return bands
    scratch = Scratch(docs.sparkSession, "ratios")
    found = _quantiles(scratch.save(_good_ratios(docs, labels, bands, fit), "ratios"), fit.least, (fit.low, fit.high))
    scratch.drop()

    def limits(kind: int, given: tuple[float, float]) -> tuple[float, float]:
        if kind not in found:
            return given
        low, high = found[kind]
        return low, high * fit.above

    whole = []
    for k, start in enumerate(fit.starts):
        at = bisect_right(bands.starts, start) - 1
        whole.append((start, *limits(k, bands.whole[at][1:] if at >= 0 else (0.0, 2.0))))
    return replace(bands, whole=tuple(whole), chunk=limits(len(fit.starts), bands.chunk))
