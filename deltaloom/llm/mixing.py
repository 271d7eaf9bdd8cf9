"""Mixes sources to target weights.

Every document has a pseudo-random place in [0, 1) within its source. A source that is to give e whole rounds and a
part takes every document e times and, once more, those whose place is below a cut; the cut is found by refining sums
over cells of places, so no source is ever gathered or sorted in one task. The places of all rounds form one line, cut
into blocks of nearly equal words. A tree over the output shards halves the exact block quotas of all sources by
multivariate hypergeometric draws until each shard has its quota of each source, as a uniform shuffle of all blocks
would deal them. A shard draws its blocks, disjoint from all others and permuted within their source, and shuffles its
documents locally.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.llm.text import by_place, named, place_of
from deltaloom.sources.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
CELL_BITS = 10
LEVELS = 3
#: Subtrees that the driver splits off before executors go on.
SUBTREES = 64
#: Blocks grow with the corpus so that there are about so many at most: hypergeometric draws take less than 10^9 of them,
#: and their list is short enough to be sent to all executors.
MOST_BLOCKS = 1 << 20
#: Plans, a row of some 100 bytes for each source, are broadcast up to this number of sources.
BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class Mix:
    """How to mix: weights in turn over the sources in order, words as a share of the input, most rounds of a source.
    Blocks have ``block_words``, or more where that would make over MOST_BLOCKS; a shard has ``shard_words``, and one
    block at least."""

    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    most_rounds: float = 2.0
    block_words: int = 20_000
    shard_words: int = 1_000_000
    seed: int = 20240


def water_fill(sizes: list[int], weights: list[float], total: float, most_rounds: float) -> list[float]:
    """Targets in proportion to the weights; none above most_rounds times its size, what is above shared anew."""
    targets = [0.0] * len(sizes)
    free, left = set(range(len(sizes))), total
    while free:
        weight = sum(weights[k] for k in sorted(free))
        over = [k for k in sorted(free) if left * weights[k] / weight > most_rounds * sizes[k]]
        if not over:
            for k in free:
                targets[k] = left * weights[k] / weight
            break
        for k in over:
            targets[k] = float(most_rounds * sizes[k])
            free.discard(k)
        left -= sum(targets[k] for k in over)
    return targets


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def place(doc_id: Column, text: Column, seed: int) -> Column:
    """In [0, 1), the same in every run; rows with equal id and text share it."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 11).cast("double") / float(1 << 53)


def source_totals(sized: DataFrame) -> list[tuple[str | None, int]]:
    """One entry per source, by code point, null last. Sources are the names the weights are given for; their list, and
    nothing of their documents, comes to the driver."""
    found = [(row["source"], row["size"]) for row in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    return sorted(found, key=lambda x: (x[0] is None, x[0] or ""))


@dataclass(frozen=True)
class SourcePlan:
    """What is taken of one source: target words, whole rounds, the cut of the last round, and its blocks."""

    source: str | None
    source_id: int
    size: int
    target: float
    rounds: int
    cut: float
    blocks: int


def _sent(rows: DataFrame, n: int) -> DataFrame:
    """A frame of n rows from the driver, which Spark knows no size of, to be broadcast if that is few."""
    return F.broadcast(rows) if n <= BROADCAST_SOURCES else rows


def _cuts(sized: DataFrame, wanted: list[tuple[str | None, float]]) -> dict[str | None, float]:
    """Per source the cut of places below which the words come nearest to what is wanted, to 2^-(CELL_BITS*LEVELS)."""
    spark = sized.sparkSession
    cells, state = 1 << CELL_BITS, {source: (0, 0.0) for source, _ in wanted}  # first cell so far, words before it
    for level in range(1, LEVELS + 1):
        scale = cells**level
        rows = [(source, need, state[source][0], state[source][1]) for source, need in wanted]
        goal = _sent(spark.createDataFrame(rows, "goal_source string, need double, parent bigint, before double"), len(rows))
        cell = F.floor(F.col("place") * float(scale))
        inside = sized.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).withColumn("cell", cell)
        inside = inside.where(F.floor(F.col("cell") / float(cells)) == F.col("parent"))
        sums = inside.groupBy("goal_source", "need", "before", "cell").agg(F.sum("size").cast("double").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("goal_source").orderBy("cell")) + F.col("before")
        ranked = sums.withColumn("upto", upto)
        # The cell in which the wanted number of words is reached, or the last there is.
        reached = ranked.groupBy("goal_source").agg(
            F.min(F.when(F.col("upto") >= F.col("need"), F.struct("cell", "upto", "words"))).alias("hit"),
            F.max(F.struct("cell", "upto", "words")).alias("last"),
        )
        for row in reached.collect():  # one row per source
            hit = row["hit"] or row["last"]
            need = dict(wanted)[row["goal_source"]]
            start = hit["upto"] - hit["words"]
            if level < LEVELS:
                state[row["goal_source"]] = (hit["cell"], start)
            else:
                past = abs(hit["upto"] - need) < abs(start - need)
                state[row["goal_source"]] = (hit["cell"] + past, start)
        # Cells without documents keep the parent's first cell.
        if level < LEVELS:
            seen = {row["goal_source"] for row in reached.select("goal_source").collect()}
            state = {s: v if s in seen else (v[0] * cells, v[1]) for s, v in state.items()}
    return {source: cell / float(cells**LEVELS) for source, (cell, _) in state.items()}


def block_words(total: float, mix: Mix) -> int:
    return max(mix.block_words, math.ceil(total / MOST_BLOCKS))


def shard_count(plans: list[SourcePlan], mix: Mix) -> int:
    blocks, total = sum(p.blocks for p in plans), sum(p.target for p in plans)
    return max(1, min(blocks, round(total / mix.shard_words)))


def plan_sources(sized: DataFrame, mix: Mix) -> list[SourcePlan]:
    totals = source_totals(sized)
    weights = [float(mix.weights[k % len(mix.weights)]) for k in range(len(totals))]
    targets = water_fill([n for _, n in totals], weights, mix.share * sum(n for _, n in totals), mix.most_rounds)
    rounds = [int(t // n) if n else 0 for (_, n), t in zip(totals, targets, strict=True)]
    parts = [(s, t - r * n) for (s, n), t, r in zip(totals, targets, rounds, strict=True) if n and t - r * n > 0]
    cuts = _cuts(sized, parts) if parts else {}
    plans, words = [], block_words(sum(targets), mix)
    for k, ((source, size), target, whole) in enumerate(zip(totals, targets, rounds, strict=True)):
        blocks = max(1, math.ceil(target / words)) if target > 0 else 0
        plans.append(SourcePlan(source, k, size, target, whole, cuts.get(source, 0.0), blocks))
    return plans


# -- the splitting tree ---------------------------------------------------------------------------------------------


def split(quotas: np.ndarray, first: int, last: int, blocks: int, shards: int, seed: int) -> tuple[np.ndarray, int]:
    """The left half's quotas of a node over shards first..last-1, and where the right half begins."""
    middle = (first + last) // 2
    left = blocks * middle // shards - blocks * first // shards
    draw = np.random.default_rng([seed, first, last])
    return draw.multivariate_hypergeometric(quotas, left, method="marginals"), middle


def leaves(quotas: np.ndarray, starts: np.ndarray, first: int, last: int, blocks: int, shards: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first block and number of blocks by source) below a node; a shard's blocks follow its left neighbour's."""
    todo = [(quotas, starts, first, last)]
    while todo:
        quotas, starts, first, last = todo.pop()
        if last - first == 1:
            yield first, starts, quotas
            continue
        left, middle = split(quotas, first, last, blocks, shards, seed)
        todo.append((quotas - left, starts + left, middle, last))
        todo.append((left, starts, first, middle))


def assign_blocks(df: DataFrame, plans: list[SourcePlan], mix: Mix) -> DataFrame:
    """(source_id, block, shard) for every block. The driver splits the top of the tree, executors the rest; a shard's
    quota of a source is the next so many of that source's blocks in a uniformly permuted order."""
    spark = df.sparkSession
    quotas = np.array([p.blocks for p in plans], dtype=np.int64)
    blocks = int(quotas.sum())
    shards = shard_count(plans, mix)
    top = [(quotas, np.zeros_like(quotas), 0, shards)] if blocks else []
    while top and len(top) < SUBTREES and any(b - a > 1 for _, _, a, b in top):
        grown = []
        for q, s, a, b in top:
            if b - a == 1:
                grown.append((q, s, a, b))
                continue
            left, middle = split(q, a, b, blocks, shards, mix.seed)
            grown += [(left, s, a, middle), (q - left, s + left, middle, b)]
        top = grown
    nodes = spark.createDataFrame([(q.tolist(), s.tolist(), a, b) for q, s, a, b in top], "quotas array<bigint>, starts array<bigint>, first int, last int")

    sizes = quotas.tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        permuted: dict[int, np.ndarray] = {}  # as long as there are blocks, MOST_BLOCKS or so
        for batch in batches:
            for q, s, a, b in batch.itertuples(index=False):
                for shard, starts, counts in leaves(np.array(q, dtype=np.int64), np.array(s, dtype=np.int64), a, b, blocks, shards, mix.seed):
                    for k in np.flatnonzero(counts).tolist():
                        if k not in permuted:
                            permuted[k] = np.random.default_rng([mix.seed, 7, k]).permutation(sizes[k])
                        yield pd.DataFrame({"source_id": k, "block": permuted[k][starts[k] : starts[k] + counts[k]], "shard": shard})

    return nodes.mapInPandas(run, "source_id bigint, block bigint, shard int")


# -- the mix --------------------------------------------------------------------------------------------------------


def _with_plan(rows: DataFrame, plans: list[SourcePlan]) -> DataFrame:
    """Adds the source's plan."""
    listed = [(p.source, p.source_id, p.size, p.target, p.rounds, p.cut, p.blocks) for p in plans]
    schema = "plan_source string, source_id bigint, source_size bigint, target double, rounds int, cut double, blocks bigint"
    plan = _sent(rows.sparkSession.createDataFrame(listed, schema), len(listed))
    return rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")


def _draws(planned: DataFrame) -> DataFrame:
    """One row per copy, with its round and its block."""
    copies = F.col("rounds") + (F.col("place") < F.col("cut")).cast("int")
    line = F.col("rounds") + F.col("cut")
    drawn = planned.where(copies > 0).withColumn("round", F.explode(F.sequence(F.lit(0), copies - 1)))
    return drawn.withColumn("block", F.least(F.floor((F.col("round") + F.col("place")) / line * F.col("blocks")), F.col("blocks") - 1))


class Mixture:
    """A mix of docs(doc_id, text, source).

    Null texts have size 0, a null source is a source of its own, and rows that repeat are rows of their own that share
    a place. Documents are taken whole; a source's words differ from its target by half its largest document at most,
    or by the words of one cell of places. An empty table gives empty results.
    """

    def __init__(self, docs: DataFrame, mix: Mix = Mix()) -> None:
        self.docs, self.mix = docs, mix
        self.scratch = Scratch(docs.sparkSession, "mix")
        plain = named(docs, "doc_id", "text", "source")
        text = F.col("text").cast("string")
        measured = plain.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.col("source").cast("string").alias("source"),
            word_count(text).alias("size"),
            place(F.col("doc_id"), text, mix.seed).alias("place"),
        )
        self.sized = self.scratch.save(measured, "sized")
        self.plans = plan_sources(self.sized, mix)
        self.blocks = self.scratch.save(assign_blocks(docs, self.plans, mix), "blocks")

    def _in_shards(self, drawn: DataFrame) -> DataFrame:
        """Adds the shard of each block. There are MOST_BLOCKS and one for each source at most."""
        few = len(self.plans) <= BROADCAST_SOURCES
        return drawn.join(F.broadcast(self.blocks) if few else self.blocks, ["source_id", "block"])

    def draws(self) -> DataFrame:
        """row, doc_id, size, round, block and shard of every copy in the mix."""
        drawn = _draws(_with_plan(self.sized, self.plans))
        return self._in_shards(drawn).select("row", "doc_id", "size", "round", "source_id", "block", "shard")

    def taken(self) -> DataFrame:
        """Per document what the mix takes of it, from the draws."""
        sums = self.draws().groupBy("row").agg(F.sum("size").alias("words"))
        planned = _with_plan(self.sized, self.plans)
        return planned.join(sums, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("bigint").alias("taken"))

    def documents(self) -> DataFrame:
        """The documents of the mix in docs' columns, repeats included: a shard's rows together, in random order.

        Documents move once, to the partition of their shard; neighbouring shards share one where there are many.
        """
        names = self.docs.columns
        at = {name: F.col(f"c{place_of(self.docs, name)}") for name in ("doc_id", "text", "source")}
        placed = by_place(self.docs).withColumns({"source": at["source"].cast("string"), "place": place(at["doc_id"], at["text"].cast("string"), self.mix.seed)})
        drawn = self._in_shards(_draws(_with_plan(placed, self.plans)))
        order = F.xxhash64(F.lit(self.mix.seed + 1), at["doc_id"], F.col("round"), F.col("block"))
        shards = shard_count(self.plans, self.mix)
        parts = min(shards, int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        part = F.floor(F.col("shard") * F.lit(parts).cast("bigint") / shards).cast("int")
        dealt = drawn.withColumn("order", order).repartitionById(parts, part).sortWithinPartitions("shard", "order")
        return dealt.select(*[f"c{k}" for k in range(len(names))]).toDF(*names)
