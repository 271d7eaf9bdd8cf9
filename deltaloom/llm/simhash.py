"""Near-duplicate documents by SimHash, joined in the space of per-segment bit counts.

A fingerprint is cut into 32 segments of two bits and mapped to its bit counts, a point of {0, 1, 2}^32. The Manhattan
distance of two points is at most the Hamming distance of the fingerprints, so a range join of the points loses no
link. The join is on grids of unit cells: the 32 coordinates are dealt to ``blocks`` groups, and points at a distance of
at most d agree in all coordinates of at least ``blocks - d`` groups. Each point is filed in the cell of every choice of
that many groups; pairs that share a cell are checked by Manhattan distance and then exactly.

Dense groups are not paired up. In every cell each fingerprint is first held against two hubs, the smallest and the
largest of the cell, which makes links in linear number; only cells that still hold several components are joined, and
only across components. What remains is exact: each link is either tested or joins fingerprints that are connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaloom.llm.components import connected_components
from deltaloom.llm.spread import join_each
from deltaloom.llm.text import folded_words, ids_and_texts, signed
from deltaloom.sources.scratch import Scratch

SHINGLE_WORDS = 4
SEED = 42
MAX_DISTANCE = 4
#: Copies of points in a partition of their table.
PARTITION_COPIES = 4_000_000
#: Members of a cell that meet each other in one task; larger cells are cut into so many parts.
CELL_PART = 1000
_LOW_BITS = 0x5555555555555555


def shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 of every shingle, repeats included; the whole sequence if it is shorter; nothing for no words."""
    found = folded_words(text)
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[:-1]]
    k = min(SHINGLE_WORDS, len(found)) - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[k:], strict=False)), dtype=np.uint64, count=len(found) - k)


def fingerprint(text: str | None) -> int:
    """Bit by bit: 1 if set in over half of the shingle hashes. 0 for a text without words."""
    hashes = shingle_hashes(text)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


@F.pandas_udf(T.LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(signed(np.array([fingerprint(t) for t in batch], dtype=np.uint64)))


def embedding(fp: Column) -> Column:
    """The bit counts of the 32 segments, each as a run of that many ones: equal bits stand for equal counts, and the
    number of differing bits of two embeddings is their Manhattan distance."""
    low = F.lit(_LOW_BITS)
    next_bit = F.shiftrightunsigned(fp, 1)
    two = fp.bitwiseAND(next_bit).bitwiseAND(low)
    one = F.shiftleft(fp.bitwiseOR(next_bit).bitwiseAND(low), 1)
    return two.bitwiseOR(one)


def _block_masks(blocks: int) -> list[int]:
    """The embedding's bits of each group of coordinates."""
    edges = [round(k * 32 / blocks) for k in range(blocks + 1)]
    return [((1 << 2 * b) - 1) ^ ((1 << 2 * a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _long(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _cells(points: DataFrame, max_distance: int, blocks: int) -> DataFrame:
    """(grid, cell, fp, point): each point once per grid."""
    masks = _block_masks(blocks)
    grids = [_long(sum(masks[b] for b in chosen)) for chosen in combinations(range(blocks), blocks - max_distance)]
    keys = F.array(*[F.col("point").bitwiseAND(F.lit(mask)) for mask in grids])
    return points.select("fp", "point", F.posexplode(keys).alias("grid", "cell"))


def _first_shared_grid(max_distance: int, blocks: int) -> Column:
    """Whether the grid of a pair is the first that it shares, so that the pair is found once."""
    masks = _block_masks(blocks)
    differ = F.col("a.point").bitwiseXOR(F.col("b.point"))
    agree = None
    for k, mask in enumerate(masks):
        bit = F.when(differ.bitwiseAND(F.lit(_long(mask))) == 0, 1 << k).otherwise(0)
        agree = bit if agree is None else agree + bit
    upto = F.array(*[F.lit((1 << (max(chosen) + 1)) - 1) for chosen in combinations(range(blocks), blocks - max_distance)])
    return F.bit_count(agree.bitwiseAND(F.element_at(upto, F.col("a.grid") + 1))) == blocks - max_distance


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def blocks_for(n: int, max_distance: int) -> int:
    """How many groups of coordinates suit n distinct fingerprints: the least work, where a copy of a point costs as much
    as some twenty comparisons. Two random points agree in a coordinate with probability 3/8."""

    def work(blocks: int) -> float:
        others = n * (3 / 8) ** (32 * (blocks - max_distance) / blocks)
        return math.comb(blocks, max_distance) * (20 + others)

    return min(range(max_distance + 4, 3 * max_distance + 5), key=work)


def link_fingerprints(fps: DataFrame, scratch: Scratch, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(node, root) of the distinct fingerprints ``fp`` that have a link to another.

    The number of groups of coordinates, and so of the C(blocks, max_distance) copies of each point, follows the number
    of fingerprints. Copies move once: cells are formed, and met again, in the partitions they are dealt to.
    """
    n = fps.count()
    blocks = blocks_for(n, max_distance)
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * math.comb(blocks, max_distance) // PARTITION_COPIES)
    points = fps.repartition(parts, "fp").select("fp", embedding(F.col("fp")).alias("point"))
    cells = _cells(points, max_distance, blocks).select("grid", "cell", "fp").repartition(parts, "grid", "cell")
    met = cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("members"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("members > 1")
    shared = scratch.save(cells.join(met, ["grid", "cell"]).withColumn("point", embedding(F.col("fp"))), "cells")

    hubs = [F.struct(F.col("fp").alias("u"), F.col(hub).alias("v")) for hub in ("low", "high")]
    near = F.filter(F.array(*hubs), lambda x: (x["u"] != x["v"]) & (distance(x["u"], x["v"]) <= max_distance))
    hub_links = shared.select(F.explode(near).alias("x")).select("x.u", "x.v")
    first = scratch.save(connected_components(hub_links, scratch, "hubs"), "first")

    # A cell of two is settled by its hubs.
    larger = shared.where("members > 2").drop("low", "high")
    labelled = larger.join(first, F.col("fp") == F.col("node"), "left")
    labelled = scratch.save(labelled.select("grid", "cell", "members", "fp", "point", F.coalesce("root", "fp").alias("label")), "labelled")
    mixed = labelled.groupBy("grid", "cell").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("grid", "cell")
    open_cells = scratch.save(labelled.join(mixed, ["grid", "cell"]), "open")
    # Large cells are cut into parts; each member is in one, and meets those of every part.
    cut = F.ceil(F.col("members") / CELL_PART).cast("int")
    part = F.pmod(F.xxhash64("fp"), cut).cast("int")
    every = F.explode(F.sequence(F.lit(0), cut - 1))
    left, right = open_cells.withColumn("part", part).withColumn("other", every), open_cells.withColumn("other", part).withColumn("part", every)
    pairs = left.alias("a").join(
        right.alias("b"),
        (F.col("a.grid") == F.col("b.grid"))
        & (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.part") == F.col("b.part"))
        & (F.col("a.other") == F.col("b.other"))
        & (F.col("a.label") < F.col("b.label"))
        & (distance(F.col("a.point"), F.col("b.point")) <= max_distance)
        & (distance(F.col("a.fp"), F.col("b.fp")) <= max_distance)
        & _first_shared_grid(max_distance, blocks),
    )
    across = pairs.select(F.col("a.label").alias("u"), F.col("b.label").alias("v"))
    second = scratch.save(connected_components(across, scratch, "across"), "second")

    roots = first.select("node", "root").unionAll(second.select("node", F.col("node").alias("root"))).distinct()
    over = second.select(F.col("node").alias("over"), F.col("root").alias("top"))
    linked = roots.join(over, F.col("root") == F.col("over"), "left").select("node", F.coalesce("top", "root").alias("root"))
    out = scratch.save(linked.groupBy("node").agg(F.min("root").alias("root")), "linked")
    for name in ("cells", "labelled", "open"):
        scratch.drop(name)
    return out


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    component_id is the smallest doc_id that links reach. A null or empty text, or one of white space, has fingerprint
    zero and is linked like any other. A repeated row is its own row with the same result. A row without doc_id counts
    as a copy but names no component: its own component_id is the smallest id there is in its component, else null.
    No rows give no rows. A fingerprint or component that holds a large share of all rows is spread over all tasks.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(ids_and_texts(docs).select("doc_id", fingerprints("text").alias("fp")), "prints")
    classes = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    linked = link_fingerprints(classes.select("fp"), scratch, max_distance)
    members = scratch.save(classes.join(linked, F.col("fp") == F.col("node")).select("fp", "n", "least", "root"), "members")
    tops = members.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    rooted = join_each(members.select("root", "fp", F.col("n").alias("rows")), tops, "root", members.count())
    alone = classes.join(linked, F.col("fp") == F.col("node"), "left_anti")
    components = rooted.select("fp", "component_id", F.col("rows").alias("n")).unionByName(alone.select("fp", F.col("least").alias("component_id"), "n"))
    return join_each(prints, scratch.save(components, "components"), "fp", prints.count()).select("doc_id", "fp", "component_id")


def fingerprint_results(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

