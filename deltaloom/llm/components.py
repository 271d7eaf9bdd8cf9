"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.sources.scratch import Scratch


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One round of stars over edges (u, v), u > v.

    larger_only: every node hangs its larger neighbours under the smallest node it knows (itself included). Else every
    node hangs its smaller neighbours, and itself, there. Both only need a minimum per node, which is combined before
    the shuffle, and a join back; no neighbourhood is ever gathered.
    """
    if larger_only:
        known = edges.unionAll(edges.select("v", "u"))
        least = known.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        moved = known.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("low"))
        below = edges.join(least, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        moved = below.unionAll(least.select("u", F.col("low").alias("v")))
    return moved.where("u <> v").distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])  # one row


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the smallest node of its component.

    Alternates large and small stars until the edges no longer change, which takes a number of rounds that grows with
    the logarithm of the longest path. Each round is written, so a lost executor repeats one round at most. No edges,
    no rows. Loops and repeated edges change nothing.
    """
    now = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    before, k = _signature(now), 0
    while before[0]:
        k += 1
        now = scratch.save(_stars(_stars(now, True), False), f"{name}-{k}")
        after = _signature(now)
        scratch.drop(f"{name}-{k - 1}")
        if after == before:
            break
        before = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
