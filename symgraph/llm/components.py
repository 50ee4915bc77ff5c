"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step keeps the components and replaces edges by stars around smaller nodes, so the number of
steps grows with the logarithm of the longest chain. Each step is a shuffle of the edges; its
result is written to the shared folder, and only counts, a checksum (taken while it is written) and the few nodes with the most edges reach the
driver. The edges of such a node stay where they are (``lookup``), so the star of a very large component is no task's alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, stash, unstash


def _least(edges: DataFrame) -> DataFrame:
    """Of each u the least neighbour, and its number of edges."""
    return stash(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")), "star-centres", rows=F.sum("_n"), most=F.max("_n"))


def _sizes(least: DataFrame) -> tuple[int, int]:
    return least.seen["rows"] or 0, least.seen["most"] or 0


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    met = lookup(both.where("v > u"), least.select("u", F.least("m", "u").alias("m")), "u", "inner", least.select("u", "_n"), _sizes(least))
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    met = lookup(down, least.select("u", "m"), "u", "inner", least.select("u", "_n"), _sizes(least))
    moved = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))), least


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``edges(u long, v long)`` -> ``(node long, component long)``: the smallest node reachable, for each node with an edge.

    Self-loops, repeated edges, both directions of an edge and null ends are allowed (null ends
    are dropped); an empty table gives an empty result.
    """
    mark = {"rows": F.count("*"), "sum": F.bit_xor(F.xxhash64("u", "v"))}
    now = stash(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label, **mark)
    while now.seen["rows"]:
        large, centres = _large_star(now)
        large = stash(large.distinct(), label)
        small, others = _small_star(large)
        before, now = now, stash(small.distinct(), label, **mark)
        for old in (before, large, centres, others):
            unstash(old)
        if now.seen == before.seen:
            break
    # what is returned reads the last step's table; ``unstash`` of it deletes that
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    out._scratch = now._scratch
    return out
