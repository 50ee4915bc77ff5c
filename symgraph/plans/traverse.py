"""Bounded traversal by unrolled joins. ``edges(src, dst)``; the depth bound is known when the plan is built."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def clamp(depth, least: int = 1, most: int = 10, default: int = 3) -> int:
    """A whole depth in range; what is no number, or zero, is the default."""
    try:
        whole = int(depth // 1) if depth == depth else 0
    except (TypeError, ValueError, OverflowError):
        whole = 0
    return min(max(least, whole or default), most)


def trails(edges: DataFrame, seeds: DataFrame, depth: int, backwards: bool = False) -> DataFrame:
    """``(seed, node, depth, edges array, nodes array)``: a row per path of 1 to ``depth`` edges in which no edge repeats.

    ``seeds(seed)``. The frontier is filtered to the seeds first, so work follows the paths that exist.
    """
    start, end = ("dst", "src") if backwards else ("src", "dst")
    hop = edges.select(F.col(start).alias("_a"), F.col(end).alias("_b"), F.struct("src", "dst").alias("_e"))
    now = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).join(hop, F.col("node") == F.col("_a"))
    now = now.select("seed", F.col("_b").alias("node"), F.lit(1).alias("depth"), F.array("_e").alias("edges"), F.array("_a", "_b").alias("nodes"))
    out = [now]
    for k in range(2, depth + 1):
        now = now.join(hop, F.col("node") == F.col("_a")).where(~F.array_contains("edges", F.col("_e")))
        now = now.select("seed", F.col("_b").alias("node"), F.lit(k).alias("depth"), F.concat("edges", F.array("_e")).alias("edges"), F.concat("nodes", F.array("_b")).alias("nodes"))
        out.append(now)
    return _union(out)


def reach(edges: DataFrame, seeds: DataFrame, depth: int, backwards: bool = False) -> DataFrame:
    """``(seed, node, depth)``: nodes within ``depth`` edges with their least depth. Each level is distinct, so its size is bounded by seeds times nodes."""
    start, end = ("dst", "src") if backwards else ("src", "dst")
    hop = edges.select(F.col(start).alias("_a"), F.col(end).alias("_b")).distinct()
    now, out = seeds.select("seed", F.col("seed").alias("node")), []
    for k in range(1, depth + 1):
        now = now.join(hop, F.col("node") == F.col("_a")).select("seed", F.col("_b").alias("node")).distinct()
        out.append(now.withColumn("depth", F.lit(k)))
    return _union(out).groupBy("seed", "node").agg(F.min("depth").alias("depth"))


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, most: int = 12, nearest: bool = False) -> DataFrame:
    """``(source, target, hops, path)``: of each pair of a source and a target that is reachable over 1 to ``most`` edges, the least path.

    ``sources(source)``, ``targets(target)``. Breadth first, a node keeps the first path by node order; of ties the least in node order wins.
    The loop ends early once a level finds nothing new, or, with ``nearest``, once it meets any target: only the least distance is asked for then. Each level is written to the shared folder: a level's plan names
    the one before and all seen, so plans over plans would double with every level.
    """
    hop = edges.select(F.col("src").alias("_a"), F.col("dst").alias("_b"))
    now = sources.distinct().select("source", F.col("source").alias("node"), F.array("source").alias("path"))
    levels = []
    for k in range(1, most + 1):
        step = now.join(hop, F.col("node") == F.col("_a")).groupBy("source", F.col("_b").alias("node")).agg(F.min(F.concat("path", F.array("_b"))).alias("path"))
        if levels:
            step = step.join(_union(levels).select("source", "node"), ["source", "node"], "left_anti")
        now = cut(step, "shortest-paths")
        if now.isEmpty():
            break
        levels.append(now.withColumn("hops", F.lit(k)))
        if nearest and not now.join(targets, F.col("node") == F.col("target"), "left_semi").isEmpty():
            break
    found = _union(levels) if levels else now.withColumn("hops", F.lit(0))
    return found.join(targets, F.col("node") == F.col("target")).select("source", "target", "hops", "path")


def cycles(edges: DataFrame, least: int = 2, most: int = 6, canonical: bool = False) -> DataFrame:
    """``(length, nodes)``: closed trails; every rotation is a row, or with ``canonical`` only the one that begins at its least node."""
    hop = edges.where("src <> dst").select(F.col("src").alias("_a"), F.col("dst").alias("_b"), F.struct("src", "dst").alias("_e")).distinct()
    now, out = hop.select(F.col("_a").alias("first"), F.col("_b").alias("node"), F.array("_e").alias("edges"), F.array("_a", "_b").alias("nodes")), []
    for k in range(2, most + 1):
        now = now.join(hop, F.col("node") == F.col("_a")).where(~F.array_contains("edges", F.col("_e")))
        now = now.select("first", F.col("_b").alias("node"), F.concat("edges", F.array("_e")).alias("edges"), F.concat("nodes", F.array("_b")).alias("nodes"))
        if k >= least:
            out.append(now.where("node = first").select(F.lit(k).alias("length"), "nodes"))
    found = _union(out)
    return found.where(F.get("nodes", F.lit(0)) == F.array_min("nodes")) if canonical else found
