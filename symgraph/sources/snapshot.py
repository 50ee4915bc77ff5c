"""Snapshots of a workspace: what was added, changed or deleted, and what a batch of events amounts to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stale(manifest: DataFrame, scan: DataFrame) -> DataFrame:
    """``(path, change)``: added, deleted, or changed: another mtime and another hash. Both sides have path, mtime_ms, hash."""
    o = manifest.select("path", F.col("mtime_ms").alias("_m"), F.col("hash").alias("_h"), F.lit(True).alias("_o"))
    both = scan.select("path", "mtime_ms", "hash", F.lit(True).alias("_n")).join(o, "path", "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "deleted").when((F.col("mtime_ms") != F.col("_m")) & (F.col("hash") != F.col("_h")), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def unseen(fresh: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows whose path and hash the manifest does not hold."""
    return fresh.join(manifest.select("path", "hash").distinct(), ["path", "hash"], "left_anti")


def last_events(events: DataFrame, *more: str) -> DataFrame:
    """``events(path, seq, event)`` -> the last of each path, with the number of events and the columns named: what a debounced batch applies."""
    last = events.groupBy("path").agg(F.max_by(F.struct("event", *more), "seq").alias("e"), F.count("*").alias("events"), F.max("seq").alias("seq"))
    return last.select("path", F.col("e.event").alias("event"), "events", "seq", *[F.col(f"e.{c}").alias(c) for c in more])
