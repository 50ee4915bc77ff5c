"""File events as a stream: micro-batches are debounced, deduplicated by content hash and applied to the stored facts.

Events arrive as rows ``(path, seq, event, content)``, event one of add, change and unlink; a file source cannot see deletions, so
whoever feeds the stream writes them as events, or ``rescan`` finds them by comparing snapshots. A batch applies deletions
first and then upserts; edges are derived from facts, so what other files refer to is resolved anew each time.
"""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import extract
from ..functions.text import is_test_file, language
from ..operators.ingest import delete_paths, upsert
from ..parsers import code
from ..plans.graph import SymGraph, build
from ..sources import discovery, snapshot
from ..sources.scratch import cut, drop
from ..sources.warehouse import Warehouse

EVENTS = "path string, seq long, event string, content string"


class Watcher:
    def __init__(self, spark: SparkSession, warehouse: Warehouse, max_file_size: int = discovery.MAX_FILE_SIZE, ignored: list[str] | None = None):
        self.spark, self.warehouse, self.max_file_size, self.ignored = spark, warehouse, max_file_size, ignored
        self._lock, self.last_active, self.batches = threading.Lock(), time.monotonic(), 0

    def apply(self, batch: DataFrame, epoch: int = 0) -> dict[str, int]:
        """One micro-batch: of each path its last event counts; unchanged content is skipped. A path that may no longer be read (it grew too large, say) counts as deleted."""
        with self._lock:  # one writer at a time
            last = cut(snapshot.last_events(batch, "content").where(~F.col("path").endswith(".log")), "events")
            files = self._as_files(last.where("event <> 'unlink'"))
            gone = last.where("event = 'unlink'").select("path").unionByName(files.where("reason <> 'ok'").select("path"))
            counts = self._replace(gone, files.where("reason = 'ok'"))
            drop(last)
            self.last_active, self.batches = time.monotonic(), self.batches + 1
            return counts

    def _replace(self, gone: DataFrame, files: DataFrame) -> dict[str, int]:
        """Take ``gone`` out and put the files in whose content is new; only the buckets of these paths are read and written."""
        known = self.warehouse.read()["manifest"]
        gone = cut(gone.join(known.select("path"), "path", "left_semi").distinct(), "gone")
        fresh = cut(snapshot.unseen(files, known), "fresh")
        changed = fresh.join(known.select("path"), "path", "left_semi").count()
        counts = {"added": fresh.count() - changed, "changed": changed, "deleted": gone.count()}
        if any(counts.values()):
            buckets = self.warehouse.touched(gone.unionByName(fresh.select("path")))
            parsed = extract.facts(fresh)
            facts = delete_paths(self.warehouse.read(buckets=buckets), gone)
            self.warehouse.write(upsert(facts, {k: v for k, v in parsed.items() if k in facts}, fresh.select("path")), buckets)
            self.warehouse.prune()
            extract.release(parsed)
        for old in (gone, fresh):
            drop(old)
        return {k: n for k, n in counts.items() if n}

    def _as_files(self, rows: DataFrame) -> DataFrame:
        size = F.octet_length("content").cast("long")
        binary = F.substring("content", 1, 512).contains("\x00")
        return rows.select("path", "content", F.sha2("content", 256).alias("hash"), size.alias("size"), F.size(F.split("content", "\n")).alias("line_count"), F.lit(0.0).alias("mtime_ms"), language(F.col("path"), code.custom_extensions()).alias("language"), is_test_file(F.col("path")).alias("is_test"), discovery.skip_reason(F.col("path"), size, binary, self.max_file_size, self.ignored).alias("reason"))

    def start(self, events: DataFrame, checkpoint: str, seconds: float = 0.3):
        """A running query over a streaming DataFrame of events; ``processAllAvailable`` waits until it has caught up."""
        return events.writeStream.foreachBatch(lambda df, epoch: self.apply(df, epoch)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()

    def stop_when_idle(self, query, minutes: float, poll: float = 1.0) -> None:
        """Stops the query after that long without a batch, never during one; zero means never."""

        def wait() -> None:
            while query.isActive:
                time.sleep(poll)
                if time.monotonic() - self.last_active > minutes * 60 and self._lock.acquire(blocking=False):
                    try:
                        query.stop()
                    finally:
                        self._lock.release()

        if minutes > 0:
            threading.Thread(target=wait, daemon=True).start()

    def rescan(self, root: str) -> dict[str, int]:
        """Catch up with a folder: compare a scan with the stored manifest and apply the difference. Read before a stream starts."""
        with self._lock:
            known = self.warehouse.read()["manifest"]
            scan = discovery.scan(self.spark, root, self.max_file_size, self.ignored, code.custom_extensions()).where("reason = 'ok'")
            scan = cut(scan, "scan")
            diff = cut(snapshot.stale(known, scan), "stale")
            counts = self._replace(diff.where("change = 'deleted'").select("path"), scan.join(diff.where("change <> 'deleted'").select("path"), "path", "left_semi"))
            for old in (scan, diff):
                drop(old)
            return counts

    def graph(self) -> SymGraph:
        return build(self.warehouse.read())


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of event files, JSON lines."""
    return spark.readStream.schema(EVENTS).json(folder)


_index_lock = threading.Lock()
_running: dict[str, threading.Event] = {}


def index_once(spark: SparkSession, root: str, warehouse: Warehouse, max_file_size: int = discovery.MAX_FILE_SIZE, ignored: list[str] | None = None) -> SymGraph:
    """A full index; a caller who comes while one runs for the same root waits for it and shares its result."""
    with _index_lock:
        done = _running.get(root)
        mine = done is None
        if mine:
            done = _running[root] = threading.Event()
    if mine:
        try:
            parsed = extract.facts(discovery.scan(spark, root, max_file_size, ignored, code.custom_extensions()))
            warehouse.write({k: v for k, v in parsed.items() if k != "errors"})
            warehouse.prune()
            extract.release(parsed)
        finally:
            with _index_lock:
                del _running[root]
            done.set()
    else:
        done.wait()
    return build(warehouse.read())
