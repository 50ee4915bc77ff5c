"""The stored graph: Parquet by version, table and bucket of paths, and a pointer file for each version.

A version is written whole before its pointer appears, under a name that no other version has; the current version is the last pointer
by name. So no reader sees a part of a version or none, and a few earlier versions stay for those who still read
them. A version names, for each bucket, the folder that holds it: a change writes the buckets of its paths anew and keeps the
others, so it costs what it touches. Tables are sorted by the column that questions look up, which lets Parquet's statistics skip row groups.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

SORT = {"symbols": ["name", "qname"], "files": ["path"], "raw_calls": ["callee_name"], "sections": ["document_path"], "contract_entities": ["name"], "storage_containers": ["name"]}
#: Of a path.
BUCKETS = 64
#: Versions that stay readable.
KEPT = 3
_POINTERS = "versions"


def bucket_of(path: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


class Warehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._file(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def version(self) -> str | None:
        """The name of the current version, or none."""
        found = [n for n in self._names(_POINTERS) if n.startswith("v")]
        return found[-1] if found else None

    def _layout(self, version: str | None) -> dict[str, str]:
        """Bucket -> folder."""
        if version is None:
            return {}
        fs, path = self._file(f"{_POINTERS}/{version}")
        source = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def touched(self, paths: DataFrame) -> list[int]:
        """The buckets of ``paths(path)``, ``BUCKETS`` at most."""
        return sorted(r[0] for r in paths.select(bucket_of(F.col("path"))).distinct().collect())

    def write(self, facts: dict[str, DataFrame], buckets: list[int] | None = None) -> str:
        """A new version with these facts: all of it, or of the given buckets, the others staying as they are."""
        before, folder = self.version(), uuid.uuid4().hex
        for name in schemas.TABLES:
            table = facts[name].withColumn("_bucket", bucket_of(F.col(schemas.PATH_KEY[name])))
            table.sortWithinPartitions("_bucket", *SORT.get(name, [])).write.partitionBy("_bucket").parquet(f"{self.root}/{folder}/{name}")
        layout = self._layout(before) if buckets is not None else {}
        layout |= {str(b): folder for b in (range(BUCKETS) if buckets is None else buckets)}
        number = int(before[1:13]) + 1 if before else 0
        version = f"v{number:012d}-{folder}"
        # under another name first: what a listing shows is whole
        fs, part = self._file(f"{_POINTERS}/_{version}")
        sink = fs.create(part, False)
        try:
            sink.write(bytearray(json.dumps(layout).encode()))
        finally:
            sink.close()
        fs.rename(part, self._file(f"{_POINTERS}/{version}")[1])
        return version

    def read(self, version: str | None = None, buckets: list[int] | None = None) -> dict[str, DataFrame]:
        """The facts of a version, by default the current one, or of some of its buckets."""
        from ..plans.graph import empty_facts

        layout = self._layout(version or self.version())
        wanted = {b: f for b, f in layout.items() if buckets is None or int(b) in buckets}
        out = empty_facts(self.spark)
        by_folder: dict[str, list[str]] = {}
        for b, folder in wanted.items():
            by_folder.setdefault(folder, []).append(f"_bucket={b}")
        for name, ddl in schemas.TABLES.items():
            paths = []
            for folder, own in sorted(by_folder.items()):
                there = set(self._names(f"{folder}/{name}"))
                paths += [f"{self.root}/{folder}/{name}/{b}" for b in own if b in there]
            if paths:
                out[name] = self.spark.read.schema(ddl).parquet(*paths)
        return out

    def prune(self) -> None:
        """Drop all versions but the last ``KEPT``, and the folders that only they name."""
        pointers = [n for n in self._names(_POINTERS) if n.startswith("v")]
        fs, _ = self._file("")
        for old in pointers[:-KEPT]:
            fs.delete(self._file(f"{_POINTERS}/{old}")[1], False)
        used = {folder for v in pointers[-KEPT:] for folder in self._layout(v).values()}
        for name in self._names(""):
            if name != _POINTERS and name not in used:
                fs.delete(self._file(name)[1], True)
