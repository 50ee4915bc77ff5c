"""From scanned files to fact tables. Code and schema files go through the parsers in Arrow batches; documents stay in Spark's functions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import text
from .parsers import code, schema
from .plans.graph import SymGraph, build, empty_facts
from .sources import discovery
from .sources.scratch import cut, drop

#: Source files that are parsed one after the other at most; tables of files compress so well that their bytes say little about the work.
FILES = 2000
_CHILDREN = {"contract_entities": ("fields", "contract_fields", "entity_id"), "storage_containers": ("attributes", "storage_attributes", "container_id")}


def _rows(path: str, content: str, language: str | None) -> Iterator[tuple[str, dict]]:
    """(table, row) of one file."""
    containers: list[dict] = []
    entities: list[dict] = []
    if language:
        p = code.parse(path, content, language)
        for table, rows in (("symbols", p.symbols), ("raw_calls", p.calls), ("raw_imports", p.imports), ("raw_heritage", p.heritage)):
            yield from ((table, {**r, "file": path} if table == "raw_heritage" else r) for r in rows)
        yield "aliases", {"path": path, "library_aliases": p.aliases}
        if any(i["imported_path"].partition("/")[0].lstrip("@") in schema.MAPPERS for i in p.imports):
            containers = schema.parse_mongoose(path, content)
    else:
        entities, containers = schema.parse_schema(path, content)
    for table, owners in (("contract_entities", entities), ("storage_containers", containers)):
        child, child_table, key = _CHILDREN[table]
        for o in owners:
            yield table, {k: v for k, v in o.items() if k != child}
            yield from ((child_table, {"id": f"{o['id']}:{c['name']}", key: o["id"], "file": path, **c}) for c in o[child])


def _parse(registered: tuple[dict, dict], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    code.adopt(*registered)
    for batch in batches:
        out = []
        for path, content, language in zip(batch["path"], batch["content"], batch["language"]):
            try:
                out += [(table, json.dumps(row)) for table, row in _rows(path, content or "", language)]
            except Exception as e:  # one file that cannot be parsed does not stop the others
                out.append(("errors", json.dumps({"path": path, "error": str(e)[:500]})))
        yield pd.DataFrame(out, columns=["table", "row"])


def facts(files: DataFrame) -> dict[str, DataFrame]:
    """``files`` as ``discovery.scan`` gives them -> the fact tables; files with a reason other than ok are left out.

    What was read and parsed is kept in the shared folder until ``release``: a cache would be found again by later scans of the same folder, whose files
    may have changed since.
    """
    spark = files.sparkSession
    ok = cut(files.where("reason = 'ok' and content is not null"), "files", FILES)
    is_doc = text.is_doc_file(F.col("path"))
    parsed = ok.where(F.col("language").isNotNull() | discovery.is_schema_path(F.col("path"))).select("path", "content", "language").mapInPandas(partial(_parse, code.registered()), "table string, row string")
    parsed = cut(parsed, "parsed")
    out = empty_facts(spark)
    of = lambda table, ddl: parsed.where(F.col("table") == table).select(F.from_json("row", ddl).alias("r")).select("r.*")
    for table in ("symbols", "raw_calls", "raw_imports", "raw_heritage", "contract_entities", "contract_fields", "storage_containers", "storage_attributes"):
        out[table] = of(table, schemas.TABLES[table])
    aliases = of("aliases", "path string, library_aliases array<struct<alias:string,module:string>>")
    own = ok.where("language is not null").select("path", "language", "hash", "line_count", "size", "is_test", "mtime_ms")
    out["files"] = own.join(aliases, "path", "left")
    docs = ok.where(is_doc & F.col("language").isNull()).select("path", "content")
    out["documents"] = text.document_titles(docs)
    out["sections"] = text.sections(docs).withColumn("referenced_symbols", text.references(F.concat_ws("\n", "title", "content")))
    out["rules"] = text.rules(docs)
    out["manifest"] = ok.select("path", "hash", "size", "mtime_ms")
    out["errors"] = of("errors", "path string, error string")
    out["errors"].of_cut = ok, parsed
    return out


def release(tables: dict[str, DataFrame]) -> None:
    """Delete what ``facts`` kept; its tables can no longer be read."""
    for old in tables["errors"].of_cut:
        drop(old)


def index(spark: SparkSession, root: str, **options) -> SymGraph:
    """Scan, parse, resolve and link a workspace."""
    return build(facts(discovery.scan(spark, root, custom=code.custom_extensions(), **options)))
