"""Workspace discovery: which files are read, decided from path and size before any content is."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, is_test_file, language

#: Ignored folders, extensions that are read, schema extensions, extensions that are never text.
IGNORED = "node_modules .git .symgraph dist lib build .next coverage bin target vendor .venv venv __pycache__".split()
INDEXED = "ts tsx js jsx mjs cjs py go rs java c cpp h hpp cs rb php kt scala swift lua zig sh bash sol ex exs ml res m md mdx markdown txt".split()
SCHEMA = "sql cql prisma proto xsd graphql gql avsc".split()
NOT_TEXT = (
    "db db3 sqlite sqlite3 duckdb mdb accdb rdb aof realm db-wal db-shm db-journal sqlite-wal sqlite-shm sqlite3-wal sqlite3-shm ibd frm myd myi arm wt bson ns turtle cfs cfe si del fdt fdx fnm nvd nvm tim tip kdd kdi liv sst ldb "
    "bin dat pack idx node so dylib dll exe class jar pyc pyo wasm zip tar gz bz2 xz 7z pdf png jpg jpeg gif webp ico bmp tiff mp3 mp4 mov avi woff woff2 ttf otf eot"
).split()
SCHEMA_NAME = r"(?i)(^|/)(openapi|swagger|[^/]*\.schema|[^/]*-schema|[^/]*mapping[^/]*|[^/]*elasticsearch[^/]*)\.(json|ya?ml)$"
SIDECAR = r"(?i)\.(db|db3|sqlite|sqlite3)(-(wal|shm|journal))$"
MAX_FILE_SIZE = 1 << 20


def is_ignored(path: Column, ignored: list[str] | None = None) -> Column:
    """In a folder that is never read, or in one of those named besides."""
    names = "|".join(map(re.escape, [*IGNORED, *(ignored or [])]))
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike(f"(?:^|/)(?:{names})(?:/|$)")


def is_not_text(path: Column) -> Column:
    return extension(path).isin(NOT_TEXT) | path.rlike(SIDECAR)


def is_schema_path(path: Column) -> Column:
    return extension(path).isin(SCHEMA) | path.rlike(SCHEMA_NAME)


def is_indexable(path: Column) -> Column:
    return extension(path).isin(INDEXED) | is_schema_path(path)


def looks_binary(content: Column) -> Column:
    """A NUL byte among the first 512 bytes."""
    return F.hex(F.substring(content, 1, 512)).rlike("^(?:..)*?00")


def skip_reason(path: Column, length: Column, binary: Column, max_file_size: int = MAX_FILE_SIZE, ignored: list[str] | None = None) -> Column:
    """The first reason that holds, or ``ok``; a null length is a file that could not be read."""
    return (
        F.when(is_ignored(path, ignored), "ignored").when(is_not_text(path), "not-text").when(~is_indexable(path), "extension")
        .when(length.isNull(), "unreadable").when(length > max_file_size, "too-large").when(binary, "binary").otherwise("ok")
    )


def scan(spark: SparkSession, root: str, max_file_size: int = MAX_FILE_SIZE, ignored: list[str] | None = None, custom: dict[str, str] | None = None) -> DataFrame:
    """``(path, content string, hash, size, line_count, mtime_ms, language, is_test, reason)`` of discovered files; content is read only where path and size allow it.

    The path is relative to ``root``. Filters on path and length come before the content is used, so the source drops files unread.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tail = F.regexp_replace("path", rf"^(?:[a-z0-9]+:/*)?/?{_quoted(base)}/", "")
    found = files.where(F.col("length") <= max_file_size).withColumn("path", tail).where(is_indexable(F.col("path")) & ~is_ignored(F.col("path"), ignored) & ~is_not_text(F.col("path")))
    text = F.decode("content", "UTF-8")
    out = found.withColumn("binary", looks_binary(F.col("content"))).select(
        "path", F.when(~F.col("binary"), text).alias("content"), F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), (F.unix_millis("modificationTime").cast("double")).alias("mtime_ms"), skip_reason(F.col("path"), F.col("length"), F.col("binary"), max_file_size, ignored).alias("reason")
    )
    return out.withColumn("line_count", F.size(F.split("content", "\n"))).withColumn("language", language(F.col("path"), custom)).withColumn("is_test", is_test_file(F.col("path")))


def _quoted(path: str) -> str:
    return re.escape(re.sub(r"^[a-z0-9]+:/*", "", path).lstrip("/"))
