"""WARC archives: written by Spark's text writer, read back, and assembled into transactions.

A capture is written as three records: request, response (or revisit, where an earlier capture has the
same payload) and metadata; request and metadata name the response in WARC-Concurrent-To. A
record ends with two line ends, which are the writer's separator, so archives go through any file
system that Spark can write; they are compressed and rolled at about ``FILE_BYTES``.

Reading goes through Spark's text reader with the same separator, which passes bytes on as they are: what lies between
two separators comes in order and is put together by content length, so a task holds one record and
one batch, whatever the size of the file. Assembly joins records through their
concurrent-to identifiers, in either direction and over one record in between, and gives one
nested row per capture.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import HOT, lookup, remove, scratch_path, stash, text_or_empty, unstash

LEAST_REVISIT_BYTES = 100
#: Payload bytes of an archive, on average.
FILE_BYTES = 256 << 20
RECORD = "type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, date string, payload_digest string, content_type string, http_head string, payload binary"
_BATCH_BYTES = 4 << 20
_EOL = "\r\n"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uuid(kind: str, *parts: Column) -> Column:
    """A record's identifier, from its kind and key."""
    h = F.md5(F.concat_ws(":", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(headers: list[tuple[str, Column | str | None]], block: Column) -> Column:
    """Headers whose value is null are left out."""
    lines = [F.lit("WARC/1.1")] + [F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value)) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(_EOL, *lines), F.lit(_EOL * 2), block)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one capture per row into gzipped WARC files under ``path``.

    Of captures with equal payloads of at least 100 bytes those with the smallest id are responses
    and those with greater ids revisit one of them. A null payload is empty; a null url has no target header; line ends in urls are
    percent-encoded. Repeated rows are captures of their own: record ids are made of id, digest and the row's place in the table,
    which has to give the same rows when it is read twice, as files do.
    """
    one_line = lambda c: F.regexp_replace(F.regexp_replace(c, "\r", "%0D"), "\n", "%0A")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), one_line(F.col(url_col).cast("string")).alias("url"), text_or_empty(F.col(payload_col)).alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256)).withColumn("bytes", F.octet_length("body"))
    sizes = Observation()
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row", "url")
    repeated = rows.observe(sizes, F.count("*").alias("n"), F.sum(F.col("bytes").cast("long")).alias("bytes")).where(F.col("bytes") >= LEAST_REVISIT_BYTES).groupBy("digest").agg(F.min(order).alias("f"), F.count("*").alias("n")).where("n > 1")
    firsts = stash(repeated.select(F.col("digest").alias("d"), F.col("f.id").alias("first"), F.col("f.row").alias("first_row"), F.col("f.url").alias("first_url"), "n"), "warc-firsts")
    n, total = sizes.get["n"], sizes.get["bytes"] or 0
    # a payload that over 1 in HOT rows share is one of HOT at most, so these are broadcast; no other is hot
    hot, rest = (firsts.where(c).drop("n") for c in (F.col("n") > n / HOT, F.col("n") <= n / HOT))
    long_digest = F.when(F.col("bytes") >= LEAST_REVISIT_BYTES, F.col("digest"))
    with_hot = rows.withColumn("key", long_digest).join(F.broadcast(hot), F.col("key") == F.col("d"), "left")
    other = rest.toDF("d2", "first2", "first_row2", "first_url2")
    key = F.when(F.col("d").isNull() & F.col("key").isNotNull(), F.col("key")).otherwise(F.concat(F.lit("-"), F.col("row").cast("string")))
    marked = with_hot.withColumn("key", key).join(other, F.col("key") == F.col("d2"), "left")
    marked = marked.select("row", "id", "url", "body", "digest", "bytes", *[F.coalesce(c, c + "2").alias(c) for c in ("first", "first_row", "first_url")])
    marked = marked.withColumn("again", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    own = _uuid("response", F.col("id"), F.col("digest"), F.col("row"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(_EOL * 2))
    common = [("WARC-Date", date), ("WARC-Target-URI", F.col("url"))]
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    response = _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response")], F.concat(head, F.col("body")))
    revisit = _record(
        [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Refers-To", _uuid("response", F.col("first"), F.col("digest"), F.col("first_row"))), ("WARC-Refers-To-Target-URI", F.col("first_url")), ("WARC-Profile", _REVISIT_PROFILE), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response")],
        head,
    )
    asked = F.concat(F.lit("GET "), F.coalesce(F.regexp_replace("url", r"^[a-z]+://[^/]*", ""), F.lit("")), F.lit(f" HTTP/1.1{_EOL}Host: "), F.coalesce(F.regexp_extract("url", r"^[a-z]+://([^/]*)", 1), F.lit("")), F.lit(_EOL * 2))
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", _uuid("request", F.col("id"), F.col("digest"), F.col("row"))), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http;msgtype=request")], asked)
    fields = F.concat_ws("", F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit(_EOL)), F.lit(f"fetched-by: symgraph{_EOL}"))
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _uuid("metadata", F.col("id"), F.col("digest"), F.col("row"))), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], fields)
    capture = F.concat_ws(_EOL * 2, request, F.when(F.col("again"), revisit).otherwise(response), metadata)
    marked.select(capture.alias("value")).write.option("lineSep", _EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", max(1, FILE_BYTES * n // max(1, total, n))).text(path)
    unstash(firsts)


class _Stream:
    """Bytes that come piece by piece."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.buffer = pieces, bytearray()

    def fill(self) -> bool:
        part = next(self.pieces, None)
        self.buffer += part or b""
        return part is not None

    def until(self, mark: bytes) -> bytes | None:
        searched = 0
        while (i := self.buffer.find(mark, searched)) < 0:
            searched = max(0, len(self.buffer) - len(mark) + 1)
            if not self.fill():
                return None
        out = bytes(self.buffer[:i])
        del self.buffer[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.fill():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def inflated(content: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """The pieces of a file, plain or gzipped by file or by record."""
    if content[:2] != b"\x1f\x8b":
        yield from (content[at : at + step] for at in range(0, len(content), step))
        return
    inflate = zlib.decompressobj(31)
    for at in range(0, len(content), step):
        part = content[at : at + step]
        while part:
            if inflate.eof:  # the next member
                inflate = zlib.decompressobj(31)
            yield inflate.decompress(part)
            part = inflate.unused_data


def parse_records(pieces: Iterator[bytes]) -> Iterator[dict]:
    """The records of one archive; an incomplete last record is left out."""
    stream = _Stream(pieces)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.lstrip(b"\r\n").decode("utf-8", "replace").split(_EOL)
        if not lines[0].startswith("WARC/"):
            continue
        fields: dict[str, list[str]] = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            fields.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(fields.get("content-length", ["0"])[0])
        block = stream.take(size)
        if len(block) < size:
            return
        one = lambda name: fields.get(name, [None])[0]
        http, payload = None, block
        if (one("content-type") or "").startswith("application/http"):
            first, mark, rest = block.partition(b"\r\n\r\n")
            http, payload = (first.decode("utf-8", "replace"), rest) if mark else (first.decode("utf-8", "replace"), b"")
        yield {"type": one("warc-type"), "record_id": one("warc-record-id"), "concurrent_to": fields.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"), "target_uri": one("warc-target-uri"), "date": one("warc-date"), "payload_digest": one("warc-payload-digest"), "content_type": one("content-type"), "http_head": http, "payload": payload}


def _batches(records: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for record in records:
        rows.append(record)
        held += len(record["payload"]) + 500
        if held > _BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``, a row per record.

    Files named ``.gz``, compressed whole or by record, are streamed, a task each. Files named ``.warc``, plain or compressed, are read whole, of up
    to 2 GB each. A folder without archives gives an empty result.
    """
    strings, kinds = pa.string(), {"concurrent_to": pa.list_(pa.string()), "payload": pa.binary()}
    names = [x.split()[0] for x in RECORD.split(", ")]
    schema = pa.schema([(n, kinds.get(n, strings)) for n in names])

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = ((file, line.as_py()) for batch in batches for file, line in zip(batch.column(0).to_pylist(), batch.column(1)))
        for _, own in groupby(lines, key=lambda x: x[0]):
            yield from _batches(parse_records(line + b"\r\n\r\n" for _, line in own), schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _batches(parse_records(inflated(content.as_py())), schema)

    def some(suffix: str, source: str):
        return spark.read.format(source).option("recursiveFileLookup", "true").option("pathGlobFilter", suffix)

    zipped = some("*.gz", "text").option("lineSep", _EOL * 2).load(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    plain = some("*.warc", "binaryFile").load(path).select("content")
    return zipped.mapInArrow(streamed, RECORD).unionByName(plain.mapInArrow(whole, RECORD))


def assemble(records: DataFrame) -> DataFrame:
    """``(capture_id, response struct, requests array<struct>, metadata array<struct>)``, a row per response or revisit.

    A record belongs to a capture if it names its response in WARC-Concurrent-To, the response names it, or it names a
    record that belongs to it. Captures without request or metadata have empty arrays; records of no
    capture are left out. Where a record id repeats, each of its rows is a capture and has all that belongs to the id.
    ``records`` may have any columns besides type, record_id and concurrent_to.
    """
    main = F.col("type").isin("response", "revisit")
    pointers = records.select("type", "record_id", F.explode("concurrent_to").alias("to"))
    ids = records.where(main).select(F.col("record_id").alias("capture_id"))
    named = pointers.where(~main).join(ids, F.col("to") == F.col("capture_id")).select(F.col("record_id").alias("child"), "capture_id")
    naming = pointers.where(main).select(F.col("to").alias("child"), F.col("record_id").alias("capture_id"))
    direct = named.unionByName(naming)
    over = pointers.where(~main).join(direct, F.col("to") == F.col("child")).select(F.col("record_id").alias("child"), "capture_id")
    belongs = direct.unionByName(over).distinct()
    whole = F.struct(*records.columns)
    children = records.where(F.col("type").isin("request", "metadata")).select(F.col("record_id").alias("child"), "type", whole.alias("r")).join(belongs, "child")
    pick = lambda kind: F.sort_array(F.collect_list(F.when(F.col("type") == kind, F.col("r"))))
    grouped = children.groupBy("capture_id").agg(pick("request").alias("requests"), pick("metadata").alias("metadata"))
    captures = records.where(main).select(F.col("record_id").alias("capture_id"), whole.alias("response"))
    out, none = captures.join(grouped, "capture_id", "left"), F.array()
    return out.select("capture_id", "response", *[F.coalesce(c, none.cast(grouped.schema[c].dataType)).alias(c) for c in ("requests", "metadata")])


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", path: str | None = None) -> DataFrame:
    """``(id long, payload_bytes long, payload_digest, record_type, refers_to long)`` as read back from the archives written to ``path``.

    Length and digest of a response are computed from the payload read; those of a revisit come from the response it
    refers to. A row per row; see ``write_archive`` for nulls and repeats. A null id is null again. An empty table gives an empty result.
    """
    spark, own = pages.sparkSession, path is None
    path = path or scratch_path(spark, "warc")
    write_archive(pages, path, id_col, url_col, payload_col)
    note = F.regexp_extract(F.decode("payload", "UTF-8"), r"page-id: (-?\d+)", 1)
    records = stash(read_archive(spark, path).select("type", "record_id", "concurrent_to", "refers_to", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"), F.when(F.col("type") == "metadata", F.when(note != "", note.cast("long"))).alias("page")), "warc-records")
    if own:
        remove(spark, path)
    captures = stash(assemble(records).select("capture_id", F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("to"), F.col("response.bytes").alias("bytes"), F.col("response.digest").alias("digest"), F.get("metadata.page", F.lit(0)).alias("page")), "warc-captures")
    unstash(records)
    first = captures.where("record_type = 'response'").select(F.col("capture_id").alias("to"), F.col("bytes").alias("b"), F.col("digest").alias("d"), F.col("page").alias("p"))
    kept = captures.where("record_type = 'response'").select(F.col("page").alias(id_col), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = lookup(captures.where("record_type = 'revisit'").select("to", "page", "record_type"), first, "to")
    found = F.when(F.col("b").isNull(), F.raise_error(F.lit("a revisit names a response that the archives do not hold"))).otherwise(F.col("b"))
    return kept.unionByName(again.select(F.col("page").alias(id_col), found.cast("long").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", F.col("p").alias("refers_to")))


ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as body, sha256(coalesce(html, '')) as d, octet_length(encode(coalesce(html, ''))) as n from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select p.page_id, p.n::bigint as payload_bytes, p.d as payload_digest,
       case when p.page_id > f.first then 'revisit' else 'response' end as record_type,
       case when p.page_id > f.first then f.first end as refers_to
from p left join f on p.d = f.d and p.n >= 100
"""
