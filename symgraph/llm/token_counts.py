"""Token counts without materialised ids.

A first pass gathers the distinct pre-tokens of the corpus with their frequencies, and the library
counts the pieces of each of them once. A second pass makes each document's pre-token frequencies;
these join with the counts and are summed.

Frequent pre-tokens, at most ``head`` of at most ``HEAD_BYTES`` bytes, so with a proven bound, go to
the tasks as a broadcast and are joined there; the others, each of which then has at most a
``1 / head`` share of all words, join by a shuffle, and no key of it is hot.

A pre-token here is a run without ASCII white space, cut before trailing ASCII punctuation that
follows an ASCII or Latin-1 letter or a digit. The tokenizer cuts at these places too, whatever
stands around them, so the sum over pre-tokens is the count of the whole text. It must be one that
drops white space and separates letters, digits and punctuation.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, text_or_empty

HEAD_BYTES = 64
#: Pre-tokens that a task of the first pass gathers before it passes them on.
FLUSH = 200_000
_TRAIL = re.compile(rb"(?:(?<=[A-Za-z0-9])|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]+)(?=[\x20\x09-\x0d]|\Z)")


def pretokens(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    if b"<|" not in data:  # else case may tell a special token from a text
        data = data.lower()
    return _TRAIL.sub(rb" \1", data).split()


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _distinct(texts: DataFrame) -> DataFrame:
    """(pretoken, rows): of each task's documents; the same pre-token may come from several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["pretoken", "freq"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column("t"):
                seen.update(pretokens(text.as_py()))
                if len(seen) >= FLUSH:
                    yield flush()
        yield flush()

    return texts.select("t").mapInArrow(run, "pretoken string, freq long")


def vocabulary(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """``texts(t)`` -> ``(pretoken, freq long, pieces int)``, a row for each distinct pre-token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _library(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                pieces = [len(e) for e in tokenizer.encode_batch_fast(part.column(0).to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pieces, pa.int32())], ["pretoken", "freq", "pieces"])

    return _distinct(texts).groupBy("pretoken").agg(F.sum("freq").alias("freq")).mapInArrow(count, "pretoken string, freq long, pieces int")


def _head(vocab: DataFrame, most: int) -> dict[bytes, int]:
    """The most frequent pre-tokens, ``most`` at most, taken by whole bins of frequency."""
    short = vocab.where(F.octet_length("pretoken") <= HEAD_BYTES)
    binned = F.when(F.col("freq") < 1000, F.col("freq")).otherwise(1000 + F.floor(F.log2(F.col("freq")) * 16)).alias("bin")
    bins = short.select("freq", binned).groupBy("bin").agg(F.count("*").alias("n"), F.min("freq").alias("least")).orderBy(F.desc("bin")).collect()  # under 3,000 bins
    least, total = None, 0
    for row in bins:
        total += row["n"]
        if total > most or row["least"] < 2:
            break
        least = row["least"]
    if least is None:
        return {}
    table = short.where(F.col("freq") >= least).select("pretoken", "pieces").toArrow()
    return {k.encode(): v for k, v in zip(table.column(0).to_pylist(), table.column(1).to_pylist())}


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, head: int = 200_000) -> DataFrame:
    """``(id, n_bytes long, n_tokens long, over_limit boolean)``, a row per input row.

    Counts what the library gives without added special tokens, truncation or padding; special
    strings inside a text count as it counts them. A null text counts as empty: 0 bytes, 0 tokens.
    Repeated ids stay rows of their own; columns besides the two named are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("t"))
    vocab = stash(vocabulary(texts, tokenizer_path), "token-vocabulary")
    frequent = spark.sparkContext.broadcast(_head(vocab, head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own, counts, row_of, word_of = part.column("row").to_pylist(), [], [], []
                freqs = []
                for row, text in zip(own, part.column("t")):
                    total = 0
                    for word, n in Counter(pretokens(text.as_py())).items():
                        pieces = known.get(word)
                        if pieces is None:
                            row_of.append(row)
                            word_of.append(word)
                            freqs.append(n)
                        else:
                            total += n * pieces
                    counts.append(total)
                n, more = part.num_rows, len(row_of)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own + row_of, pa.int64()),
                        pa.concat_arrays([part.column("id"), pa.nulls(more, part.column("id").type)]),
                        pa.concat_arrays([part.column("n_bytes"), pa.nulls(more, pa.int64())]),
                        pa.array(counts + [0] * more, pa.int64()),
                        # a document's own row joins with nothing, under a key that no pre-token has
                        pa.array([b"\n%d" % x for x in own] + word_of, pa.binary()).cast(pa.string()),
                        pa.array([0] * n + freqs, pa.int64()),
                        pa.array([True] * n + [False] * more),
                    ],
                    ["row", "id", "n_bytes", "tokens", "pretoken", "freq", "own"],
                )

    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "id", F.octet_length("t").cast("long").alias("n_bytes"), "t")
    spread = rows.mapInArrow(run, f"row long, id {kind}, n_bytes long, tokens long, pretoken string, freq long, own boolean")
    joined = spread.join(vocab.select("pretoken", "pieces"), "pretoken", "left")
    tokens = F.col("tokens") + F.coalesce(F.col("freq") * F.col("pieces"), F.lit(0))
    summed = joined.groupBy("row").agg(F.max("id").alias(id_col), F.max("n_bytes").alias("n_bytes"), F.sum(tokens).alias("n_tokens"))
    return summed.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
