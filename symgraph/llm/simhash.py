"""SimHash near-duplicates, searched by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 21, 21 and 22 bits. Padded with zeros to 23 bits, a
segment is a word of the space that the perfect binary Golay code [23, 12, 7] covers; its *codeword
indices* are the 12 data bits of every codeword within 4 bits of it: one where the nearest codeword
is at 0, 1 or 2 bits, six where it is at 3. Two words that differ in at most 2 bits always have an
index in common.

Four differing bits over three segments leave two cases (pigeonhole):

* some segment i agrees, and of the other two the better one, j, differs in at most 2 bits: key
  (i's bits, an index of j), for the 6 ordered pairs (i, j);
* every segment differs, so two of them differ in 1 bit and the third, k, in at most 2: a half of
  each of the two agrees: key (a half of one, a half of the other, an index of k), 3 x 4 choices.

So linked fingerprints share at least one of about 95 keys of 33 bits, and unrelated ones rarely
share any. Candidates are verified by their Hamming distance.

Equal fingerprints are one node from the start. Within a bucket no list of all pairs is made: large buckets are
dealt into parts, fingerprints are compared in order with their first and last few predecessors in the part, and with two of the whole bucket, which is every pair
in buckets of up to ``LAGS + 1``; for larger ones, what those links leave in different components
is compared across components only, block against block. That finds all components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, dealt, hamming, lookup, one_in, settle, stash, text_or_empty, unstash
from .components import connected_components

#: Bits of the segments, from the lowest.
SEGMENTS = (21, 21, 22)
#: Generator polynomial of the Golay code.
GOLAY = 0xC75
LAGS = 4
#: Rows of a part of a bucket, and of a block of those compared with each other.
BLOCK = 1024
_BLOCK_HASHES = 1 << 15


def fingerprint(text: str | None, shingle_words: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of one text; zero where it has no word."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line, k = b" ".join(words), min(shingle_words, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    a, b = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(a), _BLOCK_HASHES):
        hashes = np.array([xxh64_intdigest(line[x:y], seed) for x, y in zip(a[at : at + _BLOCK_HASHES], b[at : at + _BLOCK_HASHES])], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(a)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, seed: int = 42) -> DataFrame:
    """``(id, fp long)``, a row per input row; a null text counts as empty (fingerprint 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle_words, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("t"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def remainder(words: np.ndarray) -> np.ndarray:
    """Of 23-bit words by the generator polynomial: the syndrome."""
    words = words.astype(np.int64)
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GOLAY << (bit - 11)), words)
    return words


def error_patterns() -> np.ndarray:
    """[2048, 6]: by syndrome, the error patterns of weight 4 or less that lead to a codeword, or -1."""
    from itertools import combinations

    table, filled = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        patterns = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)], np.int64)
        for pattern, syndrome in zip(patterns.tolist(), remainder(patterns).tolist()):
            table[syndrome, filled[syndrome]] = pattern
            filled[syndrome] += 1
    return table


def codeword_indices(words: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """[n, 6] data bits of the codewords within 4 bits of each word, or -1."""
    errors = patterns[remainder(words)]
    return np.where(errors >= 0, (words.astype(np.int64)[:, None] ^ errors) >> 11, -1)


def fuzzy_keys(fps: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)``: the keys of each fingerprint; rows index ``fps``."""
    bits, parts, at = fps.astype(np.uint64), [], 0
    for size in SEGMENTS:
        parts.append((bits >> np.uint64(at) & np.uint64((1 << size) - 1)).astype(np.int64))
        at += size
    indices, rows, keys, kind = [codeword_indices(p, patterns) for p in parts], [], [], 0

    def add(exact: np.ndarray, of: int) -> None:
        nonlocal kind
        row, slot = np.nonzero(indices[of] >= 0)
        rows.append(row)
        keys.append((kind << 40) | (exact[row] << 12) | indices[of][row, slot])
        kind += 1

    half = lambda k, which: parts[k] & 0x3FF if which == 0 else parts[k] >> 10
    for i in range(3):
        for j in range(3):
            if i != j:
                add(parts[i], j)
    for k in range(3):
        i, j = (x for x in range(3) if x != k)
        for a in range(2):
            for b in range(2):
                add(half(i, a) << 12 | half(j, b), k)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(nodes: DataFrame) -> DataFrame:
    """``(fp)`` -> ``(key, fp)``"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = error_patterns()
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 1000):
                block = fps[at : at + 1000]
                row, key = fuzzy_keys(block, patterns)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(block[row])], ["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long")


def link_fingerprints(nodes: DataFrame, max_bits: int = 4) -> DataFrame:
    """``nodes(fp long)``, distinct -> ``(node, component)`` of the fingerprints that link with another; component: its smallest fp."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the keys are complete for up to 4 differing bits")
    near = lambda other: hamming(F.col("fp"), F.col(other)) <= max_bits
    w = Window.partitionBy("key", "salt").orderBy("fp")
    keyed = dealt(_keyed(nodes), _keyed(nodes.where(one_in("fp"))), "fp", BLOCK)
    seen = keyed.select("key", "fp", "salts", "low", "high", F.row_number().over(w).alias("n"), F.first("fp").over(w).alias("p0"), *[F.lag("fp", k).over(w).alias(f"p{k}") for k in range(1, LAGS + 1)], *[F.lead("fp", k).over(w).alias(f"s{k}") for k in range(1, LAGS + 2)])
    big = (F.col("salts") > 1) | (F.col("n") > LAGS + 1)
    for n in range(1, LAGS + 2):
        big = big | ((F.col("n") == n) & F.col(f"s{LAGS + 2 - n}").isNotNull())
    to = F.array_compact(F.array(*[F.when((F.col("n") > 1) & near(f"p{k}"), F.col(f"p{k}")) for k in range(LAGS + 1)], *[F.when((F.col(k) != F.col("fp")) & near(k), F.col(k)) for k in ("low", "high")]))
    found = stash(seen.where("salts > 1 or n > 1 or s1 is not null").select("key", "fp", to.alias("to"), F.coalesce(big, F.lit(False)).alias("big")).where("big or size(to) > 0"), "simhash-buckets")
    edges = found.select(F.col("fp").alias("u"), F.explode("to").alias("v"))
    first = settle(connected_components(edges, "simhash-edges"), "simhash-first")

    members = stash(found.where("big").join(first.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("component", "fp").alias("c")), "simhash-members")
    split = stash(members.groupBy("key").agg(F.count("*").alias("_n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high"), "simhash-split")
    open_ = lookup(members, split.select("key", F.ceil(F.col("_n") / BLOCK).cast("int").alias("salts")), "key", "inner", split.select("key", "_n"))
    across = blocks(open_, "fp", {"fp": "fp", "c": "c"}, {"fp": "fp2", "c": "c2"}).where(hamming(F.col("fp"), F.col("fp2")) <= max_bits).select(F.col("c").alias("u"), F.col("c2").alias("v")).distinct()
    joined = settle(connected_components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(across), "simhash-edges"), "simhash-last")
    for old in (keyed, found, first, members, split):
        unstash(old)
    return joined


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, max_bits: int = 4, seed: int = 42) -> DataFrame:
    """``(id, fingerprint, component_id)``, a row per input row.

    ``component_id`` is the smallest id whose fingerprint is reachable over links of at most
    ``max_bits`` differing bits. Null and empty texts have fingerprint zero and link like any other;
    repeated ids are kept as rows of their own; null ids take part but are never the smallest
    unless all are null. Columns besides the two named are ignored. An empty table gives an empty result.
    """
    prints = stash(fingerprints(docs, id_col, text_col, shingle_words, seed), "simhash-prints")
    nodes = stash(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("_n")), "simhash-nodes")
    linked = link_fingerprints(nodes.select("fp"), max_bits)
    named = stash(nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "_n", F.coalesce("component", "fp").alias("c")), "simhash-named")
    least = stash(named.groupBy("c").agg(F.min("least").alias("component_id"), F.count("*").alias("_n")), "simhash-least")
    classes = stash(lookup(named.select("fp", "c"), least.select("c", "component_id"), "c", "inner", least.select("c", "_n")).select("fp", "component_id"), "simhash-classes")
    out = lookup(prints, classes, "fp", "inner", nodes.select("fp", "_n"))
    for old in (nodes, linked, named, least):
        unstash(old)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
