"""Shared by the two text classifiers: hashed features of whole texts, bounded samples of labelled rows, scoring.

A text is a run of words (white space is ASCII white space). Its features are the words, the byte
n-grams of each word between two marks, and, if asked for, the bigram of a word that repeats. All are hashed into ``2 ** bits``
buckets. Many texts are hashed together in numpy: an n-gram is packed into an integer and multiplied,
a word is a sum of random numbers by byte and place; no step loops over words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Bytes hashed together. A longer text is cut at white space, and a run of over that many bytes without any counts as several words.
CHUNK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MIX32, _MIX64 = np.uint32(0x9E3779B1), np.uint64(0x9E3779B97F4A7C15)
_PLACES = 64


def fold(doc_id, folds: int) -> F.Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


@cache
def _by_place() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 2**64, (_PLACES, 256), np.uint64).ravel()


def _pieces(texts: list[str], lower: bool) -> Iterator[tuple[int, bytes, bool]]:
    """(text, bytes, whether it goes on from the piece before) of at most ``CHUNK`` bytes."""
    for i, text in enumerate(texts):
        data = (text.lower() if lower else text).encode("utf-8", "surrogatepass")
        if len(data) <= CHUNK:
            yield i, data, False
            continue
        at = 0
        while at < len(data):
            to = min(at + CHUNK, len(data))
            if to < len(data):
                window = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, to - at, at)])
                to = at + int(window[-1]) + 1 if len(window) else to
            yield i, data[at:to], at > 0
            at = to


class Hasher:
    """The features of texts. ``sizes``: of the n-grams, 3 to 5 bytes, marks included."""

    def __init__(self, sizes: tuple[int, ...], bits: int, lower: bool, repeats: bool):
        if not all(3 <= n <= 5 for n in sizes):
            raise ValueError("n-grams have 3 to 5 bytes")
        self.sizes, self.bits, self.lower, self.repeats = sizes, bits, lower, repeats

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
        """For each chunk: (words of each text of the chunk by text number, groups of (text number, bucket), each ascending by text)."""
        held, size, last = [], 0, (-1, np.uint64(0))
        for piece in _pieces(texts, self.lower):
            if held and size + len(piece[1]) > CHUNK:
                out, last = self._chunk(held, len(texts), last)
                yield out
                held, size = [], 0
            held.append(piece)
            size += len(piece[1]) + 1
        if held:
            yield self._chunk(held, len(texts), last)[0]

    def _chunk(self, held: list[tuple[int, bytes, bool]], n_texts: int, last: tuple[int, np.uint64]):
        buf = np.frombuffer(b"\n" + b"\n".join([x[1] for x in held]) + b"\n", np.uint8)
        space = _SPACE[buf]
        raw = np.where(space, np.uint8(0x20), buf).astype(np.uint32)
        owner = np.repeat(np.array([x[0] for x in held], np.int32), [len(x[1]) + 1 for x in held])  # of the byte after a position
        owner = np.append(owner, owner[-1:])
        solid, groups = ~space, []
        starts = np.flatnonzero(space[:-1] & solid[1:]) + 1
        ends = np.flatnonzero(solid[:-1] & space[1:]) + 1
        shift32 = np.uint32(32 - self.bits)
        packed = raw[:-1] | raw[1:] << np.uint32(8)
        whole = solid[1:]  # of the bytes between the first and the last of the n-gram that starts at a position
        for n in range(3, max(self.sizes, default=0) + 1):
            packed = packed[:-1] | raw[n - 1 :] << np.uint32(8 * (n - 1)) if n <= 4 else packed[:-1] * np.uint32(0x85EBCA6B) ^ packed[:-1] >> np.uint32(15) ^ raw[n - 1 :]
            whole = whole[: len(packed)] if n == 3 else whole[:-1] & solid[n - 2 : n - 2 + len(packed)]
            if n in self.sizes:
                at = np.flatnonzero(whole)
                groups.append((owner[at], ((packed[at] * np.uint32(2 * n + 1) * _MIX32) >> shift32).astype(np.int32)))
        text_of = owner[starts - 1]
        counts = np.bincount(text_of, minlength=n_texts) if len(starts) else np.zeros(n_texts, np.int64)
        if len(starts):
            lengths = ends - starts
            inside = np.flatnonzero(solid)
            place = inside - np.repeat(starts, lengths)
            terms = _by_place()[(place % _PLACES) * 256 + buf[inside]]
            own = np.add.reduceat(terms * ((place // _PLACES).astype(np.uint64) * np.uint64(2) + np.uint64(1)), np.cumsum(lengths) - lengths)
            own = (own ^ own >> np.uint64(32)) * _MIX64
            groups.append((text_of, (own >> np.uint64(64 - self.bits)).astype(np.int32)))
            if self.repeats:
                same = np.flatnonzero((own[1:] == own[:-1]) & (text_of[1:] == text_of[:-1])) + 1
                if own[0] == last[1] and text_of[0] == last[0] and held[0][2]:
                    same = np.append(0, same)
                groups.append((text_of[same], np.full(len(same), self.repeat_bucket, np.int32)))
            last = (int(text_of[-1]), own[-1])
        return (counts, groups), last

    @property
    def repeat_bucket(self) -> int:
        """Of the word bigram whose two words are equal, whatever they are."""
        return (1 << self.bits) - 1

    def sums(self, texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sum of the features' weights, number of features, number of words) of each text."""
        total, number, words = np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for counts, groups in self(texts):
            words += counts
            for of, bucket in groups:
                total += np.bincount(of, weights[bucket], len(texts))
                number += np.bincount(of, minlength=len(texts))
        return total, number, words

    def buckets(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """(all buckets of each text, repeats included; words of each text)"""
        found: list[list[np.ndarray]] = [[] for _ in texts]
        words = np.zeros(len(texts), np.int64)
        for counts, groups in self(texts):
            words += counts
            for of, bucket in groups:
                if len(of):
                    cuts = np.flatnonzero(np.diff(of)) + 1
                    for i, part in zip(of[np.append(0, cuts)].tolist(), np.split(bucket, cuts)):
                        found[i].append(part)
        return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in found], words

    def features(self, texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """((distinct buckets, counts) of each text, words of each text)"""
        found, words = self.buckets(texts)
        return [np.unique(x, return_counts=True) for x in found], words


def labelled_ids(labels: DataFrame, label: str, value: int, most: int, learn: F.Column) -> DataFrame:
    """Up to ``most`` ids with that label, the first by a hash of the id; a bounded table."""
    rows = labels.where(F.col("doc_id").isNotNull() & (F.col(label) == value) & learn).select(F.col("doc_id").alias("key")).distinct()
    return rows.orderBy(F.xxhash64("key"), "key").limit(most).withColumn("y", F.lit(value))


def labelled_features(docs: DataFrame, ids: DataFrame, hasher: Hasher, id_col: str, text_col: str) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(label, (distinct buckets, counts), words) of the whole texts of a bounded table of ids, by id; of repeated ids the least text."""
    rows = docs.select(F.col(id_col).alias("key"), text_or_empty(F.col(text_col)).alias("t"))
    sample = rows.join(F.broadcast(ids), "key").groupBy("key", "y").agg(F.min("t").alias("t"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found, words = hasher.features(part.column(2).to_pylist())
                columns = [part.column(0).cast(pa.string()), part.column(1), pa.array([b for b, _ in found], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32())), pa.array(words)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "y", "b", "c", "n"])

    got = sample.select("key", "y", "t").mapInArrow(extract, "key string, y int, b array<int>, c array<int>, n long").toArrow()
    y = np.array(got.column(1).to_pylist(), np.int64)
    order = np.argsort(np.array([f"{k}/{v}" for k, v in zip(got.column(0).to_pylist(), y)]), kind="stable").tolist()
    buckets, counts = got.column(2).combine_chunks(), got.column(3).combine_chunks()
    return y[order], [(buckets[i].values.to_numpy(), counts[i].values.to_numpy()) for i in order], np.array(got.column(4).to_pylist(), np.int64)[order]


def score_texts(docs: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """``(id, score double)``, a row per input row; ``make`` builds the scorer of a list of texts once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1).to_pylist()), pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("t"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def keep_texts(docs: DataFrame, text_col: str, make: Callable[[], Callable[[list[str]], np.ndarray]], least: float) -> DataFrame:
    """The rows, with all their columns, whose text (null: empty) scores ``least`` or more; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            yield batch.filter(pa.array(score([t or "" for t in batch.column(text_col).to_pylist()]) >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
