"""Toxicity by non-negative positive-unlabelled learning.

The classifier learns from confirmed toxic examples and from unlabelled text, some of which is
toxic. With class prior p and losses l(g) for calling a text toxic and l(-g) for calling it clean,
the risk is  p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)]):  the second term estimates the
risk over clean text from unlabelled text; where it falls below zero the model has begun to fit its
sample, and the step goes the other way.

The model is logistic over the densities of hashed word and n-gram features. A first pass counts over
all unlabelled documents in how many each feature occurs; those stay whose share differs
by ``Z_SCORE`` standard errors or more from their share of the confirmed texts. A second pass learns from
all unlabelled documents: every ``BLOCK`` of them, with the confirmed texts, trains a
classifier by mini-batches in numpy, and the average of the classifiers, which are linear, is the model. So memory is
bounded by a block, and nothing but sums reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .textmodel import Hasher, fold, labelled_features, labelled_ids, score_texts

GRAMS, BITS = (4, 5), 18
#: Words of a text over which a density is counted.
PER_WORDS = 50.0
Z_SCORE = 4.5
#: Unlabelled documents that one classifier learns from.
BLOCK = 4096
#: Sums of weights are exact in these units, so that their order does not matter.
_UNIT = 1 << 16


def hasher() -> Hasher:
    return Hasher(GRAMS, BITS, lower=True, repeats=False)


class Matrix:
    """Rows of (columns, values) in a row."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.at = np.concatenate(([0], np.cumsum([len(c) for c, _ in rows], dtype=np.int64)))
        self.columns = np.concatenate([c for c, _ in rows]) if rows else np.zeros(0, np.int32)
        self.values = np.concatenate([x for _, x in rows]) if rows else np.zeros(0)

    def __len__(self) -> int:
        return len(self.at) - 1

    def part(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        a, b = self.at[first], self.at[last]
        return np.repeat(np.arange(last - first), np.diff(self.at[first : last + 1])), self.columns[a:b], self.values[a:b], last - first


def risk_slopes(g_pos: np.ndarray, g_unl: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives by each score of the non-negative risk, or of minus its second term where that is below zero."""
    up_pos, up_unl = (1 / (1 + np.exp(-np.clip(g, -60, 60))) for g in (g_pos, g_unl))
    clean_risk = np.logaddexp(0, g_unl).mean() - prior * np.logaddexp(0, g_pos).mean()
    of_clean = -prior / len(g_pos) * up_pos, up_unl / len(g_unl)
    if clean_risk < 0:
        return -of_clean[0], -of_clean[1]
    return prior / len(g_pos) * (up_pos - 1) + of_clean[0], of_clean[1]


def train(positive: Matrix, unlabelled: Matrix, width: int, prior: float, epochs: int = 8, batch: int = 512, least_steps: int = 800, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) by Adam on mini-batches of both samples, the rate falling to a fifth."""
    w, b = np.zeros(width), -1.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    steps = max(least_steps, epochs * -(-len(unlabelled) // batch))
    at = {id(positive): 0, id(unlabelled): 0}

    def draw(sample: Matrix, size: int):
        first = at[id(sample)]
        last = min(len(sample), first + size)
        at[id(sample)] = last % len(sample)
        return sample.part(first, last)

    for step in range(1, steps + 1):
        (pr, pc, px, np_), (ur, uc, ux, nu) = draw(positive, batch // 2), draw(unlabelled, batch)
        of_pos, of_unl = risk_slopes(np.bincount(pr, px * w[pc], np_) + b, np.bincount(ur, ux * w[uc], nu) + b, prior)
        grad = np.append(np.bincount(pc, px * of_pos[pr], width) + np.bincount(uc, ux * of_unl[ur], width) + l2 * w, of_pos.sum() + of_unl.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (1 - 0.8 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _document_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that each bucket occurs in, documents), over all of ``texts(t)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n, last, own = np.zeros(1 << BITS, np.int64), 0, np.zeros(1 << BITS, np.int32), hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                for buckets in own.buckets(batch.column(0).slice(at, 1000).to_pylist())[0]:
                    places = np.arange(len(buckets), dtype=np.int32)
                    last[buckets] = places
                    seen[buckets[last[buckets] == places]] += 1  # of repeats, one
                    n += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], n))], ["bucket", "n"])

    table = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # 2 ** BITS rows and one
    bucket, n = table.column(0).to_numpy(), table.column(1).to_numpy()
    out = np.zeros(1 << BITS, np.int64)
    out[bucket[bucket >= 0]] = n[bucket >= 0]
    return out, int(n[bucket < 0].sum())


def telling(pos: np.ndarray, n_pos: int, unl: np.ndarray, n_unl: int) -> np.ndarray:
    """Buckets whose share of texts differs by ``Z_SCORE`` standard errors or more between the two samples."""
    p = (unl + pos + 1) / (n_unl + n_pos + 2)
    z = np.abs(pos / max(1, n_pos) - unl / max(1, n_unl)) / np.sqrt(p * (1 - p) * (1 / max(1, n_pos) + 1 / max(1, n_unl)))
    return np.flatnonzero(z >= Z_SCORE)


def densities(buckets: np.ndarray, counts: np.ndarray, words: int, column_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of one text; ``column_of``: a column for each bucket, or -1."""
    columns = column_of[buckets]
    kept = columns >= 0
    return columns[kept], counts[kept] * (PER_WORDS / max(1, words))


def _learn(texts: DataFrame, sent, width: int, prior: float) -> tuple[np.ndarray, float] | None:
    """The average of the classifiers of all blocks of ``texts(t)``; ``sent``: (positive texts, column of each bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (positive, column_of), own = sent.value, hasher()
        rows, total, n = [], np.zeros(width + 1), 0

        def learn() -> None:
            nonlocal total, n
            order = np.random.default_rng(n).permutation(len(rows))
            w, b = train(positive, Matrix([rows[i] for i in order]), width, prior)
            total, n = total + np.append(w, b) * len(rows), n + len(rows)
            rows.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found, words = own.buckets(batch.column(0).slice(at, 512).to_pylist())
                for buckets, k in zip(found, words.tolist()):
                    columns = column_of[buckets]
                    rows.append(densities(*np.unique(buckets[columns >= 0], return_counts=True), k, column_of))
                    if len(rows) == BLOCK:
                        learn()
        if rows:
            learn()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(width + 1), -1)), pa.array(np.append(np.rint(total * _UNIT).astype(np.int64), n))], ["column", "total"])

    table = texts.mapInArrow(run, "column long, total long").groupBy("column").agg(F.sum("total").alias("total")).orderBy("column").toArrow()
    if not table.num_rows:
        return None
    total = table.column(1).to_numpy()
    mean = total[1:] / _UNIT / total[0]
    return mean[:-1], float(mean[-1])


def _scorer(sent, bias: float):
    own, weights = hasher(), sent.value

    def score(texts: list[str]) -> np.ndarray:
        total, _, words = own.sums(texts, weights)
        return 1 / (1 + np.exp(-np.clip(PER_WORDS * total / np.maximum(1, words) + bias, -500, 500)))

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 0, threshold: float = 0.5, positives: int = 2500, prior: float | None = None) -> DataFrame:
    """``(id, held_out boolean, score double, predicted int)``, a row per input row.

    ``labels(doc_id, toxic)`` may lack documents, repeat rows or hold nulls; rows of the held-out fold
    are not read for learning. Confirmed examples are at most ``positives`` labelled documents, the first
    by a hash of the id (of repeated ids the least text); all documents outside the held-out fold, whole, are the unlabelled text, and every
    row is scored. Blocks follow the table's partitions, so another layout gives slightly other weights; a row's score
    depends on its text alone, so repeated rows score alike. ``prior`` is the share of toxic text, by default its share of the
    labels that may be read. Without a positive example, a telling feature or unlabelled text every score is 0. A null or empty
    text is scored as one without features. Columns besides the two named are ignored.
    """
    spark, learn = docs.sparkSession, fold(F.col("doc_id"), folds) != held_out
    if prior is None:
        prior = labels.where(learn & F.col("toxic").isin(0, 1)).agg(F.avg("toxic")).first()[0]
    prior = min(max(prior or 0.01, 0.001), 0.9)
    _, found, words = labelled_features(docs, labelled_ids(labels, "toxic", 1, positives, learn), hasher(), id_col, text_col)
    weights, bias = np.zeros(1 << BITS), -500.0
    if found:
        texts = docs.where(F.col(id_col).isNotNull() & (fold(F.col(id_col), folds) != held_out)).select(text_or_empty(F.col(text_col)).alias("t"))
        pos = np.bincount(np.concatenate([b for b, _ in found]), minlength=1 << BITS)
        chosen = telling(pos, len(found), *_document_counts(texts))
        if len(chosen):
            column_of = np.full(1 << BITS, -1, np.int32)
            column_of[chosen] = np.arange(len(chosen), dtype=np.int32)
            order = np.random.default_rng(0).permutation(len(found))
            positive = Matrix([densities(*found[i], int(words[i]), column_of) for i in order])
            if (model := _learn(texts, spark.sparkContext.broadcast((positive, column_of)), len(chosen), prior)) is not None:
                weights[chosen], bias = model
    scored = score_texts(docs, id_col, text_col, partial(_scorer, spark.sparkContext.broadcast(weights), bias))
    return scored.select(F.col("id").alias(id_col), (fold(F.col("id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
