"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

Words, their byte n-grams and the bigram of a repeated word are hashed into buckets, each with
a learned vector. A document is the average of its features' vectors; a softmax over two classes
is its output. With two classes the softmax needs the difference of the class logits only, which is
linear in the average: for scoring, every bucket's vector is multiplied by that difference once.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textmodel import Hasher, fold, keep_texts, labelled_features, labelled_ids, score_texts

GRAMS, BITS = (3, 4), 17


def train(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int = 12, epochs: int = 12, rate: float = 0.4, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket vectors, class vectors, class biases); per-document stochastic gradient steps, the rate falling linearly."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    classes, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    step, steps = 0, max(1, epochs * len(docs))
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            buckets, counts = docs[i]
            share = (counts / max(1, counts.sum())).astype(np.float32)
            hidden = share @ vectors[buckets] if len(buckets) else np.zeros(dim, np.float32)
            logits = classes @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            now = rate * (1 - step / steps)
            back = classes.T @ p
            classes -= now * np.outer(p, hidden)
            bias -= np.float32(0.1 * now) * p
            if len(buckets):  # as in a lookup layer: the gradient of the average goes to each feature by its share, scaled to the features' number
                vectors[buckets] -= (now * min(len(buckets), 50)) * share[:, None] * back[None, :]
            step += 1
    return vectors, classes, bias


def hasher() -> Hasher:
    return Hasher(GRAMS, BITS, lower=False, repeats=True)


def _scorer(sent, bias: float, untrained: bool):
    own, weights = hasher(), sent.value

    def score(texts: list[str]) -> np.ndarray:
        total, n, _ = own.sums(texts, weights)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(1, n) + bias, -500, 500)))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2, threshold: float = 0.7, per_class: int = 1500) -> DataFrame:
    """``(id, held_out boolean, score double, predicted int)``, a row per input row.

    ``labels(doc_id, quality)`` may lack documents, repeat rows or hold nulls; rows of the held-out
    fold are not read for learning. The model learns from at most ``per_class`` labelled documents of each class, the first
    by a hash of the id (of repeated ids the least text); every row is scored, by its whole text alone, so repeated rows score alike.
    Without labels of both classes every score is 0.5. A null or empty text is scored as one
    without features. Columns besides the two named are ignored.
    """
    make = _trained(docs, labels, id_col, text_col, folds, held_out, per_class)
    scored = score_texts(docs, id_col, text_col, make)
    return scored.select(F.col("id").alias(id_col), (fold(F.col("id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2, threshold: float = 0.7, per_class: int = 1500) -> DataFrame:
    """The rows whose score is ``threshold`` or more, with all their columns; see ``quality_scores``.

    Rows are judged one by one: repeated rows or ids and null ids make no difference. Without labels of both classes nothing is rejected.
    """
    make = _trained(docs, labels, id_col, text_col, folds, held_out, per_class)
    return docs if make.args[2] else keep_texts(docs, text_col, make, threshold)


def _trained(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, folds: int, held_out: int, per_class: int) -> partial:
    """What builds the scorer in a task; its third argument tells that nothing could be learned."""
    learn = fold(F.col("doc_id"), folds) != held_out
    ids = labelled_ids(labels, "quality", 1, per_class, learn).unionByName(labelled_ids(labels, "quality", 0, per_class, learn))
    y, found, _ = labelled_features(docs, ids, hasher(), id_col, text_col)
    send = docs.sparkSession.sparkContext.broadcast
    if len(set(y.tolist())) < 2:
        return partial(_scorer, send(np.zeros(1 << BITS)), 0.0, True)
    vectors, classes, b = train(found, y)
    return partial(_scorer, send((vectors @ (classes[1] - classes[0])).astype(np.float64)), float(b[1] - b[0]), False)
