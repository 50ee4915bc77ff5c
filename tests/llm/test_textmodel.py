"""The text classifiers against plain loops: features, risk and its slopes, averaged vectors; defined results for odd input."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from symgraph.llm import quality_classifier, textmodel, toxicity
from tests.llm.test_operators import frame, words

TEXTS = ["", " ", "a", "word word  word", "Ünï ÇA é漢😀 x", "x" * 300, "a\x1cb\u0085c d\r\nd", " ".join(words(5, 400)), "ab ab\tab\nAB"]


def plain(text, sizes, lower):
    """(n-grams, words, repeats) as bytes."""
    own = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower() if lower else text)]
    grams = [(b" " + w + b" ")[i : i + n] for n in sizes for w in own for i in range(len(w) + 3 - n)]
    return grams, own, sum(a == b for a, b in zip(own, own[1:]))


def test_features_are_those_of_a_plain_loop():
    hasher = textmodel.Hasher((3, 4, 5), 18, True, True)
    found, n = hasher.features(TEXTS)
    bucket_of = {}
    for text, (buckets, counts), k in zip(TEXTS, found, n):
        grams, own, again = plain(text, (3, 4, 5), True)
        assert (counts.sum(), k) == (len(grams) + len(own) + again, len(own))
        assert dict(zip(buckets.tolist(), counts.tolist())).get(hasher.repeat_bucket, 0) == again
        for g in {*grams}:  # alone in a text, or among others, an n-gram has the same buckets
            bucket_of.setdefault(g, hasher.features([g.strip().decode("utf-8", "surrogateescape")] if b" " in g else ["?"])[0])
    assert [len(hasher.features(["abcdef", "abcdef"])[0][0][0])] == [len(plain("abcdef", (3, 4, 5), True)[0]) + 1]
    # together and alone
    for text, (buckets, counts) in zip(TEXTS, found):
        (b, c), = hasher.features([text])[0]
        assert b.tolist() == buckets.tolist() and c.tolist() == counts.tolist()


def test_sums_are_those_of_the_features():
    hasher, weights = textmodel.Hasher((4, 5), 18, True, False), np.random.default_rng(1).normal(size=1 << 18)
    total, number, n = hasher.sums(TEXTS, weights)
    found, k = hasher.features(TEXTS)
    assert n.tolist() == k.tolist() and number.tolist() == [int(c.sum()) for _, c in found]
    assert np.allclose(total, [sum(weights[b] * x for b, x in zip(*f)) for f in found])


def test_long_texts_are_cut_between_words(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "beta", "beta", "γάμμα", "d"]) for _ in range(4000))
    hasher = textmodel.Hasher((3, 4), 17, False, True)
    (b, c), = hasher.features([text])[0]
    monkeypatch.setattr(textmodel, "CHUNK", 500)
    (b2, c2), = hasher.features([text])[0]
    assert b.tolist() == b2.tolist() and c.tolist() == c2.tolist()
    both = hasher.features(["x", text, "", text])[0]
    assert both[1][1].tolist() == both[3][1].tolist() == c.tolist() and not len(both[2][0])


def test_slopes_of_the_non_negative_risk():
    def clean(gp, gu, prior):
        return np.mean([np.log1p(np.exp(x)) for x in gu]) - prior * np.mean([np.log1p(np.exp(x)) for x in gp])

    def risk(gp, gu, prior):
        return prior * np.mean([np.log1p(np.exp(-x)) for x in gp]) + clean(gp, gu, prior)

    rng, seen = np.random.default_rng(3), set()
    for _ in range(60):
        gp, gu, prior = rng.normal(2, 3, 4), rng.normal(-3, 3, 7), rng.uniform(0.05, 0.6)
        below = clean(gp, gu, prior) < 0
        seen.add(bool(below))
        of = (lambda a, b, p: -clean(a, b, p)) if below else risk
        got, eps = np.concatenate(toxicity.risk_slopes(gp, gu, prior)), 1e-6
        for i in range(11):
            step = np.zeros(11)
            step[i] = eps
            want = (of(gp + step[:4], gu + step[4:], prior) - of(gp - step[:4], gu - step[4:], prior)) / (2 * eps)
            assert abs(want - got[i]) < 1e-6
    assert seen == {True, False}


def test_document_counts_and_telling_features(spark):
    texts = [t for t in TEXTS if t]
    counts, n = toxicity._document_counts(spark.createDataFrame([(t,) for t in texts], "t string").repartition(3))
    want = Counter(b for b, _ in toxicity.hasher().features(texts)[0] for b in b.tolist())
    assert n == len(texts) and {int(b): int(counts[b]) for b in np.flatnonzero(counts)} == want
    pos, unl = np.zeros(1 << 18, int), np.zeros(1 << 18, int)
    pos[[1, 2]], unl[[1, 2, 3]] = (50, 60), (20, 600, 5)
    assert toxicity.telling(pos, 100, unl, 1000).tolist() == [1]


def test_average_of_blocks_learns_from_every_document(spark, monkeypatch):
    """Every unlabelled document is in one block, and the model is the blocks' average."""
    seen = []

    def train(positive, unlabelled, width, prior):
        seen.append(len(unlabelled))
        return np.full(width, float(len(unlabelled))), 1.0

    monkeypatch.setattr(toxicity, "BLOCK", 40)
    monkeypatch.setattr(toxicity, "train", train)
    column_of = np.zeros(1 << 18, np.int32)

    class Sent:
        value = (toxicity.Matrix([]), column_of)

    class Texts:  # the passes of one task, run here so that the replaced functions are seen
        def mapInArrow(self, f, schema):
            import pyarrow as pa

            rows = pa.RecordBatch.from_arrays([pa.array([f"w{i}" for i in range(100)])], ["t"])
            got = pa.Table.from_batches(list(f(iter([rows]))))
            return spark.createDataFrame(got.to_pandas())

    w, b = toxicity._learn(Texts(), Sent, 3, 0.1)
    assert seen == [40, 40, 20] and b == 1.0 and np.allclose(w, (40 * 40 + 40 * 40 + 20 * 20) / 100)
    assert toxicity._learn(spark.createDataFrame([], "t string"), spark.sparkContext.broadcast(Sent.value), 3, 0.1) is None


def test_quality_score_is_the_softmax_of_the_averaged_vectors():
    found, y = quality_classifier.hasher().features(TEXTS)[0], np.array([0, 1, 0, 1, 0, 1, 0, 1, 1])
    vectors, classes, bias = quality_classifier.train(found, y, epochs=40)
    assert np.abs(classes).max() > 0.1

    class Sent:
        value = (vectors @ (classes[1] - classes[0])).astype(np.float64)

    scores = quality_classifier._scorer(Sent, float(bias[1] - bias[0]), False)(TEXTS)
    for (buckets, counts), score in zip(found, scores):
        mean = np.zeros(vectors.shape[1])
        for b, c in zip(buckets, counts):
            mean += vectors[b].astype(np.float64) * c / counts.sum()
        e = np.exp(classes.astype(np.float64) @ mean + bias)
        assert score == pytest.approx(e[1] / e.sum(), abs=1e-5)


def test_repeated_rows_and_ids_score_alike(spark):
    texts = ["vile vilebar " + " ".join(words(i, 60)) if i % 4 == 0 else " ".join(words(i, 60)) for i in range(200)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    twice = docs.unionByName(docs.where("doc_id < 50")).unionByName(frame(spark, ["other words here", None, texts[0]]))
    for scores in (toxicity.toxicity_scores, quality_classifier.quality_scores):
        rows = scores(twice, labels).toPandas()
        assert len(rows) == 253 and rows["score"].between(0, 1).all()
        assert (rows[rows.doc_id.between(3, 49)].groupby("doc_id")["score"].nunique() == 1).all()
        assert scores(twice, labels.unionByName(labels)).count() == 253
