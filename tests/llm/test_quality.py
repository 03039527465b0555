from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from forgemart.llm import quality


def corpus(n=900):
    draw = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        good = draw.random() < 0.7
        words = [draw.choice("the of and stone river over under light".split()) for _ in range(draw.randint(1, 60))]
        text = " ".join(words) if good else " ".join(w.upper() + "!!" if draw.random() < 0.5 else "###" for w in words)
        rows.append((i, text, "x", 0.5))
        if i % 2:
            labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_rules(spark):
    rows, labels = corpus()
    rows += [(5000, None, "x", 0.5), (5001, "", "x", 0.5), (None, "the river", "x", 0.5), (5002, "word " * 50_000, "x", 0.5), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(4)
    known = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (1, labels[0][1], 0)], "doc_id long, quality int, toxic int")
    found = quality.classify(docs, known)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        assert r.predicted == (r.score >= 0.5)
    truth = dict((i, q) for i, q, _ in labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert sorted(got, key=repr) == sorted(quality.classify(docs.repartition(2), known).collect(), key=repr)
    kept = quality.keep_good(docs, known)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in got)


def test_scores_by_hand_and_by_any_batch():
    """Pooling and network against plain loops; a row's score is the same in batches of any size."""
    rows, labels = corpus(300)
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(quality.WORDS, quality.DIMS)).astype(np.float32)
    texts = [t.encode() for _, t, *_ in rows]
    x = np.array([quality.pool(t, vectors) for t in texts])
    truth = dict((i, q) for i, q, _ in labels)
    net = quality.fit_network(x[1::2], np.array([float(truth[i]) for i in range(1, 300, 2)]))
    scores = net.scores(x)
    for size in (1, 2, 7, 64):
        parts = [net.scores(x[i : i + size]) for i in range(0, len(x), size)]
        assert np.array_equal(np.concatenate(parts), scores)
    for text, score in list(zip(texts, scores, strict=True))[:40]:
        pooled = []
        for slots in quality._slots(text):
            for d in range(quality.DIMS):
                pooled.append([float(vectors[s][d]) for s in slots])
        half = len(pooled) // 2
        mean = [sum(v) / len(v) for v in pooled]
        deviation = [max(sum(a * a for a in v) / len(v) - m * m, 0) ** 0.5 for v, m in zip(pooled, mean, strict=True)]
        features = [*mean[:half], *deviation[:half], *mean[half:], *deviation[half:]]
        z = [(f - m) / s for f, m, s in zip(features, net.mean, net.spread, strict=True)]
        hidden = [np.tanh(sum(a * w for a, w in zip(z, column, strict=True)) + b) for column, b in zip(net.first.T, net.bias, strict=True)]
        logit = sum(h * w for h, w in zip(hidden, net.last, strict=True)) + net.offset
        assert abs(score - 1 / (1 + np.exp(-logit / net.temperature))) < 1e-5


def test_held_out_labels_teach_nothing(spark):
    """Other labels of held-out rows leave every score as it is."""
    rows, labels = corpus(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    turned = known.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(quality.classify(docs, known).collect()) == sorted(quality.classify(docs, turned).collect())


def test_word_vectors_equal_plain_sums(spark):
    texts = ["a b c a", "b", "", "c a  b\tA"]
    total = np.zeros((quality.WORDS, quality.DIMS))
    places, signs = quality._index_vectors()
    for text in texts:
        for slots in quality._slots(text.encode()):
            for i, w in enumerate(slots):
                for j, o in enumerate(slots):
                    if 0 < abs(i - j) <= quality.REACH:
                        np.add.at(total[w], places[o], signs[o])
    assert np.array_equal(quality.context_sums([t.encode() for t in texts]).reshape(total.shape), total)
    length = np.linalg.norm(total, axis=1, keepdims=True)
    found = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert np.allclose(found, total / np.where(length > 0, length, 1), atol=1e-6)
    many = [b"w%d" % (i % 7) for i in range((1 << 16) + 50)]
    halves = quality.context_sums([b" ".join(many)])
    assert halves.any()


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.classify(docs, none).collect()] == [0.5, 0.5]
    assert quality.classify(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(2, 1)], "doc_id long, quality int")
    assert all(r.score >= 0.5 for r in quality.classify(docs, one).collect())
