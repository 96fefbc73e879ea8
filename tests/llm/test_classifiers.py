"""Classifiers: held-out accuracy, unseen misspellings, long and empty texts."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from plumbline.llm import quality, toxicity

SYLLABLES = ["ka", "lo", "mi", "ter", "dan", "us", "ven", "or", "sil", "pe"]
BAD = ["grobnik", "fexalot", "ploonter"]


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(600):
        words = prose(rng, rng.randrange(20, 200)).split()
        toxic, junk = i % 5 == 0, i % 4 == 0
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        text = " ".join(w + "$$#" if junk else w for w in words)
        docs.append((i, text, 0.5, "x"))
        labels.append((i, int(not junk), int(toxic), "x"))
    docs += [(None, "no id", 0.5, "x"), (9000, None, 0.5, "x"), (9001, "", 0.5, "x"), (9002, prose(rng, 200000), 0.5, "x"), (0, "repeated id", 0.5, "x")]
    labels += [(None, 1, 1, "x"), (7000, 1, 0, "x"), (1, None, None, "x")]
    return docs, labels


def frames(spark, corpus):
    docs, labels = corpus
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, score double, label string"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, label string"),
    )


@pytest.mark.parametrize("column, classify, cut", [(1, quality.classify_quality, 0.5), (2, toxicity.classify_toxicity, 0.7)])
def test_held_out(spark, corpus, column, classify, cut):
    docs, labels = frames(spark, corpus)
    rows = classify(docs, labels).collect()
    assert len(rows) == len(corpus[0])
    known = {r[0]: r[column] for r in corpus[1]}
    right = []
    for r in rows:
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1
        assert r.held_out == held and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        if held and r.doc_id < 600 and known[r.doc_id] is not None:
            right.append(r.predicted == known[r.doc_id])
    assert np.mean(right) > 0.95
    assert classify(docs.limit(0), labels).count() == 0
    assert classify(docs.limit(3), labels.limit(0)).count() == 3


def test_misspellings_share_vectors(corpus):
    docs, labels = corpus
    model = toxicity.SubwordModel()
    texts = [t.lower().encode() for _, t, _, _ in docs[:600]]
    model.fit(texts, np.array([r[2] for r in labels[:600]]))
    values = model.values()
    plain = prose(random.Random(1), 11)
    for word in ("grobnick", "fexxalot", "plunter"):
        dirty, clean = (toxicity.worst_window(f"{plain} {w}".encode(), values) for w in (word, "kalomi"))
        assert dirty > clean


def test_long_texts_are_read_to_the_end():
    values = np.zeros(toxicity.BUCKETS)
    values[toxicity.ngrams(b"grobnik")[0]] = 1.0
    text = b"lo mi " * 600000 + b"grobnik"
    parts = list(toxicity.segments(text))
    assert len(parts) > 1 and max(toxicity.worst_window(p, values) for p in parts) > 0
    joined = set(b" ".join(parts).split())
    assert joined == {b"lo", b"mi", b"grobnik"}
    starts = quality.chunk_starts(5000)
    assert starts[0] == 0 and starts[-1] + quality.CHUNK == 5000 and (np.diff(starts) <= quality.CHUNK - quality.OVERLAP).all()


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    network = quality.ByteNetwork()
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    chunks = rng.integers(0, 256, (3, quality.CHUNK)).astype(np.int16)
    known, weight = np.array([0, 1, 1]), np.array([0.5, 1.0, 2.0])

    def loss():
        z = network.logits(chunks)
        return float((weight * (np.log1p(np.exp(z)) - known * z)).sum())

    gradients = network.gradients(chunks, known, weight)
    for name, g in gradients.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        own = network.weights[name]
        own[at] += 1e-6
        above = loss()
        own[at] -= 2e-6
        below = loss()
        own[at] += 1e-6
        assert abs((above - below) / 2e-6 - g[at]) < 1e-3 * max(1, abs(g[at])), name
