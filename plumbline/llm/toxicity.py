"""Toxicity by subword bags: embeddings of character n-grams, averaged, under a linear softmax.

A word is the average of the embeddings of its n-grams, a window of words the average of its words, and a document
is as toxic as its worst window. Embeddings and softmax are trained together in numpy. Because
misspellings share most n-grams with the word they stand for, words never seen get scores too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.shared import SLICE_BYTES, held_out, labelled_sample

SIZES = (2, 3, 4, 5)
BUCKETS = 1 << 17
WIDTH = 8
WINDOW, STRIDE = 12, 6
#: Shorter bags count as bags of so many words.
LEAST_WORDS = 6
DECAY = 0.98
SAMPLE_PER_CLASS = 1500
SAMPLE_CHARS = 1 << 14
EPOCHS = 25
THRESHOLD = 0.7
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _hash(data: np.ndarray, size: int) -> np.ndarray:
    """A bucket for each run of `size` bytes."""
    n = len(data) - size + 1
    value = np.full(n, size, np.uint32)
    for k in range(size):
        value = (value ^ data[k : n + k]) * np.uint32(0x01000193)
        value ^= value >> np.uint32(15)
    return value & np.uint32(BUCKETS - 1)


def ngrams(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket, word, words): the n-grams of a text's words, each word with a blank on both sides, by word."""
    data = np.frombuffer(b" " + text + b" ", np.uint8)
    blank = _BLANK[data]
    data = np.where(blank, 32, data).astype(np.uint32)
    starts = ~blank & np.concatenate([[True], blank[:-1]])
    words = int(starts.sum())
    # A blank belongs to the word before it; its n-grams that begin there belong to the word after.
    word = np.cumsum(starts) - 1
    word[blank] += 1
    blanks = np.concatenate([[0], np.cumsum(blank)])
    buckets, owners = [], []
    for size in SIZES:
        n = len(data) - size + 1
        if n <= 0:
            continue
        first = np.arange(n)
        # No blank inside; a pair is not two blanks.
        if size == 2:
            good = ~(blank[:n] & blank[1:])
        else:
            good = blanks[first + size - 1] == blanks[first + 1]
        first = first[good]
        buckets.append(_hash(data, size)[first])
        owners.append(word[first])
    return np.concatenate(buckets or [np.empty(0, np.uint32)]), np.concatenate(owners or [np.empty(0, np.int64)]), words


def word_numbers(text: bytes) -> np.ndarray:
    """A number for each word, equal for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in text.split()), np.int64)


def windows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, fresh): overlapping windows of words, together holding every word, as rows of positions.

    `fresh` is false where a word repeats one before it in its window (a window is a bag of different
    words) and where a short text leaves a window unfilled.
    """
    n = len(words)
    starts = np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW) if n > WINDOW else np.zeros(1, np.int64)
    positions = starts[:, None] + np.arange(WINDOW)
    inside = positions < n
    positions = np.minimum(positions, max(n - 1, 0))
    held = np.where(inside, words[positions] if n else -1, -1)
    order = np.argsort(held, 1, kind="stable")
    ordered = np.take_along_axis(held, order, 1)
    first = np.ones_like(inside)
    first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    fresh = np.empty_like(inside)
    np.put_along_axis(fresh, order, first, 1)
    return positions, fresh & inside


def word_scores(text: bytes, values: np.ndarray) -> np.ndarray:
    """The average value of each word's n-grams."""
    buckets, owners, words = ngrams(text)
    counts = np.bincount(owners, minlength=words)[:words]
    return np.bincount(owners, values[buckets], minlength=words)[:words] / np.maximum(counts, 1)


def worst_window(text: bytes, values: np.ndarray) -> float:
    """The highest average over a window's different words; an empty text has 0."""
    scores = word_scores(text, values)
    if not len(scores):
        return 0.0
    positions, fresh = windows(word_numbers(text))
    return float(((scores[positions] * fresh).sum(1) / np.maximum(fresh.sum(1), LEAST_WORDS)).max())


class SubwordModel:
    """Bucket embeddings and the two columns of a softmax."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embeddings = rng.normal(0, 0.02, (BUCKETS, WIDTH))
        self.softmax = rng.normal(0, 0.5, (WIDTH, 2))
        self.bias = 0.0

    def values(self) -> np.ndarray:
        """What each bucket adds to the log odds of toxic."""
        return self.embeddings @ (self.softmax[:, 1] - self.softmax[:, 0])

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 12.0, seed: int = 7) -> None:
        """Train on the currently worst window of each text, with both classes weighing the same."""
        rng = np.random.default_rng(seed)
        split = [t.split() for t in texts]
        vocabulary = {w: i for i, w in enumerate(sorted({w for t in split for w in t}))}
        buckets, owners, n_words = ngrams(b" ".join(vocabulary))
        order = np.argsort(owners, kind="stable")
        buckets, owners = buckets[order].astype(np.int64), owners[order]
        first = np.searchsorted(owners, np.arange(n_words + 1))
        grams = np.diff(first)
        rows, fresh, texts_of = [], [], []
        for i, t in enumerate(split):
            words = np.fromiter((vocabulary[w] for w in t), np.int64, len(t))
            if len(words):
                positions, new = windows(words)
                rows.append(words[positions])
                fresh.append(new)
                texts_of.append(np.full(len(positions), i))
        if not rows:
            return
        rows, fresh, texts_of = np.concatenate(rows), np.concatenate(fresh), np.concatenate(texts_of)
        begins = np.flatnonzero(np.diff(texts_of, prepend=-1))
        spread = np.maximum(fresh.sum(1), LEAST_WORDS)
        weigh = len(labels) / (2.0 * np.maximum(np.bincount(labels, minlength=2), 1))
        ends = np.append(begins[1:], len(rows))
        for epoch in range(epochs):
            scores = np.bincount(owners, self.values()[buckets], minlength=n_words) / np.maximum(grams, 1)
            means = (scores[rows] * fresh).sum(1) / spread
            if epoch:
                tops = np.maximum.reduceat(means, begins)
                worst = np.flatnonzero(means == np.repeat(tops, ends - begins))
                worst = worst[np.unique(texts_of[worst], return_index=True)[1]]
            else:
                worst = begins + (rng.random(len(begins)) * (ends - begins)).astype(np.int64)
            for part in np.array_split(rng.permutation(worst), max(1, len(worst) // 64)):
                window, slot = np.nonzero(fresh[part])
                words = rows[part][window, slot]
                weight = 1.0 / (spread[part][window] * np.maximum(grams[words], 1))
                lengths = grams[words]
                at = buckets[np.repeat(first[words] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())]
                owner, weight = np.repeat(window, lengths), np.repeat(weight, lengths)
                direction = self.softmax[:, 1] - self.softmax[:, 0]
                logits = np.bincount(owner, weight * (self.embeddings[at] @ direction), minlength=len(part)) + self.bias
                known = labels[texts_of[part]]
                error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - known) * weigh[known]
                # The gradient of an embedding is along `direction`: one number per bucket says how much.
                used, back = np.unique(at, return_inverse=True)
                slope = np.bincount(back, weight * error[owner])
                towards = slope @ self.embeddings[used]
                self.embeddings[used] -= rate * slope[:, None] * direction
                self.softmax[:, 1] -= 0.002 * rate * towards / len(part)
                self.softmax[:, 0] += 0.002 * rate * towards / len(part)
                self.bias -= 0.1 * error.sum() / len(part)
            self.embeddings *= DECAY


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, max_chars: int = SAMPLE_CHARS) -> SubwordModel:
    """Fit on at most `per_class` labelled documents of each class, none of them held out or over `max_chars`."""
    rows = labelled_sample(docs, labels, "toxic", per_class, max_chars).collect()
    model = SubwordModel()
    if rows:
        model.fit([r["text"].lower().encode() for r in rows], np.array([r["label"] for r in rows]))
    return model


def segments(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about a megabyte; each begins WINDOW words before the last one's end."""
    begin, n = 0, len(text)
    while n - begin > 2 * SLICE_BYTES:
        end = begin + SLICE_BYTES
        while end < n and not _BLANK[text[end]]:
            end += 1
        yield text[begin:end]
        again = text[max(begin, end - 64 * WINDOW) : end].split()[-WINDOW:]
        back = sum(map(len, again)) + len(again)
        begin = max(end - back, begin + SLICE_BYTES // 2)
    yield text[begin:]


def score_toxicity(docs: DataFrame, model: SubwordModel, threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text: (doc_id, held_out, score, predicted).

    One row per row of `docs`. A null or empty text gets the score of a window without words; a null id is
    not held out. Only `doc_id` and `text` are read. No shuffle: the model (a number per bucket) is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.values().astype(np.float64), model.bias))

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        values, bias = sent.value
        for batch in batches:
            scores = []
            for text in batch.column("text").to_pylist():
                parts = segments((text or "").lower().encode())
                worst = max(worst_window(p, values) for p in parts) + bias
                scores.append(float(1 / (1 + np.exp(-np.clip(worst, -40, 40)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    narrow = docs.select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    scored = narrow.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on `labels.toxic`, then score every document. Training runs at once, in the driver."""
    return score_toxicity(docs, train(docs, labels))
