"""Quality by a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of bytes that together hold all of it. Bytes are embedded, learned
filters slide over each chunk, and each filter's largest answer in the chunk is kept. A hidden layer and a
logistic unit score the chunk; the document's log odds are the average over its chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.shared import held_out, labelled_sample

CHUNK, OVERLAP = 1024, 128
REACH, STRIDE = 8, 2
EMBEDDING, FILTERS, HIDDEN = 8, 48, 24
SAMPLE_PER_CLASS = 2000
SAMPLE_CHARS = 1 << 15
SAMPLE_CHUNKS = 3
EPOCHS = 12
THRESHOLD = 0.5
BATCH = 64
#: The symbol behind a text's end, where a chunk is not filled.
PAD = 256


def chunk_starts(n: int) -> np.ndarray:
    """Where chunks of a text of `n` bytes begin: every byte lies in a chunk, the last one ends with the text."""
    if n <= CHUNK:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - CHUNK, CHUNK - OVERLAP), n - CHUNK)


def chunks_of(text: bytes, starts: np.ndarray) -> np.ndarray:
    """Rows of symbols (0-255 for bytes, PAD behind the end)."""
    data = np.frombuffer(text, np.uint8).astype(np.int16)
    if len(data) < CHUNK:
        data = np.concatenate([data, np.full(CHUNK - len(data), PAD, np.int16)])
    return data[starts[:, None] + np.arange(CHUNK)]


class ByteNetwork:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.weights = {
            "bytes": draw(257, EMBEDDING, scale=0.5),
            "filters": draw(REACH * EMBEDDING, FILTERS, scale=(REACH * EMBEDDING) ** -0.5),
            "filters_bias": np.zeros(FILTERS, np.float32),
            "hidden": draw(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": draw(HIDDEN, scale=HIDDEN**-0.5),
            "out_bias": np.zeros(1, np.float32),
        }
        self.weights["bytes"][PAD] = 0

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """All filter inputs: (chunk, position, REACH * EMBEDDING), laid out for one matrix product."""
        embedded = self.weights["bytes"][chunks]
        flat = embedded.reshape(len(chunks), -1)
        view = np.lib.stride_tricks.sliding_window_view(flat, REACH * EMBEDDING, axis=1)
        return np.ascontiguousarray(view[:, :: STRIDE * EMBEDDING])

    def forward(self, chunks: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        inputs = self.windows(chunks)
        answers = inputs @ w["filters"]
        best = answers.argmax(1)
        pooled = np.take_along_axis(answers, best[:, None, :], 1)[:, 0] + w["filters_bias"]
        lifted = np.maximum(pooled, 0)
        hidden = np.maximum(lifted @ w["hidden"] + w["hidden_bias"], 0)
        return {"inputs": inputs, "best": best, "pooled": pooled, "lifted": lifted, "hidden": hidden, "logits": hidden @ w["out"] + w["out_bias"]}

    def logits(self, chunks: np.ndarray) -> np.ndarray:
        w = self.weights
        pooled = (self.windows(chunks) @ w["filters"]).max(1) + w["filters_bias"]
        hidden = np.maximum(np.maximum(pooled, 0) @ w["hidden"] + w["hidden_bias"], 0)
        return hidden @ w["out"] + w["out_bias"]

    def gradients(self, chunks: np.ndarray, known: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the logistic loss of some chunks, each with its label and weight."""
        w, f = self.weights, self.forward(chunks)
        slope = ((1 / (1 + np.exp(-np.clip(f["logits"], -30, 30))) - known) * weight).astype(np.float32)
        d_hidden = np.outer(slope, w["out"]) * (f["hidden"] > 0)
        d_pooled = d_hidden @ w["hidden"].T * (f["pooled"] > 0)
        # Only the winning position of each filter passes its slope on.
        won = f["inputs"][np.arange(len(chunks))[:, None], f["best"]]
        d_won = d_pooled[:, :, None] * w["filters"].T[None]
        symbols = chunks[np.arange(len(chunks))[:, None, None], f["best"][:, :, None] * STRIDE + np.arange(REACH)]
        d_bytes = np.zeros_like(w["bytes"])
        np.add.at(d_bytes, symbols.ravel(), d_won.reshape(-1, EMBEDDING))
        d_bytes[PAD] = 0
        return {
            "out": f["hidden"].T @ slope,
            "out_bias": np.array([slope.sum()], np.float32),
            "hidden": f["lifted"].T @ d_hidden,
            "hidden_bias": d_hidden.sum(0),
            "filters": np.einsum("nfk,nf->kf", won, d_pooled),
            "filters_bias": d_pooled.sum(0),
            "bytes": d_bytes,
        }

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.004, seed: int = 3) -> None:
        """Adam on a few chunks of each text, drawn anew in each epoch; both classes weigh the same."""
        rng = np.random.default_rng(seed)
        weigh = len(labels) / (2.0 * np.maximum(np.bincount(labels, minlength=2), 1))
        means = {k: np.zeros_like(v) for k, v in self.weights.items()}
        squares = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        starts = [chunk_starts(len(t)) for t in texts]
        for epoch in range(epochs):
            pace = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            picked, owners = [], []
            for i, (text, where) in enumerate(zip(texts, starts)):
                some = where if len(where) <= SAMPLE_CHUNKS else rng.choice(where, SAMPLE_CHUNKS, replace=False)
                picked.append(chunks_of(text, some))
                # And a short extract, so that shortness alone speaks for neither class.
                begin, length = int(rng.integers(max(1, len(text) - 12))), int(rng.integers(12, 400))
                picked.append(chunks_of(text[begin : begin + length], np.zeros(1, np.int64)))
                owners.append(np.full(len(some) + 1, i))
            picked, owners = np.concatenate(picked), np.concatenate(owners)
            share = 1.0 / np.bincount(owners, minlength=len(texts))
            order = rng.permutation(len(picked))
            for rows in np.array_split(order, max(1, len(order) // BATCH)):
                known = labels[owners[rows]]
                weight = weigh[known] * share[owners[rows]] / len(rows)
                step += 1
                for name, g in self.gradients(picked[rows], known, weight).items():
                    means[name] = 0.9 * means[name] + 0.1 * g
                    squares[name] = 0.99 * squares[name] + 0.01 * g * g
                    top = means[name] / (1 - 0.9**step)
                    self.weights[name] -= (pace * top / (np.sqrt(squares[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def probability(self, text: bytes) -> float:
        """Of label 1, from all chunks of the text, some at a time."""
        starts = chunk_starts(len(text))
        total = sum(float(self.logits(chunks_of(text, part)).sum()) for part in np.array_split(starts, -(-len(starts) // BATCH)))
        return float(1 / (1 + np.exp(-np.clip(total / len(starts), -40, 40))))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, max_chars: int = SAMPLE_CHARS) -> ByteNetwork:
    """Fit on at most `per_class` labelled documents of each class, none of them held out or over `max_chars`."""
    rows = labelled_sample(docs, labels, "quality", per_class, max_chars).collect()
    network = ByteNetwork()
    if rows:
        network.fit([r["text"].encode() for r in rows], np.array([r["label"] for r in rows]))
    return network


def score_quality(docs: DataFrame, network: ByteNetwork, threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text: (doc_id, held_out, score, predicted).

    One row per row of `docs`. A null or empty text is one chunk without bytes; a null id is not held out.
    Only `doc_id` and `text` are read. No shuffle: the weights are broadcast, a few kilobytes.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network.weights)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = ByteNetwork()
        own.weights = sent.value
        for batch in batches:
            scores = [own.probability(t.as_py() or b"") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    narrow = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    scored = narrow.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, network: ByteNetwork, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text scores `threshold` or more. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(network.weights)

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = ByteNetwork()
        own.weights = sent.value
        for batch in batches:
            texts = (t.as_py() or b"" for t in batch.column("text").cast(pa.binary()))
            yield batch.filter(pa.array([own.probability(t) >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on `labels.quality`, then score every document. Training runs at once, in the driver."""
    return score_quality(docs, train(docs, labels))
