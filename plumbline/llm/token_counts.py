"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, functions as F

from plumbline.llm.shared import pieces, vocabulary

#: Fixed by the vocabulary files: how bytes are written as characters (the printable ones stand for themselves).
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_alphabet() -> list[str]:
    """The character each byte is written as: itself if printable, else the next free one from U+0100."""
    shown, free = set(_PRINTABLE), iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


def _pair(merge) -> list[str]:
    return merge.split(" ") if isinstance(merge, str) else merge


def merge_tables(spec: str) -> dict:
    """What counting needs of a tokenizer file, in plain structures: symbols are numbers.

    `merges` holds (left, right, whole) by rank; `ranks` holds, for each left symbol, its right symbols with
    the rank of the pair.
    """
    parsed = json.loads(spec)
    model = parsed["model"]
    suffix = model.get("end_of_word_suffix") or ""
    numbers: dict[str, int] = {}
    number = lambda symbol: numbers.setdefault(symbol, len(numbers))
    alphabet = byte_alphabet()
    tables = {
        "inner": [number(c) for c in alphabet],
        "last": [number(c + suffix) for c in alphabet],
        "merges": [(number(x), number(y), number(x + y)) for x, y in map(_pair, model["merges"])],
        "split": next(p for p in parsed["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"],
        "special": sorted((t["content"] for t in parsed["added_tokens"]), key=len, reverse=True),
    }
    tables["ranks"] = [{} for _ in numbers]
    for rank, (left, right, _) in enumerate(tables["merges"]):
        tables["ranks"][left][right] = rank
    return tables


class MergeCounter:
    """Counts the tokens of pieces of text; remembers short words and pieces, up to a bounded number."""

    def __init__(self, tables: dict, remembered: int = 1 << 19):
        import regex

        self.inner, self.last = tables["inner"], tables["last"]
        self.merges, self.ranks = tables["merges"], tables["ranks"]
        self.words = regex.compile(tables["split"].replace(r"^\s", r"^\p{White_Space}"))
        self.special = regex.compile("|".join(map(regex.escape, tables["special"])))
        self.mark = os.path.commonprefix(tables["special"])
        self.most = remembered
        self.known_words: dict[str, int] = {}
        self.known: dict[bytes, int] = _Counts(self, remembered)

    def merged(self, word: bytes) -> int:
        """Initial symbols minus merges: the lowest rank goes first, the leftmost of equals before the others."""
        n = len(word)
        if n == 1:
            return 1
        inner, ranks, merges = self.inner, self.ranks, self.merges
        symbols = [inner[b] for b in word]
        symbols[-1] = self.last[word[-1]]
        shift = n.bit_length()
        mask = (1 << shift) - 1
        heap = []
        left = symbols[0]
        for i in range(1, n):
            right = symbols[i]
            rank = ranks[left].get(right)
            if rank is not None:
                heap.append(rank << shift | (i - 1))
            left = right
        if not heap:
            return n
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        count = n
        while heap:
            entry = heappop(heap)
            i = entry & mask
            j = after[i]
            left, right, whole = merges[entry >> shift]
            # Stale, if either symbol has been merged since the pair was pushed.
            if j >= n or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i] = whole
            symbols[j] = -1
            k = after[i] = after[j]
            count -= 1
            if k < n:
                before[k] = i
                rank = ranks[whole].get(symbols[k])
                if rank is not None:
                    heappush(heap, rank << shift | i)
            h = before[i]
            if h >= 0:
                rank = ranks[symbols[h]].get(whole)
                if rank is not None:
                    heappush(heap, rank << shift | h)
        return count

    def word(self, word: str) -> int:
        n = self.known_words.get(word)
        if n is None:
            n = self.merged(word.encode())
            if len(word) <= 64:
                if len(self.known_words) >= self.most:
                    self.known_words.clear()
                self.known_words[word] = n
        return n

    def plain(self, text: str) -> int:
        if not text.isascii():
            # Lowered character by character, as the library does: a final sigma is no special case.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if text.isalpha():
            return self.word(text)
        if text[-1:] in ".,!" and text[:-1].isalpha():
            return self.word(text[:-1]) + self.word(text[-1])
        return sum(map(self.word, self.words.findall(text)))

    def piece(self, text: str) -> int:
        if self.mark not in text:
            return self.plain(text)
        total, at = 0, 0
        for found in self.special.finditer(text):
            total += self.plain(text[at : found.start()]) + 1
            at = found.end()
        return total + self.plain(text[at:])

    def count(self, text: bytes) -> int:
        return sum(sum(map(self.known.__getitem__, part)) for part in pieces(text))


class _Counts(dict):
    """Piece to tokens; forgets everything when full, and never keeps long pieces."""

    def __init__(self, counter: MergeCounter, most: int):
        self.counter, self.most = counter, most

    def __missing__(self, piece: bytes) -> int:
        n = self.counter.piece(piece.decode())
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = n
        return n


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """Tokens of each whole text: (doc_id, n_bytes, n_tokens, over_limit).

    One row per row of `docs`, in any order; ids may be null or repeat. A null text counts as empty (0
    bytes, 0 tokens). Only `doc_id` and `text` are read, so further columns may have any names. No shuffle:
    texts are counted where they are read. Pieces between blanks are counted once and remembered, up to a
    bounded number, because no token of these vocabularies spans a blank.
    """
    tables = docs.sparkSession.sparkContext.broadcast(merge_tables(vocabulary(tokenizer_path)))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = MergeCounter(tables.value)
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column("text")]
            tokens = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(tokens, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    narrow = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    counted = narrow.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
