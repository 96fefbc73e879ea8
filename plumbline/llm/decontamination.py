"""Benchmark decontamination: pairs of words as seeds, counted per diagonal band, then Smith-Waterman alignment of words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.shingles import PlainWords

#: Items of fewer words match by themselves alone, word for word.
SEED_WORDS = 3
SIMILAR = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: How much oftener than the median of its item a place's pairs may stand before they are left out, where others suffice.
OFTEN = 4
#: Pairs of the test items that are looked for in one pass over the documents.
BLOCK_GRAMS = 1 << 20
#: Words of documents that are looked up at once.
CHUNK_WORDS = 1 << 17
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(score, end): the best local alignment of two word sequences, and where it ends in `text`.

    A row of the Smith-Waterman table at a time; gaps along the row come from a running maximum.
    """
    slope = np.arange(len(text) + 1) * -GAP
    above = np.zeros(len(text) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        row = np.maximum(above + GAP, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(text == word, MATCH, MISMATCH))
        above = np.maximum.accumulate(row + slope) - slope
        top = int(above.argmax())
        if above[top] > best:
            best, end = int(above[top]), top
    return best, end


def pairs(words: np.ndarray, apart: int) -> np.ndarray:
    """A number for each two words that stand 1 (next to each other) or 2 apart."""
    return words[:-apart] * _SPREAD + words[apart:]


class Items:
    """Some test items: their words, and all their pairs of words with the items and places they stand at.

    An alignment of score s holds at least s - 2 of weight in pairs: two words matched one after the other, with at
    most one word between them in the item and in the text, weigh 2 if there is none in either, else 1; further apart
    they cost what the second brings. Each place of the item begins one such pair at most. So a text holds pairs of
    the weight `least` at the item's places, and all on diagonals (text place - item place) less than `width` apart.
    """

    def __init__(self, rows: list[tuple[int | None, bytes]], size: int, similar: float):
        words = PlainWords()
        self.ids = [i for i, _ in rows]
        self.words = [words.of(t) for _, t in rows]
        self.least = np.ones(len(rows), np.int64)
        self.width = np.ones(len(rows), np.int64)
        # Items too short for seeds, by their word or their two words as a number.
        self.short: dict[int, dict[int, list[int]]] = {1: {}, 2: {}}
        grams, owners, places, apart = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, w in enumerate(self.words):
            if 0 < len(w) < max(size, 2) and len(w) <= 2:
                number = int((w if len(w) == 1 else pairs(w, 1))[0])
                self.short[len(w)].setdefault(number, []).append(k)
            elif len(w) >= 2:
                score = math.ceil(similar * MATCH * len(w) - 1e-9)
                self.least[k] = max(1, score - 2)
                self.width[k] = max(0, 2 * len(w) - score) + 1
                for d in (1, 2):
                    g = pairs(w, d)
                    grams.append(g)
                    owners.append(np.full(len(g), k))
                    places.append(np.arange(len(g)))
                    apart.append(np.full(len(g), d))
        self._sort(*map(np.concatenate, (grams, owners, places, apart)))

    def _sort(self, grams: np.ndarray, owners: np.ndarray, places: np.ndarray, apart: np.ndarray) -> None:
        order = np.argsort(grams, kind="stable")
        self.grams, self.owners, self.places, self.apart = grams[order], owners[order], places[order], apart[order]
        self.distinct, first = np.unique(self.grams, return_index=True)
        self.first = np.append(first, len(self.grams))

    def keep_rare(self, counts: np.ndarray) -> None:
        """Leaves out places whose pairs stand in more than OFTEN * (m + 1) documents, m being the item's median, the commonest first.

        A place left out may have brought a weight of 2, so as much less is asked of the others, and never less than 1:
        no alignment is lost, whatever the counts.
        """
        often = counts[np.searchsorted(self.distinct, self.grams)]
        order = np.lexsort((self.places, self.owners))
        ends = np.searchsorted(self.owners[order], np.arange(len(self.ids) + 1))
        kept = np.ones(len(self.grams), bool)
        for k in range(len(self.ids)):
            own = order[ends[k] : ends[k + 1]]
            if not len(own):
                continue
            most = np.zeros(len(self.words[k]), np.int64)
            np.maximum.at(most, self.places[own], often[own])
            common = np.argsort(-most[:-1], kind="stable")[: (self.least[k] - 1) // 2]
            common = common[most[common] > OFTEN * (np.median(most[:-1]) + 1)]
            self.least[k] -= 2 * len(common)
            kept[own[np.isin(self.places[own], common)]] = False
        self._sort(self.grams[kept], self.owners[kept], self.places[kept], self.apart[kept])


class Lookup:
    """Sorted numbers behind a table of their first bits, which most other numbers miss."""

    def __init__(self, wanted: np.ndarray):
        bits = min(24, max(12, int(len(wanted)).bit_length() + 4))
        self.wanted, self.shift = wanted, np.uint64(64 - bits)
        self.there = np.zeros(1 << bits, bool)
        self.there[wanted >> self.shift] = True

    def find(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where `numbers` are among the wanted: their places, and those in `wanted`."""
        at = np.flatnonzero(self.there[numbers >> self.shift])
        found = np.searchsorted(self.wanted, numbers[at])
        same = self.wanted[np.minimum(found, len(self.wanted) - 1)] == numbers[at]
        return at[same], found[same]


def document_counts(docs: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """In how many documents each of some pairs stands."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words, lookup = PlainWords(), Lookup(sent.value)
        total = np.zeros(len(lookup.wanted), np.int64)
        for batch in batches:
            for text in batch.column("text"):
                own = words.of(text.as_py() or b"")
                found = [lookup.find(pairs(own, d))[1] for d in (1, 2) if len(own) > d]
                if found:
                    total[np.unique(np.concatenate(found))] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["gram", "docs"])

    counted = docs.select("text").mapInArrow(count, "gram bigint, docs bigint").groupBy("gram").agg(F.sum("docs").alias("docs"))
    out = np.zeros(len(wanted), np.int64)
    for row in counted.collect():
        out[row["gram"]] = row["docs"]
    return out


def candidates(items: Items, lookup: Lookup, words: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(text, item, stretches of the text) where pairs weigh enough; `words` are those of texts one after another."""
    entries, places, weights = [], [], []
    for d in (1, 2):
        if len(words) <= d:
            continue
        at, gram = lookup.find(pairs(words, d))
        inside = np.searchsorted(ends, at, "right") == np.searchsorted(ends, at + d, "right")
        at, gram = at[inside], gram[inside]
        each = items.first[gram + 1] - items.first[gram]
        entry = np.arange(each.sum()) + np.repeat(items.first[gram] - np.cumsum(each) + each, each)
        entries.append(entry)
        places.append(np.repeat(at, each))
        weights.append(1 + (items.apart[entry] + d == 2))
    if not entries:
        return []
    entry, place, weight = map(np.concatenate, (entries, places, weights))
    text, item = np.searchsorted(ends, place, "right"), items.owners[entry]

    # Most texts have too little of an item anywhere.
    _, both = np.unique(text * len(items.ids) + item, return_inverse=True)
    enough = np.bincount(both, weight)[both] >= items.least[item]
    entry, place, weight, text, item = (x[enough] for x in (entry, place, weight, text, item))
    if not len(entry):
        return []

    # Bands of two widths, begun at each width: diagonals less than a width apart are in one band.
    offset, longest = items.places[entry], max(map(len, items.words))
    band = (place - offset + longest) // items.width[item]
    bands = (longest + len(words)) // int(items.width.min()) + 2
    key = np.concatenate([(text * len(items.ids) + item) * bands + band + 1, (text * len(items.ids) + item) * bands + band])
    groups, group = np.unique(key, return_inverse=True)
    best = np.unique((group * longest + np.tile(offset, 2)) * 2 + np.tile(weight, 2) - 1)
    last = np.append(best[1:] >> 1 != best[:-1] >> 1, True)
    weighed = np.bincount(best[last] // (2 * longest), best[last] % 2 + 1, len(groups))
    owner, band = np.divmod(groups, bands)
    text, item = np.divmod(owner, len(items.ids))
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    for n in np.flatnonzero(weighed >= items.least[item]).tolist():
        t, k, width = int(text[n]), int(item[n]), int(items.width[item[n]])
        begin = (int(band[n]) - 1) * width - longest
        stop = min(begin + 2 * width + len(items.words[k]), int(ends[t]))
        begin = max(begin, int(ends[t - 1]) if t else 0)
        if not out or out[-1][:2] != (t, k):
            out.append((t, k, [(begin, stop)]))
        elif begin <= out[-1][2][-1][1]:
            out[-1][2][-1] = out[-1][2][-1][0], stop
        else:
            out[-1][2].append((begin, stop))
    return out


def short_copies(items: Items, words: np.ndarray) -> list[tuple[int, int]]:
    """(item, end) of items of one or two words that stand in a text as they are: the first place of each."""
    out = []
    for length, numbers in items.short.items():
        if not numbers or len(words) < length:
            continue
        there = words if length == 1 else pairs(words, 1)
        for at in np.flatnonzero(np.isin(there, np.array(list(numbers), np.uint64))).tolist():
            out += [(k, at + length) for k in numbers[int(there[at])] if (items.words[k] == words[at : at + length]).all()]
    first: dict[int, int] = {}
    for k, end in out:
        first.setdefault(k, end)
    return list(first.items())


def find_copies(docs: DataFrame, items: Items, similar: float) -> DataFrame:
    """(doc_id, item_id, score, similarity, end_word) for one block of items."""
    sent = docs.sparkSession.sparkContext.broadcast(items)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        items = sent.value
        words, lookup = PlainWords(), Lookup(items.distinct)

        def met(numbers: list[int], held: list[np.ndarray]) -> Iterator[tuple]:
            told, ends = np.concatenate(held), np.cumsum([len(w) for w in held])
            for t, k, stretches in candidates(items, lookup, told, ends):
                item, begin = items.words[k], int(ends[t]) - len(held[t])
                best = max((align(item, told[a:b]) + (a,) for a, b in stretches), key=lambda x: x[0])
                if best[0] >= similar * MATCH * len(item):
                    yield numbers[t], items.ids[k], best[0], best[0] / (MATCH * len(item)), best[1] + best[2] - begin

        for batch in batches:
            rows: list[tuple] = []
            numbers, held, room = [], [], CHUNK_WORDS
            for n, text in enumerate(batch.column("text")):
                own = words.of(text.as_py() or b"")
                for k, end in short_copies(items, own):
                    rows.append((n, items.ids[k], MATCH * len(items.words[k]), 1.0, end))
                if len(own) < 2 or not len(items.grams):
                    continue
                numbers.append(n)
                held.append(own)
                room -= len(own)
                if room <= 0:
                    rows += met(numbers, held)
                    numbers, held, room = [], [], CHUNK_WORDS
            if held:
                rows += met(numbers, held)
            if rows:
                n, *columns = zip(*rows)
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                arrays = [batch.column("doc_id").take(pa.array(n)), *(pa.array(c, t) for c, t in zip(columns, types))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "score", "similarity", "end_word"])

    return docs.mapInArrow(search, f"doc_id {kind}, item_id bigint, score bigint, similarity double, end_word bigint")


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SEED_WORDS, similar: float = SIMILAR) -> DataFrame:
    """Copies of test items in documents, edited ones too: (doc_id, item_id, score, similarity, end_word).

    A row is returned if the best alignment (2 for a match, -1 for another word or a gap) has at least `similar` of the
    item's own score, which is 2 per word, wherever the edits are. `end_word` is where the alignment ends, in words of
    the document. Every such alignment holds enough pairs of the item's words, next to each other or one word apart, on
    near diagonals; where a document has so many, it is aligned with the item. Common pairs are left out as far as the
    others still show every alignment. This holds where `similar` asks for a score of 3 or more.

    Words are compared in lower case (A-Z) without punctuation around them. Null and empty texts match nothing. Items of one
    or two words, fewer than `size`, match where they stand word for word. Null ids stay null; repeated rows are matched each. Only `doc_id`,
    `item_id` and `text` are read. Items are taken in blocks of about a million pairs, each block in a pass
    over the documents that counts and one that finds; documents are never shuffled.
    """
    told = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    asked = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("binary").alias("text"))
    results: list[DataFrame] = []
    held: list[tuple[int | None, bytes]] = []

    def search() -> None:
        items = Items(held, size, similar)
        if len(items.grams):
            items.keep_rare(document_counts(told, items.distinct))
        if len(items.grams) or any(items.short.values()):
            results.append(find_copies(told, items, similar))

    room = BLOCK_GRAMS
    for row in asked.where("text IS NOT NULL").toLocalIterator():
        held.append((row["item_id"], bytes(row["text"])))
        room -= 2 * (row["text"].count(b" ") + 1)
        if room <= 0:
            search()
            held, room = [], BLOCK_GRAMS
    if held:
        search()
    if not results:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id bigint, score bigint, similarity double, end_word bigint")
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found
