"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is spelled in bits: each word is its bytes and a blank, the text's end one byte more, and a byte is the bits of its
prefix code. Every bit is predicted from counts of the training texts under several hashed contexts (the last 1, 2, 3 and 5
bytes within the word, and the place in the byte's code). The predictions are mixed in the logistic domain with
weights of the document, one set per length of the word before (the gate). A word's spelled probability is then refined
adaptively: it is mixed with the word's share of all training words, the dictionary, and with its share of the document's words so
far. Weights and the shares of this last mix learn online, block after block of the document's own words, whose sizes double
from 32 to 1024. Every document starts from the same state, so scores depend on the training texts and its own words before alone.

How the corpus is gathered: tasks number the words of blocks of about 16 MB of texts, count them, and pack each text as the
numbers of its words, so a word is cut out and looked up once. Counts are summed per word over all blocks (one row per block and
word, and so the tables grow with the corpus) and go back to the blocks.
The bit predictors are summed from the distinct words into tables of fixed numbers of slots, 7 MB in all once they are probabilities;
only these are broadcast.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.llm.shared import pieces
from plumbline.session import settle

BLOCK_BYTES = 16 << 20
PAYLOAD_BYTES = 1 << 20
#: A longer word is spelled in pieces of this length and stands in no dictionary.
LONGEST = 64
#: Bytes of context, and log2 of the slots, of each predictor.
ORDERS = ((1, 16), (2, 20), (3, 21), (5, 22))
FRAGMENT = 16
COUNTING_TASKS = 256
#: A slot's prediction is ln((ones + PRIOR) / (zeros + PRIOR)), kept in 1/STRETCH as one byte.
PRIOR, STRETCH = 0.1, 12.0
GATES = 8
FIRST_WEIGHT, RATE, DAMPING = 0.35, 0.6, 24.0
#: First shares of spelling, of the dictionary and of the document's own words so far, and what they count as, in words.
SHARES, SHARES_PRIOR = (0.2, 0.55, 0.25), 6.0
FIRST_WORDS, MOST_WORDS = 32, 1024
#: Words that the array operations take at once, about.
AT_ONCE = 1 << 14
SPELLED = 1 << 13
END, _PIECE = b"\n", b"\t"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BLOCKS = "block bigint, word binary, number int, n bigint, payload binary"
_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"


def units_of(word: bytes) -> list[bytes]:
    """The keys a word is counted and spelled by: itself, or for a long one its digest and its pieces.

    A digest starts with a line feed, a piece with a tab, so neither is a word.
    """
    if len(word) <= LONGEST:
        return [word]
    spelled = word + b" "
    digest = END + hashlib.blake2b(word, digest_size=24).digest()
    return [digest, *(_PIECE + spelled[k : k + LONGEST] for k in range(0, len(spelled), LONGEST))]


def spelled(key: bytes) -> bytes:
    if key[:1] == _PIECE:
        return key[1:]
    if key[:1] == END:
        return key if key == END else b""
    return key + b" "


def numbered(text: bytes, numbers: dict[bytes, int]) -> np.ndarray:
    """Numbers of a text's words and its end."""
    out = []
    for part in pieces(text):
        if len(max(part, key=len, default=b"")) > LONGEST:
            part = [u for w in part for u in units_of(w)]
        out.append(np.fromiter(map(numbers.__getitem__, part), np.int32, len(part)))
    out.append(np.array([numbers[END]], np.int32))
    return np.concatenate(out)


def counts_as_token(key: bytes) -> bool:
    return key[:1] != _PIECE


def held_out(doc_id: int | None) -> bool:
    """Documents the model may not learn from; a null id is learned from."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def pack_units(ids: list[int | None], units: list[np.ndarray]) -> bytes:
    import zstandard

    head = struct.pack("<I", len(ids)) + bytes(i is not None for i in ids) + np.array([i or 0 for i in ids], "<i8").tobytes()
    # Most numbers are small: their bytes lie plane by plane, so that the upper ones pack well.
    planes = np.concatenate(units).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, np.array([len(u) for u in units], "<i8").tobytes(), planes]))


def unpack_units(payload: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(payload)
    (n,) = struct.unpack_from("<I", raw)
    ids, sizes = np.frombuffer(raw, "<i8", n, 4 + n).tolist(), np.frombuffer(raw, "<i8", n, 4 + 9 * n)
    flat = np.ascontiguousarray(np.frombuffer(raw, np.uint8, -1, 4 + 17 * n).reshape(4, -1).T).view("<i4").reshape(-1)
    return [i if raw[4 + k] else None for k, i in enumerate(ids)], np.split(flat, np.cumsum(sizes)[:-1])


def blocks_of(docs: DataFrame) -> DataFrame:
    """(block, word, number, n, payload): per block its words, numbered, with their training counts, and its texts as these numbers."""

    def gather(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        # A word not seen before in the block gets the next number.
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        counts = np.zeros(0, np.int64)
        ids: list[int | None] = []
        units: list[np.ndarray] = []
        held = packed = 0

        def rows(words: list[bytes | None], number: list[int | None], n: list[int | None], payload: list[bytes | None]):
            columns = ([block] * len(words), words, number, n, payload)
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "word", "number", "n", "payload"])

        def packed_texts():
            nonlocal counts
            counts = np.append(counts, np.zeros(len(numbers) - len(counts), np.int64))
            learned = [u for i, u in zip(ids, units) if not held_out(i)]
            if learned:
                counts += np.bincount(np.concatenate(learned), minlength=len(counts))
            return rows([None], [None], [None], [pack_units(ids, units)])

        def words():
            known = list(numbers)
            for k in range(0, len(known), 1 << 15):
                part = known[k : k + (1 << 15)]
                yield rows(part, range(k, k + len(part)), counts[k : k + len(part)], [None] * len(part))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                low = (text.as_py() or b"").lower()
                ids.append(doc_id)
                units.append(numbered(low, numbers))
                held += len(low) + 64
                packed += len(low) + 64
                if packed >= PAYLOAD_BYTES:
                    yield packed_texts()
                    ids, units, packed = [], [], 0
                if held >= BLOCK_BYTES:
                    if ids:
                        yield packed_texts()
                    yield from words()
                    numbers.clear()
                    counts, ids, units, held, packed = np.zeros(0, np.int64), [], [], 0, 0
                    block += 1
        if ids:
            yield packed_texts()
        yield from words()

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(gather, _BLOCKS)


class ByteCode:
    """A prefix code for bytes from their counts: the inner nodes and the bits on the way to each byte."""

    def __init__(self, counts: list[int]):
        heap = [(n + 1, k, k) for k, n in enumerate(counts)]
        heapq.heapify(heap)
        parent, side = {}, {}
        for node in range(256, 511):
            (less, _, zero), (more, _, one) = heapq.heappop(heap), heapq.heappop(heap)
            parent |= {zero: node, one: node}
            side |= {zero: 0, one: 1}
            heapq.heappush(heap, (less + more, node, node))
        nodes, bits, self.lengths = [], [], np.zeros(256, np.int64)
        for byte in range(256):
            way, at = [], byte
            while at in parent:
                way.append((parent[at] - 256, side[at]))
                at = parent[at]
            nodes += [n for n, _ in reversed(way)]
            bits += [b for _, b in reversed(way)]
            self.lengths[byte] = len(way)
        self.nodes, self.bits = np.array(nodes, np.uint64), np.array(bits, np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the given ranges, one range after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Speller:
    """Bits of words with their slots in the predictors' tables."""

    def __init__(self, code: ByteCode):
        self.code = code

    def lengths(self, told: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Bits of each word, as it is spelled."""
        bits = self.code.lengths[np.frombuffer(b"".join(told), np.uint8)]
        ends = np.cumsum(sizes)
        total = np.concatenate([[0], np.cumsum(bits)])
        return total[ends] - total[ends - sizes]

    def spell(self, keys: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(bit, slots of each predictor, number of the word) for all bits of the words."""
        told = list(map(spelled, keys))
        sizes = np.array([len(t) for t in told], np.int64)
        raw = np.frombuffer(b"".join(told), np.uint8)
        owner = np.repeat(np.arange(len(keys)), sizes)
        place = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        opening = np.array([1 if k[:1] == _PIECE else 0 for k in keys], np.uint64)[owner]
        before = []
        for k in range(1, max(order for order, _ in ORDERS) + 1):
            shifted = np.zeros(len(raw), np.uint64)
            shifted[k:] = raw[:-k] if k < len(raw) + 1 else 0
            before.append(np.where(place >= k, shifted[: len(raw)], opening))
        lengths = self.code.lengths[raw]
        byte = np.repeat(np.arange(len(raw)), lengths)
        step = ranges(self.code.starts[raw], lengths)
        node, spread_node = self.code.nodes[step], (self.code.nodes * _SPREAD)[step]
        slots = []
        context, known = np.zeros(len(raw), np.uint64), 0
        for order, log2 in ORDERS:
            for k in range(known, order):
                context = context << np.uint64(8) | before[k]
            known = order
            # A place in the code is below 256, so context and place are spread one by one, the context once per byte.
            plain = 8 * (order + 1) <= log2
            full = np.repeat((context << np.uint64(8)) * (np.uint64(1) if plain else _SPREAD), lengths)
            full += node if plain else spread_node
            slots.append((full if plain else full >> np.uint64(64 - log2)).view(np.int64))
        return self.code.bits[step], slots, owner[byte]


def predictor_tables(types: DataFrame, code: ByteCode) -> list[np.ndarray]:
    """Per order, the prediction of every slot as a byte, from distinct words (word, c).

    At most COUNTING_TASKS tasks sum over the words; each sends its tables in compressed fragments, which are added up
    fragment by fragment. Only the finished predictions reach the driver, a byte per slot.
    """

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        speller = Speller(code)
        tables = [np.zeros((2, 1 << log2), np.int64) for _, log2 in ORDERS]
        for batch in batches:
            keys, times = batch.column("word").to_pylist(), np.array(batch.column("c").to_pylist(), np.int64)
            for k in range(0, len(keys), SPELLED):
                bit, slots, owner = speller.spell(keys[k : k + SPELLED])
                weights = times[k:][owner]
                for table, slot in zip(tables, slots):
                    np.add.at(table.reshape(-1), slot + bit.astype(np.int64) * table.shape[1], weights)
        pack = zstandard.ZstdCompressor(level=1)
        for k, table in enumerate(tables):
            for f in range(table.shape[1] >> FRAGMENT):
                part = table[:, f << FRAGMENT : (f + 1) << FRAGMENT]
                if part.any():
                    raw = np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8).T.tobytes()
                    columns = [pa.array([k], pa.int32()), pa.array([f], pa.int32()), pa.array([pack.compress(raw)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["predictor", "fragment", "counts"])

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        key, total = None, None

        def done():
            zeros, ones = total.astype(float) + PRIOR
            told = np.clip(np.rint(np.log(ones / zeros) * STRETCH), -127, 127).astype(np.int8)
            columns = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([told.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["predictor", "fragment", "told"])

        for batch in batches:
            for own, raw in zip(zip(*(batch.column(c).to_pylist() for c in ("predictor", "fragment"))), batch.column("counts")):
                planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw.as_py()), np.uint8)
                part = np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).reshape(2, -1)
                if own != key:
                    if key is not None:
                        yield done()
                    key, total = own, part
                else:
                    total = total + part
        if key is not None:
            yield done()

    parts = types.select("word", "c").coalesce(COUNTING_TASKS).mapInArrow(count, "predictor int, fragment int, counts binary")
    summed = parts.repartition("predictor", "fragment").sortWithinPartitions("predictor", "fragment").mapInArrow(add, "predictor int, fragment int, told binary")
    tables = [np.zeros(1 << log2, np.int8) for _, log2 in ORDERS]
    for row in summed.collect():
        begin = row["fragment"] << FRAGMENT
        tables[row["predictor"]][begin : begin + (1 << FRAGMENT)] = np.frombuffer(row["told"], np.int8)
    return tables


class Dictionary:
    """A block's words: bits, predictions and counts of each."""

    def __init__(self, keys: list[bytes], counts: list[int], speller: Speller, tables: list[np.ndarray], n: int, v: int):
        self.keys = keys
        c = np.array(counts, np.float64)
        told = list(map(spelled, keys))
        self.bytes = np.fromiter(map(len, told), np.int64, len(told))
        token = np.array([counts_as_token(k) for k in keys], bool)
        whole = (self.bytes > 0) & token
        self.token, self.known = token, token & (c > 0)
        self.base = np.where(token, np.log10((c + 1) / (n + v + 1)), 0.0)
        with np.errstate(divide="ignore"):
            self.share = np.where(whole, np.log(c / max(n, 1)), -np.inf)
        self.whole = whole
        self.bits = speller.lengths(told, self.bytes)
        self.starts = np.cumsum(self.bits) - self.bits
        self.gate = np.minimum(self.bytes, GATES - 1)
        # Each prediction with the sign of the bit: above 0 where it is right.
        self.told = np.empty((int(self.bits.sum()), len(tables)), np.int8)
        for k in range(0, len(keys), SPELLED):
            bit, slots, _ = speller.spell(keys[k : k + SPELLED])
            at, sign = int(self.starts[k]), bit.astype(np.int8) * np.int8(2) - np.int8(1)
            for j, (table, slot) in enumerate(zip(tables, slots)):
                self.told[at : at + len(bit), j] = table[slot] * sign

    @cached_property
    def numbers(self) -> dict[bytes, int]:
        return dict(zip(self.keys, range(len(self.keys))))


def score_texts(words: Dictionary, texts: list[bytes]) -> list[np.ndarray]:
    """`score_units` of texts whose words the dictionary has."""
    return score_units(words, [numbered(t, words.numbers) for t in texts])


def score_units(words: Dictionary, units: list[np.ndarray]) -> list[np.ndarray]:
    """(n_tokens, n_known, base_score, score, bits_per_byte) of texts, each given by the numbers of its words, from which alone it learns.

    All texts go forward together, block by block of their words, so the work is one array operation for all of them.
    """
    sizes = np.array([len(u) for u in units], np.int64)
    flat = np.concatenate(units)
    offsets = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(units)), sizes)

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=values[flat], minlength=len(units))

    gates = np.zeros(len(flat), np.int64)
    gates[1:] = words.gate[flat[:-1]]
    gates[offsets] = 0
    # How often each word stood in its text before, and how many words did.
    same = owner * len(words.bits) + flat
    order = np.argsort(same, kind="stable")
    first = np.concatenate([[0], np.flatnonzero(np.diff(same[order])) + 1])
    before = np.empty(len(flat), np.int64)
    before[order] = np.arange(len(flat)) - np.repeat(first, np.diff(np.append(first, len(flat))))
    with np.errstate(divide="ignore"):
        again = np.log(before) - np.log(np.maximum(np.arange(len(flat)) - offsets[owner], 1))

    score = np.zeros(len(units))
    weights = np.full((words.told.shape[1], len(units) * GATES), FIRST_WEIGHT / STRETCH, np.float32)
    shares = np.repeat(np.array(SHARES)[:, None] * SHARES_PRIOR, len(units), 1)
    at, width = 0, FIRST_WORDS
    active = np.arange(len(units))
    while len(active):
        lengths = np.minimum(sizes[active] - at, width)
        for group in np.split(np.arange(len(active)), np.flatnonzero(np.diff(np.cumsum(lengths) // AT_ONCE)) + 1):
            place = ranges(offsets[active[group]] + at, lengths[group])
            _forward(words, flat[place], owner[place], gates[place], again[place], weights, shares, score)
        at += width
        width = min(2 * width, MOST_WORDS)
        active = active[sizes[active] > at]
    return [
        per_text(words.token).astype(np.int64), per_text(words.known).astype(np.int64), per_text(words.base),
        score / math.log(10), -score / math.log(2) / per_text(words.bytes),
    ]


def _forward(words: Dictionary, unit, text, gate, again, weights, shares, score) -> None:
    """One block of words of some texts: adds to their scores, then learns from it. Words of a text stand together."""
    bits = words.bits[unit]
    index = ranges(words.starts[unit], bits)
    starts = np.minimum(np.cumsum(bits) - bits, max(len(index) - 1, 0))
    row = text * GATES + gate
    # All predictions of a bit lie side by side, so one look finds them.
    told = words.told.view(np.dtype((np.void, words.told.shape[1]))).take(index, 0).view(np.int8).reshape(len(index), -1)
    told = told.T.astype(np.float32, order="C")
    margin = np.zeros(len(index), np.float32)
    for j, t in enumerate(told):
        margin += np.repeat(weights[j, row], bits) * t
    # The bit's probability is 1 / (1 + against), and what the mix missed of it against / (1 + against).
    against = np.exp(-np.clip(margin, -12, 12))
    # The logarithm of 1 + against by a quotient that takes its rounding back: several times as fast as log1p, and as exact.
    sure = 1 + against
    spelt, missed = np.log(sure) * (against / (1 - sure)), against / sure
    def sums(x: np.ndarray, kind: type = np.float64) -> np.ndarray:
        return np.where(bits > 0, np.add.reduceat(x, starts, dtype=kind), kind(0)) if len(x) else np.zeros(len(bits))

    whole = words.whole[unit]
    said = np.stack([sums(spelt), words.share[unit], np.where(whole, again, -np.inf)])
    with np.errstate(divide="ignore"):
        said += np.log(shares / shares.sum(0)).take(text, 1)
    # Spelling is never impossible, so the likeliest is finite.
    likeliest = said.max(0)
    credit = np.exp(said - likeliest)
    together = credit.sum(0)
    # A long word's digest has no bits and no share: its pieces are scored.
    total = np.where(bits > 0, likeliest + np.log(together), 0)
    score += np.bincount(text, weights=total, minlength=len(score))

    # Rows and texts without a word here add up to 0 and stay as they are.
    step = RATE / STRETCH**2 / (np.bincount(row, weights=bits, minlength=weights.shape[1]) + DAMPING)
    for j, t in enumerate(told):
        weights[j] += step * np.bincount(row, weights=sums(missed * t, np.float32), minlength=len(step))
    credit *= whole / together
    for share, own in zip(shares, credit):
        share += np.bincount(text, weights=own, minlength=len(share))


def score_documents(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte).

    The model learns from all documents but those with crc32 of the id, as text, modulo 7 equal to 2; a null id is learned
    from. A null or empty text is its end alone. Rows that repeat count as often as they stand. Only `doc_id` and `text` are read.
    Without any training word all is spelled by even bits. An empty table gives no row. A task holds a block of texts,
    about BLOCK_BYTES or one longer text, and that block's distinct words. Jobs run while this is called; what they share is settled.
    """
    spark = docs.sparkSession
    gathered = settle(blocks_of(docs))
    alike = Window.partitionBy("word")
    words = gathered.where("word IS NOT NULL").select("block", "word", "number", F.sum("n").over(alike).alias("c"), (F.min("block").over(alike) == F.col("block")).alias("lead"))
    words = settle(words)
    types = settle(words.where("lead AND c > 0").select("word", "c"))
    token = F.substring("word", 1, 1) != F.lit(_PIECE)
    n, v = types.where(token).agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()

    def letters(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(256, np.int64)
        for batch in batches:
            told = [spelled(k) for k in batch.column("word").to_pylist()]
            times = np.repeat(np.array(batch.column("c").to_pylist(), np.int64), [len(t) for t in told])
            np.add.at(total, np.frombuffer(b"".join(told), np.uint8), times)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total, pa.int64())], ["byte", "n"])

    counted = types.mapInArrow(letters, "byte int, n bigint").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    counts = [0] * 256
    for row in counted:
        counts[row["byte"]] = row["n"]
    code = ByteCode(counts)
    tables = spark.sparkContext.broadcast(predictor_tables(types, code))

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        speller = Speller(code)
        block, known = None, None
        for batch in batches:
            blocks, payloads = batch.column("block").to_numpy(), batch.column("payload")
            numbers, times = (batch.column(x).fill_null(0).to_numpy() for x in ("number", "c"))
            # A run is some of a block's words or a payload.
            texts = payloads.is_valid().to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.append(True, (blocks[1:] != blocks[:-1]) | texts[1:])[: len(blocks)]).tolist()
            for begin, end in zip(begins, [*begins[1:], len(blocks)]):
                if blocks[begin] != block:
                    block, keys, places, counts, known = blocks[begin], [], [], [], None
                if not texts[begin]:
                    keys += batch.column("word").slice(begin, end - begin).to_pylist()
                    places.append(numbers[begin:end])
                    counts.append(times[begin:end])
                    continue
                if known is None:
                    known = Dictionary(keys, np.concatenate(counts), speller, tables.value, n, v)
                    place = np.empty(len(keys), np.int32)
                    place[np.concatenate(places)] = np.arange(len(keys))
                    keys, places, counts = [], [], []
                ids, units = unpack_units(payloads[begin].as_py())
                tokens, seen, base, total, rate = score_units(known, [place[u] for u in units])
                columns = [
                    pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids], pa.bool_()), pa.array(tokens, pa.int64()), pa.array(seen, pa.int64()),
                    pa.array([n] * len(ids), pa.int64()), *(pa.array(x, pa.float64()) for x in (base, total, rate)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _SCORES.split(", ")])

    none = F.lit(None)
    told = words.select("block", "word", "number", "c", none.cast("binary").alias("payload"))
    texts = gathered.where("payload IS NOT NULL").select("block", none.cast("binary").alias("word"), "number", none.cast("bigint").alias("c"), "payload")
    dealt = told.unionByName(texts).repartition("block").sortWithinPartitions("block", F.col("payload").isNotNull())
    return dealt.mapInArrow(score, _SCORES)
