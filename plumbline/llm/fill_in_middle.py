"""Fill-in-middle transformation by secondary-sort assembly.

A text is cut into units and, at two unit ends, into prefix, middle and suffix. Each part leaves its task as
pieces of some units, keyed by the row they come from and by their position in the output. Pieces are dealt out by row and
sorted by row and position within each partition (one shuffle), and stream into a digest of the output: no task
holds a whole output. The same stream finds the parts again by the markers; sorted by their place in the original (within
the partition, no second shuffle), they stream into the digest of the restored text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Fixed by the format: what stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Parts in the order of the original text.
_PLACES = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
_END = 3
PIECE_UNITS = 4096
PIECE_BYTES = 1 << 16
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True

_PIECES = "row binary, position int, piece binary, doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, times bigint"
_PLACED = "row binary, place int, position bigint, piece binary, doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, times bigint"
_DIGESTS = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"


def unit_ends(raw: np.ndarray) -> np.ndarray:
    """Where each unit of a text's bytes ends: a word with the blanks before it, or the blanks at the end."""
    if not len(raw):
        return np.empty(0, np.int64)
    blank = _BLANK[raw]
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    # The last byte ends a word or the blanks that no word follows.
    return np.append(ends, len(raw))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits from the seed and the id (nothing for a null one)."""
    told = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(told[k : k + 8], 16) for k in (0, 8, 16, 24)]


def parts_of(text: bytes, doc_id: int | None, seed: int, rate: int, spm: int) -> tuple[int, str, list[tuple[bytes, int, int]], np.ndarray]:
    """(number of units, form, parts in output order as (marker, begin, end) in bytes, unit ends)."""
    ends = unit_ends(np.frombuffer(text, np.uint8))
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or h3 % 100 >= rate or any(m in text for m in _PLACES):
        return n, "plain", [(b"", 0, len(text))], ends
    first, second = (int(ends[c - 1]) if c else 0 for c in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = (PREFIX, 0, first), (MIDDLE, first, second), (SUFFIX, second, len(text))
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, [suffix, prefix, middle] if form == "spm" else [prefix, suffix, middle], ends


def _characters(text: bytes) -> int:
    raw = np.frombuffer(text, np.uint8)
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def _cuts(begin: int, end: int, ends: np.ndarray) -> list[int]:
    """Borders of the pieces of a part: every PIECE_UNITS units, and within very long units every PIECE_BYTES bytes."""
    inner = ends[(ends > begin) & (ends < end)][PIECE_UNITS - 1 :: PIECE_UNITS].tolist()
    out = [begin]
    for border in [*inner, end]:
        out += [*range(out[-1] + PIECE_BYTES, border, PIECE_BYTES), border]
    return out


class _Rows:
    """Rows on their way out, in batches of bounded size."""

    def __init__(self, schema: str):
        import pyarrow as pa

        kinds = {"binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
        fields = [f.split() for f in schema.split(", ")]
        self.schema = pa.schema([(name, kinds[kind]) for name, kind in fields])
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, row: tuple, size: int) -> bool:
        """True when it is time to take the batch."""
        self.rows.append(row)
        self.held += size
        return len(self.rows) >= BATCH_ROWS or self.held >= BATCH_BYTES

    def take(self):
        import pyarrow as pa

        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def pieces_of(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """All pieces of all outputs, in no order: (row, position, piece, ...); what is told of the row stands at position 0.

    `row` is a digest of id and text and the number of the task's partition, so a task that is run again makes the same. Equal
    rows of a batch go out once, with their number as `times`; equal rows of other batches repeat their pieces.
    """

    def cut(batches: Iterator) -> Iterator:
        import xxhash
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId().to_bytes(4, "big")
        out = _Rows(_PIECES)
        for batch in batches:
            alike: dict[bytes, list] = {}
            for k, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"))):
                told = b"" if doc_id is None else str(doc_id).encode()
                key = xxhash.xxh3_128_digest(told + b":" + (text.as_py() or b"")) + salt
                if key in alike:
                    alike[key][2] += 1
                else:
                    alike[key] = [k, doc_id, 1]
            for key, (k, doc_id, times) in alike.items():
                text = batch.column("text")[k].as_py() or b""
                n, form, parts, ends = parts_of(text, doc_id, seed, rate, spm)
                chars = {marker: _characters(text[a:b]) for marker, a, b in parts}
                told = (doc_id, n, form, chars.get(PREFIX), chars.get(MIDDLE), times)
                position = 0
                for marker, begin, end in parts:
                    cuts = _cuts(begin, end, ends)
                    for a, b in zip(cuts[:-1], cuts[1:]):
                        piece = text[a:b] if a > begin else marker + text[a:b]
                        if out.add((key, position, piece, *(told if not position else [None] * 6)), b - a):
                            yield out.take()
                        position += 1
            yield out.take()

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(cut, _PIECES)


def assembled(pieces: DataFrame) -> DataFrame:
    """The pieces dealt out by row and sorted by row and position within each partition: one after another they are the outputs."""
    return pieces.repartition("row").sortWithinPartitions("row", "position")


def digest_outputs(pieces: DataFrame) -> DataFrame:
    """Streams assembled pieces into digests of the outputs, and takes the outputs apart again.

    Returns the parts without markers, with their place in the original, and behind them (place 3) what is told of the
    row, with the digest of its output as piece. Only the output's bytes and its form are looked at.
    """

    def stream(batches: Iterator) -> Iterator:
        out = _Rows(_PLACED)
        key = told = digest = None
        last = place = sent = times = 0

        def end() -> tuple:
            return key, _END, sent, digest.digest(), *told[:-1], times

        for batch in batches:
            for row, position, piece, *facts in zip(*(c.to_pylist() for c in batch.columns)):
                if row != key:
                    if key is not None and out.add(end(), 64):
                        yield out.take()
                    key, told, digest = row, facts, hashlib.sha256()
                    last, place, sent, times = -1, 0, 0, 0
                if position == 0:
                    times += facts[-1]
                if position == last:
                    continue
                last = position
                digest.update(piece)
                found = [] if told[2] == "plain" else sorted((at, m) for m in _PLACES if (at := piece.find(m)) >= 0)
                begin = 0
                for at, marker in [*found, (len(piece), b"")]:
                    if at > begin:
                        if out.add((key, place, sent, piece[begin:at], *[None] * 6), at - begin):
                            yield out.take()
                        sent += 1
                    place, begin = _PLACES.get(marker, place), at + len(marker)
        if key is not None:
            out.add(end(), 64)
        yield out.take()

    return pieces.mapInArrow(stream, _PLACED)


def digest_restored(parts: DataFrame) -> DataFrame:
    """Sorts the parts by their place in the original, within partitions, and streams them into digests of the texts."""

    def stream(batches: Iterator) -> Iterator:
        out = _Rows(_DIGESTS)
        digest = hashlib.sha256()
        for batch in batches:
            for _, place, _, piece, *told, times in zip(*(c.to_pylist() for c in batch.columns)):
                if place < _END:
                    digest.update(piece)
                    continue
                for _ in range(times):
                    if out.add((*told, piece.hex(), digest.hexdigest()), 256):
                        yield out.take()
                digest = hashlib.sha256()
        yield out.take()

    return parts.sortWithinPartitions("row", "place", "position").mapInArrow(stream, _DIGESTS)


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """Per row of `docs`: (doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256).

    `rate` percent of the documents are transformed, `spm` percent of these with the suffix first. A null or empty
    text and one that holds a marker stay plain. A null id draws as an empty one. Rows that repeat are told as
    often as they stand, whatever their number; rows that share an id but not the text are rows of their own. Only `doc_id` and
    `text` are read. An empty table gives no row. Memory: a task holds one document while it is cut, later a batch of
    pieces of at most PIECE_BYTES bytes each.
    """
    return digest_restored(digest_outputs(assembled(pieces_of(docs, seed, rate, spm))))
