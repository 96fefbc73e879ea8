"""Token ids in binary files: independent zstandard frames with a trailing seek table and checksums.

A file holds, one after another:

- frames. Each is zstandard data of its own with a content checksum; its payload is `n` (u32), a byte per
  document that is 1 if its id is not null, `n` document ids (i64), `n` token counts (u32), then all token ids
  (u32). Numbers are little-endian. A frame holds whole documents, about a megabyte of ids; a longer
  document has a frame of its own.
- a directory frame, skippable (magic 0x184D2A50): per frame the first and last document id (i64 each),
  documents and tokens (u64 each).
- the seek table, skippable (magic 0x184D2A5E), as zstandard's seekable format lays it down: per frame the
  compressed size, the size of the payload and the low half of the payload's XXH64 (u32 each), then the
  number of frames (u32), a descriptor byte (0x80: with checksums) and the magic 0x8F92EAB1.

Any zstandard reader unpacks the whole file; `read_documents` unpacks only frames that hold wanted ids.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.llm.shared import filesystem, new_folder, pieces, vocabulary
from plumbline.llm.token_counts import byte_alphabet
from plumbline.session import settle

#: Fixed by the formats.
SKIPPABLE, SEEK_SKIPPABLE, SEEK_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_BYTES = 1 << 20
#: Bytes of ids that a reading task takes, about.
READ_BYTES = 64 << 20
_ENTRY, _SPAN = "<III", "<qqQQ"
_FILES = "file string, part int, frames bigint, docs bigint, tokens bigint"


class Encoder:
    """Token ids of pieces of text as little-endian bytes; remembers short pieces, up to a bounded number."""

    def __init__(self, spec: str, remembered: int = 1 << 19):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.most = remembered
        self.known: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}
        ends = [".", ","]
        self.ends = dict(zip(ends, self.call(ends)))

    def call(self, texts: list[str]) -> list[bytes]:
        """Ids of some pieces, from one call of the library."""
        if not texts:
            return []
        got = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(got.ids, "<u4").tobytes()
        # No token spans two pieces, so the pieces of the tokens rise and their ends cut the ids.
        ends = (np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(texts)), "right") * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def word(self, word: str) -> bytes:
        """Ids of a word of small letters: the tokenizer takes it whole, so its model alone is asked."""
        ids = self.stems.get(word)
        if ids is None:
            text = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
            ids = np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()
            if len(word) <= 64:
                if len(self.stems) >= self.most:
                    self.stems.clear()
                self.stems[word] = ids
        return ids

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces. Letters, with or without a stop behind them, go to the model; all else through the whole tokenizer.

        The tokenizer composes and lowers its input and takes letters apart from other characters. Words that
        a capital sigma or a longer small form makes special are left to it.
        """
        ids: list[bytes | None] = []
        others = []
        for piece in pieces:
            text = piece.decode()
            end = b""
            if text[-1] in self.ends and len(text) > 1:
                end, text = self.ends[text[-1]], text[:-1]
            low = text.lower()
            if text.isalpha() and (text.isascii() or len(low) == len(text) and "Σ" not in text and is_normalized("NFC", text)):
                ids.append(self.word(low) + end)
            else:
                ids.append(None)
                others.append(piece.decode())
        rest = iter(self.call(others))
        return [next(rest) if i is None else i for i in ids]

    def encode(self, text: bytes) -> bytes:
        out = []
        for part in pieces(text):
            fresh = list(set(part).difference(self.known))
            if fresh:
                if len(self.known) + len(fresh) > self.most:
                    self.known = {}
                    fresh = list(set(part))
                self.known.update(zip(fresh, self.learn(fresh)))
            out.append(b"".join(map(self.known.__getitem__, part)))
            for piece in fresh:
                if len(piece) > 64:
                    del self.known[piece]
        return b"".join(out)


class FrameWriter:
    """Writes documents, in the order given, to one file of the format above."""

    def __init__(self, sink, level: int = 3):
        import zstandard

        self.sink = sink
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.sizes: list[tuple[int, int, int]] = []
        self.spans: list[tuple[int, int, int, int]] = []
        self.written = self.docs = self.tokens = 0
        self._clear()

    def _clear(self) -> None:
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.parts: list[bytes] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.ids and self.held + len(ids) > FRAME_BYTES:
            self.flush()
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.parts.append(ids)
        self.held += len(ids)

    def flush(self) -> None:
        import xxhash

        if not self.ids:
            return
        n = len(self.ids)
        known = bytes(i is not None for i in self.ids)
        numbers = np.array([0 if i is None else i for i in self.ids], "<i8")
        payload = b"".join(
            [struct.pack("<I", n), known, numbers.tobytes(), np.array(self.counts, "<u4").tobytes(), *self.parts]
        )
        packed = self.pack.compress(payload)
        self.sink.write(packed)
        self.written += len(packed)
        self.sizes.append((len(packed), len(payload), xxhash.xxh64_intdigest(payload) & 0xFFFFFFFF))
        named = [i for i in self.ids if i is not None]
        # Null ids come first in the order; a frame of them alone spans nothing.
        span = (named[0], named[-1]) if named else (0, -1)
        self.spans.append((*span, n, sum(self.counts)))
        self.docs += n
        self.tokens += sum(self.counts)
        self._clear()

    def close(self) -> None:
        self.flush()
        directory = b"".join(struct.pack(_SPAN, *s) for s in self.spans)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(directory)) + directory)
        table = b"".join(struct.pack(_ENTRY, *s) for s in self.sizes)
        self.sink.write(struct.pack("<II", SEEK_SKIPPABLE, len(table) + 9) + table)
        self.sink.write(struct.pack("<IBI", len(self.sizes), CHECKSUMS, SEEK_MAGIC))


class FrameReader:
    """Reads single frames of a file by its seek table; a damaged file is an error."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end of the file")
        begin = size - 9 - n * 12
        source.seek(begin)
        table = np.frombuffer(source.read(n * 12), "<u4").reshape(n, 3)
        self.sizes = table
        self.starts = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        source.seek(int(self.starts[-1]) + 8)
        self.spans = [struct.unpack(_SPAN, source.read(32)) for _ in range(n)]

    def frame(self, k: int) -> Iterator[tuple[int | None, bytes]]:
        import xxhash
        import zstandard

        packed_size, size, checksum = (int(x) for x in self.sizes[k])
        self.source.seek(int(self.starts[k]))
        payload = zstandard.ZstdDecompressor().decompress(self.source.read(packed_size), max_output_size=size)
        if len(payload) != size or xxhash.xxh64_intdigest(payload) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} does not match its checksum")
        (n,) = struct.unpack_from("<I", payload)
        numbers = np.frombuffer(payload, "<i8", n, 4 + n).tolist()
        counts = np.frombuffer(payload, "<u4", n, 4 + 9 * n).tolist()
        at = 4 + 13 * n
        for i in range(n):
            yield numbers[i] if payload[4 + i] else None, payload[at : at + 4 * counts[i]]
            at += 4 * counts[i]


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode every whole text, append `end_id`, write the ids in ascending order of `doc_id`.

    Returns one row per file: (file, part, frames, docs, tokens, start), `start` being the ids of all earlier
    files. Null ids come first; rows with equal ids follow one another by the hash of their text. A null or
    empty text is the end id alone. Only `doc_id` and `text` are read. An empty table gives no file. Each attempt
    of a task writes its own file, and only those of attempts that ended well are in the result, which is
    settled in the shared folder. Tasks hold one frame and one document at a time.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    spec = spark.sparkContext.broadcast(vocabulary(tokenizer_path))
    end = struct.pack("<I", end_id)

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = writer = sink = None
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if writer is None:
                    path = f"{folder}/{part:06d}-{uuid.uuid4().hex}.zst"
                    fs, inner = filesystem(path)
                    fs.create_dir(inner.rpartition("/")[0], recursive=True)
                    encoder, sink = encoder or Encoder(spec.value), fs.open_output_stream(inner, compression=None)
                    writer = FrameWriter(sink)
                writer.add(doc_id, encoder.encode(text.as_py() or b"") + end)
        if writer is not None:
            writer.close()
            sink.close()
            row = {"file": [path], "part": [part], "frames": [len(writer.sizes)], "docs": [writer.docs], "tokens": [writer.tokens]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("file", pa.string()), ("part", pa.int32()), ("frames", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    written = settle(narrow.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, _FILES))
    # One row per file: so few that their running total may be made in one place.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return settle(written.withColumn("start", F.coalesce(F.sum("tokens").over(earlier), F.lit(0))))


def read_token_digests(files: DataFrame) -> DataFrame:
    """Per document of the files: (doc_id, start, n_tokens, ids_crc32), every checksum verified.

    `start` counts the ids of all documents before it; `ids_crc32` is over the little-endian ids.
    """

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                fs, inner = filesystem(path)
                with fs.open_input_file(inner) as source:
                    reader = FrameReader(source, source.size())
                    for k in range(len(reader.spans)):
                        rows = []
                        for doc_id, ids in reader.frame(k):
                            rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                            start += len(ids) // 4
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    # A row is a whole file: the number of tasks follows from the ids to be read, not from the size of these rows.
    count, tokens = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    tasks = min(count, -(-4 * tokens // READ_BYTES))
    spread = files.select("file", "start").repartition(max(1, tasks))
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_documents(files: DataFrame, doc_ids: list[int]) -> DataFrame:
    """The ids of some documents: (doc_id, ids array<bigint>), unpacking only frames that can hold them."""
    wanted = sorted(set(doc_ids))

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path in batch.column("file").to_pylist():
                fs, inner = filesystem(path)
                with fs.open_input_file(inner) as source:
                    reader = FrameReader(source, source.size())
                    for k, (first, last, _, _) in enumerate(reader.spans):
                        if np.searchsorted(wanted, first) == np.searchsorted(wanted, last, "right"):
                            continue
                        rows = [(i, np.frombuffer(x, "<u4").tolist()) for i, x in reader.frame(k) if i in wanted]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))],
                            ["doc_id", "ids"],
                        )

    return files.select("file").mapInArrow(read, "doc_id bigint, ids array<bigint>")


def encode_to_files(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the files and read them back: the digests of `read_token_digests`."""
    return read_token_digests(write_token_files(docs, tokenizer_path, end_id))


def remove_files(spark: SparkSession, folder: str) -> None:
    """Delete a folder of token files when its readers are done."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
