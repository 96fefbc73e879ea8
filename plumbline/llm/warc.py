"""Web archives with a two-level capture index.

Records lie in gzip members of their own in `.warc.gz` files. The index holds a line per record under its URL
with the host reversed. Lines are sorted and cut into compressed blocks; each index file ends with a sparse
directory of its blocks. A lookup finds index files by their first and last keys, binary-searches the
directory of such a file, reads the blocks by their ranges, binary-searches them, and reads the records by
theirs.

An index file is: gzip members of `BLOCK_LINES` lines each (key, page id, archive, offset, length, by tabs);
then a gzip member with one line per block (first key, last key, offset, length, by tabs); then the offset and length
of that member (u64 each, little-endian) and `MAGIC`.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from plumbline.llm.shared import filesystem, new_folder
from plumbline.session import settle

LEAST_BYTES = 1000
BLOCK_LINES = 256
#: Index blocks, and compressed bytes of archives, that a reading task takes, about.
TASK_BLOCKS = 1 << 10
READ_BYTES = 16 << 20
MAGIC = b"CAPINDX1"
#: Fixed by the format: the profile of revisits that hold an equal payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_CAPTURE = "key string, page_id bigint, archive string, offset bigint, length bigint"
_RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def url_key(url: str | None) -> str:
    """The URL with its host in lower case and reversed: `com,example,www)/path?query`. No URL: an empty key.

    Blanks and control characters, which could break a line of the index, are percent-encoded.
    """
    if not url:
        return ""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:] or "/"
    host, _, port = host.rpartition("@")[2].partition(":")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + path
    return "".join(c if c > " " and c != "\x7f" and c not in "\x85  " else "".join(f"%{b:02X}" for b in c.encode()) for c in key)


def gzip_member(data: bytes, level: int = 6) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def gunzip(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def record_id(page_id: int | None, digest: str) -> str:
    named = digest if page_id is None else f"page {page_id}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, named)}>"


def make_record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to, date: str) -> bytes:
    """One WARC record; a revisit (payload None) holds the response's head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload or b"")
    named = base64.b32encode(bytes.fromhex(digest)).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{named}",
        f"Page-Payload-Length: {size}",
    ]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if payload is None:
        lines += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Page-Refers-To: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes) -> tuple:
    """(page_id, payload bytes, payload digest, type, refers_to) of a record; a wrong payload is an error."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size, kind = int(fields["Page-Payload-Length"]), fields["WARC-Type"]
    if kind == "response":
        payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("Page-ID"), size, digest, kind, number("Page-Refers-To")


class _Files:
    """Open files of a task, a few at a time, read by range."""

    def __init__(self, most: int = 16):
        self.most, self.open = most, {}

    def get(self, path: str):
        if path not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            fs, inner = filesystem(path)
            self.open[path] = fs.open_input_file(inner)
        return self.open[path]

    def read(self, path: str, offset: int, length: int) -> bytes:
        source = self.get(path)
        source.seek(offset)
        return source.read(length)


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page and settle the captures: (key, page_id, archive, offset, length).

    Of pages with equal payloads of at least `least` bytes, that with the largest `page_id` is the response and
    the others revisit it; rows that repeat this id are responses too, and if all ids are null, so are all.
    A null html is an empty payload. Only `page_id`, `url` and `html` are read. Pages stay in the tasks that
    read them, unless the repeated payloads are too many to be sent to all; files of failed attempts are not
    referred to.
    """
    folder = folder or new_folder(pages.sparkSession, "archives")
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    told = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    told = told.withColumn("digest", F.sha1("payload"))
    large = told.where(F.octet_length("payload") >= least).groupBy("digest")
    kept = large.agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    marked = told.join(kept.select("digest", "response"), "digest", "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("response")), None).otherwise(F.col("response"))
    marked = marked.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        path = sink = None
        at = 0
        for batch in batches:
            captures = []
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for page_id, url, body, digest, refers_to in zip(*columns):
                page_id, url, refers_to = page_id.as_py(), url.as_py(), refers_to.as_py()
                if sink is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    fs, inner = filesystem(path)
                    fs.create_dir(inner.rpartition("/")[0], recursive=True)
                    sink = fs.open_output_stream(inner, compression=None)
                data = body.as_py()
                record = make_record(page_id, url, data if refers_to is None else None, len(data), digest.as_py(), refers_to, date)
                packed = gzip_member(record)
                sink.write(packed)
                captures.append((url_key(url), page_id, path, at, len(packed)))
                at += len(packed)
            if captures:
                types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(zip(*captures), types)]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "page_id", "archive", "offset", "length"])
        if sink is not None:
            sink.close()

    return settle(marked.mapInArrow(write, _CAPTURE))


def write_index(captures: DataFrame, folder: str | None = None) -> DataFrame:
    """Sort captures by key into index files, and settle (file, first_key, last_key, blocks) per file.

    Captures of one key may fill many blocks and files: within a key they are dealt by their place.
    """
    folder = folder or new_folder(captures.sparkSession, "index")

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        path = sink = None
        at = 0
        directory: list[tuple[str, str, int, int]] = []
        lines: list[tuple[str, str]] = []

        def block() -> None:
            nonlocal at
            packed = gzip_member("\n".join(line for _, line in lines).encode())
            sink.write(packed)
            directory.append((lines[0][0], lines[-1][0], at, len(packed)))
            at += len(packed)
            lines.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "archive", "offset", "length"))):
                if sink is None:
                    path = f"{folder}/{uuid.uuid4().hex}.cdx.gz"
                    fs, inner = filesystem(path)
                    fs.create_dir(inner.rpartition("/")[0], recursive=True)
                    sink = fs.open_output_stream(inner, compression=None)
                lines.append((row[0], "\t".join("" if v is None else str(v) for v in row)))
                if len(lines) == BLOCK_LINES:
                    block()
        if sink is None:
            return
        if lines:
            block()
        sparse = gzip_member("\n".join("\t".join(map(str, entry)) for entry in directory).encode())
        sink.write(sparse + struct.pack("<QQ", at, len(sparse)) + MAGIC)
        sink.close()
        yield pa.RecordBatch.from_pydict(
            {"file": [path], "first_key": [directory[0][0]], "last_key": [directory[-1][1]], "blocks": [len(directory)]}
        )

    order = ["key", "archive", "offset"]
    placed = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(placed.mapInArrow(write, "file string, first_key string, last_key string, blocks bigint"))


def read_directory(files: _Files, path: str) -> list[tuple[str, str, int, int]]:
    source = files.get(path)
    size = source.size()
    at, length, magic = struct.unpack("<QQ8s", files.read(path, size - 24, 24))
    if magic != MAGIC:
        raise ValueError(f"no directory at the end of {path}")
    rows = (line.split("\t") for line in gunzip(files.read(path, at, length)).decode().split("\n"))
    return [(first, last, int(offset), int(n)) for first, last, offset, n in rows]


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Captures of the given keys (column `key`), in any order: (key, page_id, archive, offset, length).

    Unknown and null keys give nothing; repeated ones are looked up once. The index's list of files, one
    line per file with its first and last key, is sent to all tasks; directories and blocks are read where needed.
    """
    told = index.select("first_key", "last_key", "file", "blocks").collect()
    rows = sorted((r["first_key"], r["last_key"], r["file"]) for r in told)
    tasks = max(1, -(-sum(r["blocks"] for r in told) // TASK_BLOCKS))
    listed = keys.sparkSession.sparkContext.broadcast(rows)

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parts, files = listed.value, _Files()
        firsts, lasts = [p[0] for p in parts], [p[1] for p in parts]
        name, directory, starts, ends = None, [], [], []
        for batch in batches:
            out = []
            for key in batch.column("key").to_pylist():
                for _, _, path in parts[bisect_left(lasts, key) : bisect_right(firsts, key)]:
                    if path != name:
                        name, directory = path, read_directory(files, path)
                        starts, ends = [d[0] for d in directory], [d[1] for d in directory]
                    for _, _, at, length in directory[bisect_left(ends, key) : bisect_right(starts, key)]:
                        out.append((key, path, at, length))
            if out:
                types = [pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["key", "file", "at", "size"])

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        files, held, lines, sorted_keys = _Files(), None, [], []
        for batch in batches:
            out = []
            for key, path, at, length in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "at", "size"))):
                if held != (path, at):
                    held = path, at
                    lines = [line.split("\t") for line in gunzip(files.read(path, at, length)).decode().split("\n")]
                    sorted_keys = [line[0] for line in lines]
                for _, page_id, archive, offset, n in lines[bisect_left(sorted_keys, key) : bisect_right(sorted_keys, key)]:
                    out.append((key, int(page_id) if page_id else None, archive, int(offset), int(n)))
            if out:
                types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "page_id", "archive", "offset", "length"])

    asked = keys.select("key").where(F.col("key").isNotNull()).distinct()
    asked = asked.repartitionByRange("key").sortWithinPartitions("key")
    blocks = asked.mapInArrow(find, "key string, file string, at bigint, size bigint")
    blocks = blocks.repartition(tasks, "file", "at").sortWithinPartitions("file", "at", "key")
    return blocks.mapInArrow(search, _CAPTURE)


def read_captures(captures: DataFrame, tasks: int = 200) -> DataFrame:
    """The records of captures, read by range and checked: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    `tasks` follows from the bytes to be read: the rows that name them are small.
    """

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        files = _Files()
        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")))
            rows = [read_record(gunzip(files.read(*place))) for place in places]
            if rows:
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(arrays, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    places = captures.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset")
    return places.sortWithinPartitions("archive", "offset").mapInArrow(read, _RECORD)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write the archives and their index, then look every URL up and read its captures back.

    One row per row of `pages`; repeated rows and URLs come back as often as they stand there. A null html is an empty
    payload. An empty table writes no file and gives no row; a page of any length is one record, which a task holds once.
    """
    captures = write_archives(pages)
    index = write_index(captures)
    size = captures.agg(F.sum("length")).first()[0] or 0
    return read_captures(lookup(index, captures.select("key")), max(1, -(-size // READ_BYTES)))
