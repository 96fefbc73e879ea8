"""Archives: what is read back equals what was written, and lookups find every capture."""

from __future__ import annotations

import hashlib

from plumbline.llm.shared import filesystem
from plumbline.llm.warc import archive_and_read, lookup, read_captures, url_key, write_archives, write_index

BIG = "x" * 1500
ROWS = [
    (1, "http://a.example.com/1", BIG, "d"),
    (2, "http://b.example.com/2", BIG, "d"),
    (9, "http://a.example.com/1", BIG, "d"),
    (3, "http://A.example.com/1#top", "small", "d"),
    (4, "http://c.example.com/", "small", "d"),
    (5, None, None, "d"),
    (6, "", "é" * 500, "d"),
    (None, "http://d.example.com/a b\nc", "é" * 500, "d"),
    (7, "no scheme", "y" * 999, "d"),
    (8, "http://e.example.com/?q", "y" * 999, "d"),
]
SCHEMA = "page_id bigint, url string, html string, digest string"


def expected(rows):
    out = []
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if r[2] == html and r[0] is not None]
        leader = max(same) if same and len(data) >= 1000 else page_id
        revisit = leader is not None and leader != page_id
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", leader if revisit else None))
    return sorted(map(str, out))


def test_read_back(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert sorted(str(tuple(r)) for r in archive_and_read(pages).collect()) == expected(ROWS)
    assert archive_and_read(pages.limit(0)).count() == 0


def test_hot_url_and_many_blocks(spark):
    rows = [(i, "http://hot.example.com/x" if i % 3 else f"http://h{i}.example.com/", f"page {i}", "d") for i in range(2000)]
    captures = write_archives(spark.createDataFrame(rows, SCHEMA).repartition(4))
    index = write_index(captures)
    asked = spark.createDataFrame([(url_key("http://hot.example.com/x"),), ("com,example,none)/",), (None,)], "key string")
    found = lookup(index, asked)
    assert sorted(r.page_id for r in found.collect()) == [i for i in range(2000) if i % 3]
    assert read_captures(found).count() == sum(1 for i in range(2000) if i % 3)
    assert lookup(index, captures.select("key")).count() == 2000


def test_keys_and_records(spark):
    assert url_key("https://WWW.Example.com:8080/A?b=1#c") == "com,example,www:8080)/A?b=1"
    assert url_key("http://example.com?x") == "com,example)?x" and url_key(None) == ""
    import gzip

    archive = write_archives(spark.createDataFrame(ROWS[:1], SCHEMA)).first()["archive"]
    fs, inner = filesystem(archive)
    with fs.open_input_file(inner) as source:
        text = gzip.decompress(source.read()).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(BIG + "\r\n\r\n")
