"""Token counts and token files against the tokenizers library."""

from __future__ import annotations

import struct
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from plumbline.llm.token_counts import MergeCounter, merge_tables, token_counts
from plumbline.llm.token_files import Encoder, encode_to_files, read_documents, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, start string, n_tokens int"
TEXTS = [
    (5, "It's a Test: we'll see. ΟΔΟΣ İ", "x", 1),
    (3, "", "x", 1),
    (1, None, None, None),
    (None, "no id", "x", 1),
    (7, "same words here", "x", 1),
    (7, "same words here", "x", 1),
    (2, "<|endoftext|>inside<|startoftext|> 12345 a b", "x", 1),
    (9, "long " * 20000 + "x" * 3000, "x", 1),
]
#: Letters, marks and signs that every Unicode version of the last years knows alike.
SAFE = st.characters(codec="utf-8", max_codepoint=0x24F) | st.sampled_from("ΣσςİǺ한글日本語٣½😀  <|>")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH) as file:
        return MergeCounter(merge_tables(file.read()))


@settings(deadline=None, max_examples=300)
@given(st.text(SAFE, max_size=40))
def test_counts_equal_the_library(text):
    with open(PATH) as file:
        spec = file.read()
    global _tables
    try:
        tables = _tables
    except NameError:
        tables = _tables = (MergeCounter(merge_tables(spec), remembered=8), Encoder(spec, remembered=8), Tokenizer.from_str(spec))
    counter, encoder, library = tables
    ids = library.encode(text, add_special_tokens=False).ids
    assert counter.count(text.encode()) == len(ids)
    assert encoder.encode(text.encode()) == struct.pack(f"<{len(ids)}I", *ids)


def test_lowest_rank_first(counter):
    # One word, many merges: initial symbols minus merges.
    assert counter.merged(b"a") == 1
    assert counter.count("ab".encode()) <= 2


def test_rows_of_any_kind(spark, library):
    docs = spark.createDataFrame(TEXTS, SCHEMA)
    rows = token_counts(docs, PATH, limit=100).collect()
    want = sorted(
        (str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 100)
        for i, t, _, _ in TEXTS
    )
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    assert token_counts(docs.limit(0), PATH).count() == 0


def test_files_round_trip(spark, library):
    docs = spark.createDataFrame(TEXTS, SCHEMA).repartition(3)
    files = write_token_files(docs, PATH, 2)
    assert files.agg({"docs": "sum"}).first()[0] == len(TEXTS)
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t, _, _ in TEXTS}
    order = sorted((i is not None, i or 0, want[i]) for i, _, _, _ in TEXTS)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in encode_to_files(docs, PATH, 2).collect())
    begin = 0
    for (known, i, ids), row in zip(order, got, strict=True):
        assert row == (begin, i if known else None, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        begin += len(ids)
    some = {r.doc_id: r.ids for r in read_documents(files, [5, 7, 1000]).collect()}
    assert some == {5: want[5], 7: want[7]}
    assert encode_to_files(docs.limit(0), PATH, 2).count() == 0


def test_a_damaged_frame_is_noticed(spark):
    from plumbline.llm.shared import filesystem
    from plumbline.llm.token_files import FrameReader

    path = write_token_files(spark.createDataFrame([(1, "some words")], "doc_id int, text string"), PATH, 2).first()["file"]
    fs, inner = filesystem(path)
    with fs.open_input_file(inner) as source:
        data = bytearray(source.read())
    data[12] ^= 0xFF
    import io

    reader = FrameReader(io.BytesIO(bytes(data)), len(data))
    with pytest.raises(Exception):
        list(reader.frame(0))


def test_a_plain_reader_unpacks_the_file(spark):
    import io

    import zstandard

    from plumbline.llm.shared import filesystem

    path = write_token_files(spark.createDataFrame([(1, "some words")], "doc_id int, text string"), PATH, 2).first()["file"]
    fs, inner = filesystem(path)
    with fs.open_input_file(inner) as source:
        data = source.read()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert struct.unpack_from("<I", whole) == (1,)


def test_reading_tasks_grow_with_the_ids(spark, monkeypatch):
    from plumbline.llm import token_files as files
    from plumbline.llm.suite import END_ID, tokenizer_path

    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('word by word ', 40) AS text").repartition(8)
    written = files.write_token_files(docs, tokenizer_path(), END_ID)
    tokens, n = written.selectExpr("sum(tokens)", "count(*)").first()
    for size in (1 << 30, 4 * tokens // 2, 1):
        monkeypatch.setattr(files, "READ_BYTES", size)
        read = files.read_token_digests(written)
        assert read.rdd.getNumPartitions() == max(1, min(n, -(-4 * tokens // size)))
        assert read.count() == 3000
