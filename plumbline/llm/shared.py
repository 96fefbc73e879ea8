"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.session import shared_folder

VOCABULARY_BYTES = 64 << 20
SLICE_BYTES = 1 << 20
_BLANKS = b" \t\n\r\x0b\x0c"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system Spark would use for it."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder below the shared one, below the application's id."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"
    return qualified(spark, path)


def filesystem(uri: str):
    """The pyarrow file system of a URI and the path within it; works in the driver and in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def vocabulary(path: str) -> str:
    """A tokenizer file's text, to be broadcast: executors need no copy. A larger one than 64 MB is refused."""
    with open(path, encoding="utf-8") as file:
        text = file.read(VOCABULARY_BYTES + 1)
    if len(text) > VOCABULARY_BYTES:
        raise ValueError(f"tokenizer file over {VOCABULARY_BYTES} characters: {path}")
    return text


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """All runs of bytes between ASCII blanks, in lists that hold about a megabyte of text each."""
    begin, n = 0, len(text)
    while begin < n:
        end = begin + SLICE_BYTES
        if end < n:
            while end < n and text[end] not in _BLANKS:
                end += 1
        yield text[begin:end].split()
        begin = end


def held_out():
    """Rows whose labels no model may learn from: crc32 of the id as text leaves 1 by 3 (null ids: false)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int) -> DataFrame:
    """The bounded training sample: (doc_id, text, label), at most `per_class` ids of each class.

    Ids are those with the smallest hashes among labelled ones that are not held out; documents of more than `max_chars`
    characters are left out of the sample. Null ids, texts and labels take no part; an id that repeats with
    several texts brings each. The chosen ids, 2 * per_class at most, are broadcast, so texts are not shuffled.
    """
    marked = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
    marked = marked.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out()).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [marked.where(F.col("label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    sample = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    return sample.orderBy(F.xxhash64("doc_id"), "doc_id", "label", F.xxhash64("text")).limit(4 * per_class)
