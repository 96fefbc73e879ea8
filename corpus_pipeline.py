"""A corpus from documents: good texts, one of each group, no benchmark items, mixed sources, token files.

`STAGES` are applied one after another; each takes (spark, docs, sf_dir), works on all rows the one before kept,
and returns a DataFrame, which is written as Parquet and read again. All but the last return the columns of
`documents`.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.decontamination import contaminated
from plumbline.llm.mixing import mix_rows, numbered_copies, row_hash
from plumbline.llm.near_duplicates import near_duplicates
from plumbline.llm.quality import keep_good, train
from plumbline.llm.suite import END_ID, tokenizer_path
from plumbline.llm.token_files import encode_to_files
from plumbline.session import in_fewer_tasks, remove_tables, settle, settle_narrow, settled_tables


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled ones among `docs`.

    Whole texts of any length are scored; a null text counts as empty, an empty one has a score like any other. Rows that repeat share
    their fate. An empty table stays empty.
    """
    return keep_good(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by near duplicates the one with the smallest id, nulls last; of equal rows, one.

    Rows are told by a 64-bit hash of all their values, so rows that share an id or have none are rows of their own. Null, empty and
    blank texts are linked with nothing and stay, however often. An empty table stays empty; texts of any length are read whole.
    """
    keyed = docs.select(_row_key(docs).alias("key"), F.struct(*docs.columns).alias("row"))
    groups = settle_narrow(near_duplicates(keyed.select(F.col("key").alias("doc_id"), "row.text")).where("n_shingles > 0"))
    members = groups.groupBy("doc_id", "component_id").count().withColumnsRenamed({"doc_id": "key", "component_id": "component"})
    several = groups.where("doc_id <> component_id").select(F.col("component_id").alias("component")).distinct()
    linked = members.join(several, "component", "left_semi").join(keyed.select("key", "row.doc_id").distinct(), "key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    kept = settle_narrow(linked.groupBy("component").agg(first).select("component", F.col("first.key").alias("key")))
    others = members.join(several, "component", "left_semi").join(kept, "key", "left_anti").select("key", F.lit(True).alias("goes"))
    repeated = members.where("count > 1").join(others, "key", "left_anti").select("key", F.lit(False).alias("goes"))
    marks = settle_narrow(others.unionByName(repeated))
    met = keyed.join(marks, "key", "left")
    alone = met.where("goes IS NULL").select("row.*")
    if marks.where("NOT goes").isEmpty():
        return alone
    return alone.unionByName(met.where("NOT goes").select("row.*").dropDuplicates())


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no copy of a test item, told by the text alone: equal texts share their fate, equal ids do not.

    A null or empty text holds nothing and stays. Without items all rows stay; an empty table stays empty.
    """
    keyed = docs.select(F.xxhash64("text").alias("key"), F.struct(*docs.columns).alias("row"))
    found = contaminated(keyed.select(F.col("key").alias("doc_id"), "row.text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    dirty = settle_narrow(found.select(F.col("doc_id").alias("key")).distinct())
    return keyed.join(dirty, "key", "left_anti").select("row.*")


def _row_key(docs: DataFrame):
    """A hash of all values of a row."""
    return F.xxhash64(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, to the nearest whole number of times, with or without an id.

    A row's taken words by its words, rounded, is its number of copies; equal rows add theirs up. A null or empty text and a row of
    no words has nothing to be taken and goes. A null source is a source of its own. An empty table stays empty.
    """
    key = row_hash(*docs.columns)
    copies = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5)
    taken = mix_rows(docs, key).groupBy("key").agg(F.sum(copies).alias("copies"), F.count(F.lit(1)).alias("rows"))
    taken = settle_narrow(taken.where("copies > 0"))
    met = docs.select(key.alias("key"), F.struct(*docs.columns).alias("row")).join(taken, "key")
    single = met.where("rows = 1")
    out = single.withColumn("n", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("row.*")
    if taken.where("rows > 1").isEmpty():
        return out
    # Equal rows: one of them, as often as all are taken together.
    repeated = met.where("rows > 1").dropDuplicates(["key"])
    return out.unionByName(numbered_copies(repeated, F.col("copies"), "n", ["key"]).select("row.*"))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in seekable files, and what is read back from them.

    A null or empty text is the end id alone; rows without id come first. An empty table gives no row.
    """
    return encode_to_files(docs, tokenizer_path(), END_ID)


#: Rows and bytes of a batch between the JVM and Python at most. By Spark's defaults, 10000 rows and 64 MB, each core holds several
#: copies of some 30 MB of texts on either side, outside the JVM's heap, and neither side gives all of that back.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1 << 10, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
#: Tables that the last stage settled; its result is written before the next one begins.
_LEFT: list[str] = []


def _short_batches(spark: SparkSession) -> None:
    """From here on the session's batches are within BATCH; how texts are dealt to batches changes no result.

    The setting stays, as a stage's result is computed after the stage has returned.
    """
    for name, most in BATCH.items():
        spark.conf.set(name, str(most))


def _tidy(stage):
    """The stage in short batches and written as fewer files, which first deletes what the one before it has settled and nobody reads any more."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _short_batches(spark)
        remove_tables(spark, _LEFT, [docs])
        with settled_tables() as made:
            out = in_fewer_tasks(stage(spark, docs, sf_dir))
        _LEFT.extend(made)
        return out

    return run_stage


STAGES = [
    ("quality classifier", _tidy(good_quality)),
    ("n-gram Jaccard join", _tidy(one_of_each_group)),
    ("benchmark decontamination", _tidy(without_benchmark)),
    ("mixing sources to target weights", _tidy(mixed_sources)),
    ("token-ID / binary output", _tidy(token_files)),
]

#: SQL cannot express the trained classifier, the alignment or the encoder; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`: (doc_id, start, n_tokens, ids_crc32) per row of the corpus, as read back from its token files.

    Each stage's result is written in the shared folder and read by the next; a result goes when the next one is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for _, stage in STAGES:
        with settled_tables() as made:
            docs = settle(stage(spark, docs, sf_dir))
        remove_tables(spark, before)
        before = made[-1:]
    return docs
