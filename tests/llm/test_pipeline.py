"""The pipeline's stages, each on its own input, and the contract of the entry point."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from plumbline.llm import suite
from tests.llm.test_mixing import filled

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    more = spark.createDataFrame(
        [(None, item, None, None, 1), (None, "no id and good words enough", None, "a", 1), (90001, None, "en", "a", 1)],
        docs.schema,
    )
    docs = docs.unionByName(more)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    kept = {}
    for name, stage in list(stages.items())[:4]:
        found = stage(spark, docs, SMALL)
        assert found.columns == COLUMNS
        kept[name] = found.collect()
    one = kept["n-gram Jaccard join"]
    ids = [r.doc_id for r in one if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and sum(r.doc_id is None for r in one) == 2 and 90001 in ids
    clean = kept["benchmark decontamination"]
    assert all(item not in (r.text or "") for r in clean) and any(r.doc_id is None for r in clean)
    mixed = kept["mixing sources to target weights"]
    assert max(sum(x.doc_id == r.doc_id for x in mixed) for r in mixed[:20]) <= 3
    last = stages["token-ID / binary output"](spark, docs, SMALL)
    assert last.count() == docs.count()


def test_a_run(spark):
    first, second = (sorted(map(str, corpus_pipeline.run(spark, SMALL).collect())) for _ in range(2))
    assert first and first == second


def test_registered():
    import __spark_entry__ as contract

    names = contract.queries()
    assert "pipeline" in names and set(suite.QUERIES) <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in suite.QUERIES) == list(range(1, 14))


def test_rows_without_id_are_mixed_by_their_own_source(spark):
    rng = random.Random(3)
    rows = []
    for source, n in (("a", 60), ("b", 300), ("c", 900), (None, 40)):
        for i in range(n):
            text = " ".join([f"{source}{i}"] * rng.choice([1, 8, 30]))
            rows.append((None if i % 4 else len(rows), text, "en", source, len(text)))
    rows += [(None, "the same words again and again", "en", "c", 30)] * 200 + [(7, "one id, another text", "en", "b", 20)] * 3 + [(None, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int").repartition(3)
    found = [tuple(r) for r in corpus_pipeline.mixed_sources(spark, docs, SMALL).collect()]
    size, held = Counter(), Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    for r in found:
        held[r[3]] += len((r[1] or "").split())
    for source, want in filled(size).items():
        assert abs(held[source] - want) <= 60, (source, held[source], want)
    had, got = Counter(rows), Counter(found)
    assert all(n <= 3 * had[r] for r, n in got.items())
    # Only the last few words of a source's blocks may be missing.
    assert sum(got[r] < 3 * n for r, n in had.items() if r[3] == "a" and r[1]) <= 5
    again = [tuple(r) for r in corpus_pipeline.mixed_sources(spark, docs.repartition(5), SMALL).collect()]
    assert Counter(again) == got


def test_batches_of_a_stage_are_short(spark):
    """Batches of texts lie outside the JVM's heap on both sides, several per core: neither rows nor long texts fill them."""
    names = [f"spark.sql.execution.arrow.{n}" for n in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = {n: spark.conf.get(n) for n in names}

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

    def stage(session, docs, sf_dir):
        return docs.mapInArrow(sizes, "n bigint, size bigint")

    try:
        for rows, length in ((5000, 100), (900, 20000)):
            docs = spark.range(rows).coalesce(1).selectExpr("id", f"repeat('a', {length}) AS text")
            found = corpus_pipeline._tidy(stage)(spark, docs, SMALL).collect()
            assert sum(r.n for r in found) == rows
            assert max(r.n for r in found) <= 1 << 10 and max(r.size for r in found) <= 5 << 20
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)
