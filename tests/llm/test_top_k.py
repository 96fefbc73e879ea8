"""Exact search against all inner products."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from plumbline.llm.top_k import exact_top_k

SCHEMA = "vec_id bigint, embedding array<double>, score string"


def brute(rows, k):
    good = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in {(i, tuple(v)) for i, v in good if i % 10 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_same_as_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(500)]
    # One vector many times, ties, repeated rows, null and endless components.
    rows += [(i, [0.5] * 8) for i in range(1000, 1200)] + [(1201, [0.5] * 8)] * 3
    rows += [(None, [1.0] * 8), (2000, None), (2010, [1.0, None] + [0.0] * 6), (2020, [math.nan] * 8), (2030, [math.inf] * 8)]
    rows += [(3000, []), (3010, [1.0]), (4000, [1e12] * 8), (4010, [-1e12] * 8)]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(4)
    got = exact_top_k(vectors, F.col("vec_id") % 10 == 0, k=5, n_pivots=7).collect()
    clip = lambda s: max(-(2**63 - 1), min(2**63 - 1, s))
    assert sorted(map(tuple, got)) == [(q, r, i, clip(s)) for q, r, i, s in brute(rows, 5)]


def test_few_and_none(spark):
    two = spark.createDataFrame([(0, [1.0], "x"), (1, [2.0], "x")], SCHEMA)
    assert [tuple(r) for r in exact_top_k(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert exact_top_k(two.limit(0), F.lit(True)).count() == 0
    assert exact_top_k(two, F.lit(None).cast("boolean")).count() == 0
