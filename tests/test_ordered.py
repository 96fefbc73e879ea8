"""Bucketed scans equal plain windows, whatever the bucket width."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators.ordered import running_max, running_number
from plumbline.sources.local import inline_rows


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for group in ("hot", "b", "c"):
        for i in range(600 if group == "hot" else 7):
            data.append((group, i * rng.choice([1, 3]) - 20, i, rng.choice([None, rng.randrange(100)])))
    data += [(None, i * 1_000_003, i, i) for i in range(30)]
    data += [(g, None, i, i * 3) for g in ("hot", "b", None) for i in range(4)]
    data += [("sparse", (i - 50) * 10**13, i, i) for i in range(100)]
    return inline_rows(spark, "g string, at bigint, tie int, v bigint", data)


@pytest.mark.parametrize("width", [1, 7, 64, 1 << 16])
def test_scans(rows, width):
    order = ["at", "tie"]
    w = Window.partitionBy("g").orderBy(*(F.col(c).asc_nulls_last() for c in order))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    plain = rows.select(
        "*",
        F.row_number().over(w).cast("bigint").alias("n"),
        F.max("v").over(before).alias("m"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("l"),
    )
    out = running_number(rows, ["g"], order, "n", width)
    out = running_max(out, ["g"], order, "v", "m", width)
    out = running_max(out, ["g"], order, "v", "l", width, inclusive=True)
    assert sorted(map(str, out.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
