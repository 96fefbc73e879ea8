"""Correlation matrix and contingency against plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from plumbline.operators import crossed
from plumbline.operators.crossed import contingency, correlations


def by_pairs(rows, i, j):
    def ranks(c):
        values = sorted(r[c] for r in rows if r[c] is not None and math.isfinite(r[c]))
        return {v: values.index(v) + (values.count(v) + 1) / 2 for v in set(values)}

    used = [(r[i], r[j]) for r in rows if all(r[c] is not None and math.isfinite(r[c]) for c in (i, j))]
    ri, rj = ranks(i), ranks(j)

    def r(pairs):
        x, y = (np.array(v, dtype=float) for v in zip(*pairs))
        x, y = x - x.mean(), y - y.mean()
        return float((x * y).sum() / math.sqrt((x * x).sum() * (y * y).sum()))

    return len(used), r(used), r([(ri[a], rj[b]) for a, b in used])


def test_correlations_with_gaps_ties_and_far_means(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        a = rng.gauss(0, 1)
        rows.append((
            a, rng.choice([None, round(a * 2), math.nan, 3.0]), 1e9 + a + rng.gauss(0, 0.1), math.exp(3 * a),
            rng.choice([0.0, -0.0, math.inf, 5.0]),
        ))
    rows = [tuple(None if v is None else float(v) for v in r) for r in rows]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(5)
    names = df.columns
    out = {(r.column_a, r.column_b): r for r in correlations(df, names).collect()}
    assert len(out) == 10
    for (a, b), r in out.items():
        n, pearson, spearman = by_pairs(rows, names.index(a), names.index(b))
        assert r.n == n
        assert r.pearson == pytest.approx(pearson, abs=1e-9) and r.spearman == pytest.approx(spearman, abs=1e-9)
    assert out["a", "d"].spearman == pytest.approx(1.0) and out["a", "d"].pearson < 0.9


def test_correlations_without_spread_or_rows(spark):
    df = spark.createDataFrame([(0.1, float(i), None) for i in range(9)], "a double, b double, c double")
    got = {(r.column_a, r.column_b): (r.n, r.pearson, r.spearman) for r in correlations(df, ["a", "b", "c"]).collect()}
    assert got == {("a", "b"): (9, None, None), ("a", "c"): (0, None, None), ("b", "c"): (0, None, None)}
    none = correlations(df.limit(0), ["a", "b"]).collect()
    assert [(r.n or 0, r.pearson, r.spearman) for r in none] == [(0, None, None)]
    with pytest.raises(ValueError):
        correlations(df, ["a"])


def test_contingency_of_a_hot_value(spark):
    rng = random.Random(8)
    rows = [(rng.choice("xxxxy"), rng.choice(["1", "2", None, "3"]), "k") for _ in range(500)]
    rows += [("z", "9", "k")] * 300  # found together only
    df = spark.createDataFrame(rows, "a string, b string, c string")
    out = {(r.column_a, r.column_b): r for r in contingency(df, ["a", "b", "c"]).collect()}
    pairs = [(a, b) for a, b, _ in rows if b is not None]
    n, both, left, right = len(pairs), Counter(pairs), Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    chi = sum((both[a, b] - left[a] * right[b] / n) ** 2 / (left[a] * right[b] / n) for a in left for b in right)
    bits = sum(o / n * math.log2(o * n / (left[a] * right[b])) for (a, b), o in both.items())
    r = out["a", "b"]
    assert (r.n, r.n_a, r.n_b) == (n, 3, 4)
    assert r.chi_square == pytest.approx(chi) and r.mutual_bits == pytest.approx(bits)
    assert r.cramers_v == pytest.approx(math.sqrt(chi / (n * 2)))
    assert out["a", "c"].cramers_v is None and out["a", "c"].chi_square == pytest.approx(0, abs=1e-9)
    same = contingency(df.select("a", df.a.alias("again")), ["a", "again"]).first()
    assert same.cramers_v == pytest.approx(1.0)
    assert contingency(df.limit(0), ["a", "b"]).count() == 0


def test_ranks_come_together_in_tasks_of_bounded_size(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1.0, 2.0, rng.random()]), float(rng.randrange(9)), rng.random()) for _ in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(3)
    sizes = []
    settled = crossed.settle

    def watched(table):
        out = settled(table)
        sizes.append(max((r["n"] for r in table.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()), default=0))
        return out

    whole = [tuple(r) for r in correlations(df, ["a", "b", "c"]).collect()]
    monkeypatch.setattr(crossed, "settle", watched)
    monkeypatch.setattr(crossed, "ROWS_PER_TASK", 10)
    parts = [tuple(r) for r in correlations(df, ["a", "b", "c"]).collect()]
    assert sizes[1] < 40
    for one, two in zip(sorted(whole), sorted(parts), strict=True):
        assert one[:3] == two[:3] and one[3:] == pytest.approx(two[3:], abs=1e-12)
