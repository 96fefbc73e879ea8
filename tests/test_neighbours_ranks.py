"""Nearest neighbours, ranks, adjusted p-values and local statistics against plain versions."""

from __future__ import annotations

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.hexgrid import cell_of, edge_of, shifted
from plumbline.functions.stats import normal_tail
from plumbline.operators import neighbours
from plumbline.operators.hot_spots import hex_offsets, local_statistics
from plumbline.operators.neighbours import nearest_neighbours
from plumbline.operators.ranking import adjusted_p, value_ranks


def search(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "key long, x double, y double, neighbour string")
    found = nearest_neighbours(df, "key", F.col("x"), F.col("y"), **sizes)
    assert found.columns == ["key", "neighbour", "distance"]
    out = [tuple(r) for r in found.collect()]
    assert len(out) == len({k for k, _, _ in out})
    return {k: (n, d) for k, n, d in out}


def by_all_pairs(rows):
    used = [(k, x, y) for k, x, y, _ in rows if k is not None and all(v is not None and math.isfinite(v) for v in (x, y))]
    out = {}
    for k, x, y in used:
        near = min((((a - x) ** 2 + (b - y) ** 2, n) for n, a, b in used if n != k), default=None)
        out[k] = (near[1], math.sqrt(near[0])) if near else (None, None)
    return out


@pytest.mark.parametrize("sizes", [{}, {"cell_sites": 1, "part_sites": 2}])
def test_neighbours_equal_all_pairs(spark, sizes):
    rng = random.Random(3)
    spots = [(rng.uniform(-500, 500), rng.uniform(-500, 500)) for _ in range(60)]
    spots += [(1e6 + rng.uniform(0, 1e-3), -1e6 + rng.uniform(0, 1e-3)) for _ in range(60)]  # a crowd far away
    spots += [(float(i % 6), float(i // 6)) for i in range(36)]  # ties on a grid, cell edges
    spots += [(7.5, 7.5)] * 30 + [(0.0, -0.0), (-0.0, 0.0)]  # repeated, zeros of both signs
    spots += [(3e7, 0.0)]  # alone
    keys = list(range(len(spots)))
    rng.shuffle(keys)
    rows = [(k, x, y, "z") for k, (x, y) in zip(keys, spots)]
    rows += [(None, 1.0, 1.0, "z"), (9001, None, 1.0, "z"), (9002, 1.0, math.nan, "z"), (9003, math.inf, 1.0, "z")]
    assert search(spark, rows, **sizes) == by_all_pairs(rows)


def test_neighbours_of_none_one_and_two_rows(spark):
    assert search(spark, []) == {}
    assert search(spark, [(1, 2.0, 3.0, "z")]) == {1: (None, None)}
    assert search(spark, [(1, 2.0, 3.0, "z"), (2, 2.0, 3.0, "z")]) == {1: (2, 0.0), 2: (1, 0.0)}
    assert search(spark, [(1, 0.0, 0.0, "z"), (2, 3.0, 4.0, "z")]) == {1: (2, 5.0), 2: (1, 5.0)}


def test_sites_are_sent_to_tiles_a_bounded_number_of_times(spark, monkeypatch):
    """Rows shuffled to be searched, per site, with a dense square among sparse sites; the answers stay exact."""
    sent = []
    nearest = neighbours._nearest_held
    monkeypatch.setattr(neighbours, "_nearest_held", lambda rows: (sent.append(rows.count()), nearest(rows))[1])
    rng = random.Random(9)
    rows = [(k, rng.randrange(100000) / 1.0, rng.randrange(100000) / 1.0, "z") for k in range(1000)]
    rows += [(1000 + k, 5e4 + rng.randrange(9000) / 1024, 5e4 + rng.randrange(9000) / 1024, "z") for k in range(2000)]
    assert search(spark, rows, cell_sites=128) == by_all_pairs(rows)
    assert len(sent) == 2 and sent[0] == len(rows) and sent[1] < 2 * len(rows)


def test_a_cell_crowded_at_the_lowest_level_is_searched_part_by_part(spark):
    unit = 2.0**-90
    rows = [(k, (k * 37 % 41) * unit, (k * 11 % 17) * unit, "z") for k in range(40)] + [(99, 2.0**20, 0.0, "z")]
    assert search(spark, rows, cell_sites=8, part_sites=5) == by_all_pairs(rows)


def test_ranks_across_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([float(rng.randrange(40)), 7.0, None, -0.0])) for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.v): (r.n, r.below, r.total, r.average_rank) for r in value_ranks(df, ["g"], "v", ranges=7).collect()}
    for g in ("a", "b", None):
        values = [v for k, v in rows if k == g and v is not None]
        for v in set(values):
            n, below = values.count(v), sum(w < v for w in values)
            assert got.pop((g, v)) == (n, below, len(values), below + (n + 1) / 2)
    assert not got


def step_up(ps):
    """Benjamini-Hochberg by its definition: the least level at which a p-value is rejected."""
    order = sorted(ps)
    return {p: min(1.0, min(q * len(ps) / sum(r <= q for r in ps) for q in order if q >= p)) for p in order}


@pytest.mark.parametrize("ranges", [1, 2, 9])
def test_adjusted_p_equals_definition(spark, ranges):
    rng = random.Random(ranges)
    rows = [(g, rng.choice([rng.random() ** 4, 0.01, 0.5, 1.0, 0.0])) for g in (1, 1, 1, 2, None) for _ in range(60)]
    rows += [(1, None), (3, None)]
    df = spark.createDataFrame(rows, "g int, p double")
    out = [tuple(r) for r in adjusted_p(df, "p", ["g"], ranges=ranges).collect()]
    assert sorted(map(str, ((g, p) for g, p, _ in out))) == sorted(map(str, rows))
    for g in (1, 2, None):
        want = step_up([p for k, p in rows if k == g and p is not None])
        for p, q in ((p, q) for k, p, q in out if k == g):
            assert q is None if p is None else q == pytest.approx(want[p], rel=1e-12)
    assert adjusted_p(df.limit(0), "p").count() == 0


def test_every_p_value_finds_its_rank_whatever_it_is_worked_out_to(spark):
    """P-values whose last digits change from one computation to the next, as those from sums of doubles do."""
    drawn = F.udf(lambda: int.from_bytes(os.urandom(6)) / 2.0**48, "double").asNondeterministic()
    out = adjusted_p(spark.range(50).select("id", drawn().alias("p")), "p")
    got = [tuple(r) for r in out.select("p", "p_adjusted").collect()]
    want = step_up([p for p, _ in got])
    assert len(got) == 50 and all(q == pytest.approx(want[p], rel=1e-12) for p, q in got)


def test_no_window_without_partition(spark, capsys):
    df = spark.createDataFrame([(0.1,), (0.2,)], "p double")
    adjusted_p(df, "p").explain()
    plan = capsys.readouterr().out
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan


def test_normal_tail(spark):
    zs = [-9.0, -2.5, -1.0, 0.0, 0.3, 1.0, 1.9999, 2.0, 2.5, 4.0, 8.0, 20.0]
    df = spark.createDataFrame([(z,) for z in zs] + [(None,)], "z double").withColumn("p", normal_tail(F.col("z")))
    for z, p in df.collect():
        if z is None:
            assert p is None
        else:
            assert p == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, rel=1e-5)


def test_local_statistics_find_the_planted_cluster(spark):
    rng = random.Random(11)
    start = spark.range(1).select(cell_of(F.lit(2600000.0), F.lit(1200000.0), F.lit(7), F.lit(edge_of(7)))).first()[0]
    place = [(q, r) for q in range(-12, 13) for r in range(-12, 13)]
    rows = [(q, r, (60.0 if (q, r) in hex_offsets(1) else 10.0) + rng.random()) for q, r in place]
    df = spark.createDataFrame(rows, "q int, r int, v double").select(
        F.lit(7).alias("resolution"), shifted(F.lit(start), F.col("q"), F.col("r")).alias("cell"), "v", "q", "r"
    )
    at = {r.cell: (r.q, r.r) for r in df.collect()}
    out = {at[r.cell]: r for r in local_statistics(df.drop("q", "r"), "v").collect()}
    assert max(out, key=lambda c: out[c].gi_star) == (0, 0)
    assert {c for c, r in out.items() if r.gi_p_adjusted < 0.01} >= set(hex_offsets(1))
    assert out[0, 0].n_near == 7 and out[12, 12].n_near == 3
    values = {(q, r): v for q, r, v in rows}
    mean = sum(values.values()) / len(values)
    var = sum((v - mean) ** 2 for v in values.values()) / len(values)
    for q, r in ((0, 0), (3, -2), (12, 12), (-12, 5)):
        near = [values[q + a, r + b] for a, b in hex_offsets(1) if (q + a, r + b) in values]
        n, k = len(values), len(near)
        gi = (sum(near) - k * mean) / math.sqrt(var * k * (n - k) / (n - 1))
        moran = (values[q, r] - mean) * (sum(near) - values[q, r] - (k - 1) * mean) / var
        assert out[q, r].gi_star == pytest.approx(gi) and out[q, r].moran == pytest.approx(moran)
    equal = local_statistics(df.drop("q", "r").withColumn("v", F.lit(1.0)), "v")
    assert equal.filter("gi_star IS NOT NULL OR moran IS NOT NULL OR gi_p_adjusted IS NOT NULL").count() == 0
    assert local_statistics(df.limit(0), "v").count() == 0
