"""Polygon validity by the plane sweep against a judgement that compares all pairs of sides in exact fractions."""

from __future__ import annotations

import math
import random
import time
from fractions import Fraction as Fr

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.rings import member_valid, short_rings_valid
from plumbline.functions.wkb import decode_wkb, geometry, polygons_wkb


def turn(a, b, c):
    told = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return (told > 0) - (told < 0)


def on(a, b, p):
    return turn(a, b, p) == 0 and min(a, b) <= p <= max(a, b)


def sides(ring):
    run = [p for k, p in enumerate(ring) if k == 0 or p != ring[k - 1]]
    return list(zip(run, run[1:]))


def inside(ring, p):
    hit = False
    for a, b in sides(ring):
        if (a[1] > p[1]) != (b[1] > p[1]) and (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] > p[0]:
            hit = not hit
    return hit


def middles(ring, other):
    """A place between any two neighbouring corners of either ring on the first."""
    for a, b in sides(ring):
        stops = sorted({a, b} | {p for s in sides(other) for p in s if on(a, b, p)})
        yield from (((p[0] + q[0]) / 2, (p[1] + q[1]) / 2) for p, q in zip(stops, stops[1:]))


def by_all_pairs(polygons) -> bool:
    polygons = [[[(Fr(x), Fr(y)) for x, y in ring] for ring in rings] for rings in polygons]
    labelled = [(k, i > 0, ring) for k, rings in enumerate(polygons) for i, ring in enumerate(rings)]
    for _, _, ring in labelled:
        if len(ring) < 4 or ring[0] != ring[-1] or len(set(ring)) < 3:
            return False
        run = sides(ring)
        for i, (a, b) in enumerate(run):
            for j in range(i + 1, len(run)):
                c, d = run[j]
                if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
                    return False
                shared = {p for p in (a, b) if on(c, d, p)} | {p for p in (c, d) if on(a, b, p)}
                expected = ({b} if j == i + 1 else set()) | ({a} if i == 0 and j == len(run) - 1 else set())
                if shared - expected:
                    return False
    links = []
    for m, (k, hole, ring) in enumerate(labelled):
        for k2, hole2, other in labelled[m + 1 :]:
            touches = set()
            for a, b in sides(ring):
                for c, d in sides(other):
                    if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
                        return False
                    shared = {p for p in (a, b) if on(c, d, p)} | {p for p in (c, d) if on(a, b, p)}
                    if len(shared) > 1:
                        return False
                    touches |= shared
            for one, two in ((ring, other), (other, ring)):
                if len({inside(two, p) for p in middles(one, two)}) > 1:
                    return False
            if k == k2:
                within, holds = inside(ring, next(middles(other, ring))), inside(other, next(middles(ring, other)))
                if (hole and (within or holds)) or (not hole and not within):
                    return False
            links += [(id(ring), p, k) for p in touches if k == k2] + [(id(other), p, k) for p in touches if k == k2]
    for k, rings in enumerate(polygons):
        for k2, others in enumerate(polygons):
            if k != k2:
                p = next(middles(rings[0], others[0]))
                around = [h for h in others[1:] if inside(h, next(middles(rings[0], h)))]
                if inside(others[0], p) and not around:
                    return False
    # Rings and the places where they meet make a forest in each polygon.
    edges = {((r, k), (p, k)) for r, p, k in links}
    group: dict = {}

    def root(n):
        while group.get(n, n) != n:
            n = group[n]
        return n

    for a, b in edges:
        if root(a) == root(b):
            return False
        group[root(a)] = root(b)
    return True


def swept(polygons) -> bool:
    flat = [(np.array(ring, float).reshape(-1, 2), i > 0) for rings in polygons for i, ring in enumerate(rings)]
    return member_valid([r for r, _ in flat], [h for _, h in flat])


def close(run):
    return [*run, run[0]]


def some_ring(draw, size):
    """A box, a triangle or a run of any places, from either end, from any corner."""
    x, y = draw.randint(0, size), draw.randint(0, size)
    u, v = draw.randint(1, 3), draw.randint(1, 3)
    kind = draw.random()
    if kind < 0.45:
        run = [(x, y), (x + u, y), (x + u, y + v), (x, y + v)]
    elif kind < 0.7:
        run = [(x, y), (x + u, y + draw.randint(0, 2)), (x, y + v)]
    elif kind < 0.85:
        run = [(x, y), (x + u, y + v), (x, y + 2 * v), (x - u, y + v)]
    else:
        run = [(draw.randint(0, size), draw.randint(0, size)) for _ in range(draw.randint(3, 6))]
    at = draw.randrange(len(run))
    run = run[at:] + run[:at]
    return close(run[::-1] if draw.random() < 0.5 else run)


def test_single_rings_like_all_pairs():
    draw, seen = random.Random(5), {True: 0, False: 0}
    for _ in range(3000):
        size, n = draw.choice([2, 4, 9, 40]), draw.randint(3, 8)
        ring = close([(draw.randint(0, size), draw.randint(0, size)) for _ in range(n)])
        want = by_all_pairs([[ring]])
        seen[want] += 1
        assert swept([[ring]]) is want, ring
    assert min(seen.values()) > 250


@pytest.mark.parametrize("seed", range(4))
def test_holes_and_several_polygons_like_all_pairs(seed):
    draw, seen = random.Random(seed), {True: 0, False: 0}
    frame = [(0, 0), (9, 0), (9, 9), (0, 9)]
    for _ in range(1000):
        polygons = []
        if draw.random() < 0.7:
            polygons.append([close(frame)] + [some_ring(draw, 7) for _ in range(draw.randint(0, 3))])
        for _ in range(draw.randint(0 if polygons else 1, 2)):
            polygons.append([some_ring(draw, 10)] + ([some_ring(draw, 8)] if draw.random() < 0.2 else []))
        draw.shuffle(polygons)
        want = by_all_pairs(polygons)
        seen[want] += 1
        assert swept(polygons) is want, polygons
    assert min(seen.values()) > 80


def test_nearly_collinear_corners_are_told_exactly():
    # Doubles alone call these corners collinear; the middle one lies a last digit above or below the side.
    for base in (0.1, 1e8 + 0.3, 1e-200, 1e160):
        for step in (-1, 0, 1):
            low, high, middle = base, base * 3, base * 2
            bent = np.nextafter(middle, middle + step * base) if step else middle
            ring = [(low, low), (high, high), (high, low), (middle, bent), (low, low)]
            exact = by_all_pairs([[ring]])
            assert swept([[ring]]) is exact
    tiny = 5e-324
    assert swept([[[(0.0, 0.0), (tiny, 0.0), (0.0, tiny), (0.0, 0.0)]]])


def test_edge_cases():
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    assert swept([]) and swept([[[]]]) and swept([[square]])
    assert not swept([[[], square]])
    assert swept([[[(0, 0), (0, 0), (4, 0), (4, 0), (4, 4), (0, 4), (0, 4), (0, 0)]]])
    assert not swept([[square], [square]]) and not swept([[square, square]])
    assert not swept([[[(0, 0), (1, 1), (0, 0)]]]) and not swept([[[(0, 0), (1, 1), (2, 2), (0, 0)]]])
    for wrong in (float("nan"), float("inf")):
        assert not swept([[[(0, 0), (4, 0), (4, wrong), (0, 4), (0, 0)]]])
    assert swept([[[(-0.0, 0.0), (4, 0), (4, 4), (0, 4), (0.0, -0.0)]]])


def test_comparisons_grow_with_n_log_n():
    def comb(teeth):
        top = [(2 * k + half, 10 if half else 1) for k in range(teeth) for half in (0, 1)]
        return close([(-1, 0), (2 * teeth, 0), *reversed(top)])

    def took(n):
        began = time.process_time()
        assert swept([[comb(n)]])
        return time.process_time() - began

    took(100)
    assert took(40000) < 40 * max(took(4000), 0.02)


def test_through_spark_with_nulls_lines_and_collections(spark):
    import struct

    from tests.test_profiles import wkb, xy

    square = ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
    inner = ((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))

    def polygon(*rings):
        return wkb(3, struct.pack("<I", len(rings)), *[xy(*r) for r in rings])

    def several(code, *members):
        return wkb(code, struct.pack("<I", len(members)), *members)

    cases = [
        (several(6, polygon(square), polygon(inner)), False),
        # The members of a collection are judged one by one.
        (several(7, polygon(square), polygon(inner)), True),
        (several(7, polygon(square), several(6, polygon(square), polygon(inner))), False),
        (several(7, several(6, polygon(square)), several(6, polygon(inner)), wkb(2, xy((0, 0), (1, 1)))), True),
        (several(6, polygon(square, inner), polygon(((1, 1), (2, 2), (1, 2), (1, 1)))), False),
        (polygon(square, inner), True),
        (polygon(), True),
        (several(6), True),
        (wkb(2, xy((0, 0), (float("inf"), 1))), False),
        (None, None),
    ]
    df = spark.createDataFrame([(k, blob) for k, (blob, _) in enumerate(cases)], "k int, w binary").coalesce(1)
    got = df.select("k", decode_wkb("w").alias("d")).select("k", geometry(F.col("d")).alias("g")).orderBy("k").collect()
    assert [r["g"] and r["g"]["is_valid"] for r in got] == [want for _, want in cases]
    none = spark.createDataFrame([], "w binary").select(decode_wkb("w").alias("d")).select(geometry(F.col("d")).alias("g"))
    assert none.collect() == []


def test_written_polygons_come_back(spark):
    shape = "array<array<array<struct<x:double,y:double>>>>"
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    rows = [(0, [[square]]), (1, [[square], [square]]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, f"k int, s {shape}").select("k", polygons_wkb("s").alias("w"))
    got = df.select("k", decode_wkb("w").alias("d")).orderBy("k").collect()
    assert [r["d"] and (r["d"]["type"], len(r["d"]["parts"])) for r in got] == [("POLYGON", 1), ("MULTIPOLYGON", 2), ("MULTIPOLYGON", 0), None]


@pytest.mark.parametrize("corners", [3, 4, 5, 7])
def test_short_rings_together_like_the_sweep(corners):
    """Rings judged as arrays: whole coordinates need no sweep, others where doubles can tell the turns."""
    rng = random.Random(corners)
    places = [lambda: rng.randrange(5), lambda: 2_600_000 + rng.randrange(9), lambda: rng.uniform(0, 1), lambda: rng.choice([0.1, 0.2, 0.3, 0.7])]
    rings = [close([(place(), place()) for _ in range(corners)]) for place in places for _ in range(400)]
    rings += [[*rings[0][:-1], (99, 99)], [(math.nan, 0), *rings[0][1:]]]
    xy = np.array(rings, float)
    valid, told = short_rings_valid(xy)
    alone = np.array([member_valid([r], [False]) for r in xy])
    assert (valid[told] == alone[told]).all() and 0 < alone[:-2].sum() < len(alone)
    repeated = np.array([any(a == b for a, b in zip(r, r[1:])) for r in rings])
    assert told[:800][~repeated[:800]].all() and told[800:1200].mean() > 0.99 and told[-2:].all()


def test_shapes_are_judged_by_all_cores(spark):
    from plumbline.plans.suite.preparation import _shapes

    tasks = _shapes(spark, "/root/testdata/sf0.01").filter("length(wkb) > 0").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 3 * spark.sparkContext.defaultParallelism
