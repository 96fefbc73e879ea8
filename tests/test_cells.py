"""Cells, scale robustness and catalog lookups on the three-cluster fixture."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.hexgrid import EDGE_METRES, ORIGIN, cell_centre, cell_of
from plumbline.functions.lv95 import to_wgs84
from plumbline.operators import cells as c
from plumbline.operators.prepare import lattice_clusters
from plumbline.plans.scale_robustness import declared_scale_robustness, scale_robustness, scale_verdict
from plumbline.sources.catalog import catalog_from_entries
from plumbline.sources.exposure import exposure_grid
from plumbline.sources.local import inline_rows
from plumbline.sources.tables import (
    bounded_view,
    checked_name,
    guarded_path,
    safe_name,
    safe_name_column,
    schema_of,
    write_parquet,
)

CLUSTERS = [(20, 2600000, 1200000), (40, 2604000, 1200000), (10, 2608000, 1200000)]


def points(spark):
    return lattice_clusters(spark, CLUSTERS)


def population(spark):
    return inline_rows(
        spark, "east double, north double, population int",
        [(2600000.0, 1200000.0, 5000), (2604000.0, 1200000.0, 20)],
    )


def grid(spark):
    return exposure_grid(population(spark), "east", "north", "population", 100, "sw_corner")


def test_cell_is_the_nearest_centre(spark):
    rng = random.Random(2)
    pts = [(ORIGIN[0] + rng.uniform(-9000, 9000), ORIGIN[1] + rng.uniform(-9000, 9000)) for _ in range(400)]
    edge = EDGE_METRES[7]
    df = inline_rows(spark, "x double, y double", pts)
    cell = cell_of(F.col("x"), F.col("y"), F.lit(7), F.lit(edge))
    cx, cy = cell_centre(F.col("cell"), F.lit(edge))
    for r in df.withColumn("cell", cell).withColumn("cx", cx).withColumn("cy", cy).collect():
        q0 = round((r["cx"] - ORIGIN[0]) / edge)
        best = min(
            math.hypot(r["x"] - ORIGIN[0] - math.sqrt(3) * edge * (q + s / 2), r["y"] - ORIGIN[1] - 1.5 * edge * s)
            for q in range(-16 + 0 * q0, 17)
            for s in range(-12, 13)
        )
        assert math.hypot(r["x"] - r["cx"], r["y"] - r["cy"]) == pytest.approx(best, abs=1e-6)


def test_reprojection_of_the_origin(spark):
    df = inline_rows(spark, "x double, y double", [(2600000.0, 1200000.0)])
    lng, lat = to_wgs84(F.col("x"), F.col("y"))
    r = df.select(lng.alias("lng"), lat.alias("lat")).first()
    assert (round(r["lat"], 5), round(r["lng"], 5)) == (46.95108, 7.43864)
    with pytest.raises(ValueError):
        to_wgs84(F.col("x"), F.col("y"), 4326)


@pytest.mark.parametrize("resolution", [6, 7, 8])
def test_clusters_fall_into_three_cells(spark, resolution):
    counts = c.cell_counts(points(spark), "geom", [resolution])
    assert sorted(r["observed"] for r in counts.collect()) == [10, 20, 40]
    exposure = c.cell_exposure(grid(spark), [resolution])
    assert exposure.agg(F.sum("weight")).first()[0] == 5020
    r = c.unpopulated(c.split_cells(counts, exposure)).first()
    assert (r["n_cells"], r["n_points"], r["share"]) == (1, 10, 10 / 70)


def test_points_without_place_are_skipped(spark):
    df = inline_rows(
        spark, "geom struct<x: double, y: double>",
        [(None,), ({"x": None, "y": 1.0},), ({"x": 2600000.0, "y": 1200000.0},)],
    )
    assert [r["observed"] for r in c.cell_counts(df, "geom", [7]).collect()] == [1]


def test_excess_cluster_is_robust(spark):
    out = scale_robustness(points(spark), "geom", grid(spark), (7, 8)).collect()
    assert {r["verdict"] for r in out} == {"robuste"}
    for r in out:
        assert r["significant"] and r["pseudo_p"] == 0.001 and r["peak_std_excess"] > 0
        assert 46.9 < r["peak_lat"] < 47.0
        assert (r["n_cells_tested"], r["n_total_tested"], r["unpopulated_points"]) == (2, 60, 10)
    again = scale_robustness(points(spark).repartition(5), "geom", grid(spark), (7, 8)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_resolution_without_tested_cells_is_not_significant(spark):
    far = exposure_grid(inline_rows(spark, "e double, n double, w double", [(2500000.0, 1100000.0, 1.0)]), "e", "n", "w")
    r = scale_robustness(points(spark), "geom", far, (8,)).first()
    assert (r["n_cells_tested"], r["significant"], r["pseudo_p"], r["verdict"]) == (0, False, None, "absente")
    assert r["unpopulated_points"] == 70 and r["unpopulated_share"] == 1.0


def test_verdicts(spark):
    for flags, want in (((True, True), "robuste"), ((False, False), "absente"), ((True, False), "fragile")):
        df = inline_rows(spark, "significant boolean", [(f,) for f in flags])
        assert scale_verdict(df).first()["verdict"] == want


@pytest.mark.parametrize("bad", [(), (7, 7), (16,), (-1,)])
def test_bad_resolutions_are_errors(spark, bad):
    with pytest.raises(ValueError):
        scale_robustness(points(spark), "geom", grid(spark), bad)


ENTRIES = [
    """{"dataset": "spatial_seed", "columns": {"geom": {"type": "spatial", "srid": 2056, "geometry_type_attendu": "point"}},
        "exposures": {"geom": {"kind": "spatial_grid", "fiche": "population_seed", "weight": "population"}}}""",
    """{"dataset": "population_seed", "data": "population.parquet", "columns": {"east": {"type": "spatial", "srid": 2056}},
        "grid": {"east": "east", "north": "north", "cell_size": 100, "coord_ref": "sw_corner"}}""",
    """{"dataset": "bare", "columns": {"geom": {"type": "spatial", "srid": 2056, "geometry_type_attendu": "point"}}}""",
]


def test_declared_robustness_follows_the_catalog(spark, tmp_path):
    write_parquet(population(spark), str(tmp_path / "population.parquet"))
    catalog = catalog_from_entries(spark, ENTRIES)
    run = lambda d: declared_scale_robustness(points(spark), catalog, d, str(tmp_path), resolutions=(8,), replicates=99).first()
    r = run("spatial_seed")
    assert r["exposure_model"] == "declared:population_seed" and r["significant"]
    assert run("bare")["exposure_model"] == "abstention"
    with pytest.raises(ValueError, match="no point column"):
        run("population_seed")
    with pytest.raises(ValueError, match="invalid name"):
        catalog.entry("../outside")
    assert {r["dataset"] for r in catalog.list_datasets().collect()} == {"spatial_seed", "population_seed", "bare"}
    assert catalog.resolved_grids().first()["cell_size"] == 100.0


def test_names_and_paths_are_guarded(spark, tmp_path):
    write_parquet(spark.range(3), str(tmp_path / "a b.parquet"))
    assert guarded_path(spark, str(tmp_path), "a b.parquet").endswith("a b.parquet")
    for bad in ("../x.parquet", "absent.parquet", "a b.csv", "/etc/x.parquet", "."):
        with pytest.raises(ValueError):
            guarded_path(spark, str(tmp_path), bad)
    assert safe_name("x/a b-c.parquet") == "a_b_c"
    named = inline_rows(spark, "p string", [("x/a b-c.parquet",)]).select(safe_name_column(F.col("p"))).first()[0]
    assert named == "a_b_c"
    with pytest.raises(ValueError):
        checked_name("a; drop")
    with pytest.raises(ValueError):
        bounded_view(spark, str(tmp_path / "a b.parquet"), "a b")
    bounded_view(spark, str(tmp_path / "a b.parquet"), "ok")
    with pytest.raises(Exception):
        spark.sql("DELETE FROM ok")
    assert [tuple(r) for r in schema_of(spark.table("ok")).collect()] == [(0, "id", "bigint")]


def test_catalog_from_files(spark, tmp_path):
    from plumbline.sources.catalog import read_catalog

    (tmp_path / "a.json").write_text(" ".join(ENTRIES[0].split()) + "\n", encoding="utf-8")
    (tmp_path / "b.json").write_text(" ".join(ENTRIES[1].split()) + "\n", encoding="utf-8")
    catalog = read_catalog(spark, str(tmp_path))
    assert {r["dataset"] for r in catalog.datasets.collect()} == {"spatial_seed", "population_seed"}
    assert catalog.exposure("spatial_seed", "geom")["weight"] == "population"
    assert catalog.exposure("spatial_seed", "other") is None
