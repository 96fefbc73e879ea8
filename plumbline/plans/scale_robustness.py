"""Does a point concentration survive a change of cell size?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.local import inline_rows
from plumbline.functions.stats import std_excess
from plumbline.operators.cells import (
    cell_counts,
    cell_exposure,
    checked_resolutions,
    split_cells,
    unpopulated,
    with_centres,
)
from plumbline.operators.exposure_tests import (
    DEFAULT_REPLICATES,
    SIGNIFICANCE,
    argmax_units,
    null_statistics,
    pseudo_p_values,
)
from plumbline.session import settle
from plumbline.sources.catalog import Catalog
from plumbline.sources.exposure import exposure_grid
from plumbline.sources.tables import scan

DEFAULT_RESOLUTIONS = (6, 7, 8)
CAVEATS = (
    "The null model is proportional to the declared exposure: a concentration beyond it is no proof"
    " of cause.",
    "Planar cells are biased for events bound to a network of lines.",
    "Cells of different resolutions do not nest: a peak is described per resolution only.",
)


def cell_tests(
    cells: DataFrame, resolutions: Sequence[int], replicates: int, seed: int, srid: int = 2056
) -> DataFrame:
    """One row per resolution from a settled `split_cells` table.

    Totals and peaks are one row per resolution (at most 16) and are collected; the cells
    themselves go from the table straight to the replicates.
    """
    spark = cells.sparkSession
    tested_observed = F.sum(F.when(F.col("testable"), F.col("observed")))
    totals = (
        unpopulated(cells)
        .join(
            cells.groupBy("resolution").agg(
                F.count_if("testable").alias("tested"),
                tested_observed.alias("n_total"),
                F.sum(F.when(F.col("testable"), F.col("weight"))).alias("w"),
            ),
            "resolution",
        )
        .collect()
    )
    known = inline_rows(
        spark,
        "resolution int, n_total bigint, _w double",
        [(t["resolution"], t["n_total"], t["w"]) for t in totals if t["tested"]],
    )
    expected = F.col("n_total") * (F.col("weight") / F.col("_w"))
    tested = (
        cells.filter("testable")
        .join(F.broadcast(known), "resolution")  # at most 16 rows
        .withColumnRenamed("cell", "unit")
        .withColumn("expected", expected)
        .withColumn("z", std_excess(F.col("observed").cast("double"), F.col("expected")))
    )
    n_units = sum(t["tested"] for t in totals)
    found: dict[int, dict] = {}
    if n_units:
        peaks = argmax_units(tested, "resolution").filter(F.col("subject") == "most_concentrated")
        peaks = with_centres(peaks.withColumnRenamed("unit", "cell"), srid).collect()
        found = {p["resolution"]: p.asDict() for p in peaks}
        units = tested.select(
            F.col("resolution").cast("bigint").alias("group"),
            "unit", "weight", "expected", "n_total", F.lit(False).alias("fixed"),
        )
        observed = inline_rows(spark, "group bigint, t double", [(r, p["z"]) for r, p in found.items()])
        nulls = null_statistics(units, replicates, seed, n_units)
        for row in pseudo_p_values(nulls, observed, "max_z", "pseudo_p").collect():
            found[row["group"]]["pseudo_p"] = row["pseudo_p"]

    counted = {t["resolution"]: t for t in totals}
    rows = []
    for r in resolutions:
        t, peak = counted.get(r), found.get(r, {})
        p = peak.get("pseudo_p")
        rows.append(
            (
                r, t["tested"] if t else 0, (t["n_total"] or 0) if t else 0,
                peak.get("cell"), peak.get("lat"), peak.get("lng"), peak.get("z"), p,
                p is not None and p <= SIGNIFICANCE,
                t["n_cells"] if t else 0, t["n_points"] if t else 0, t["share"] if t else 0.0,
            )
        )
    return inline_rows(
        spark,
        "resolution int, n_cells_tested bigint, n_total_tested bigint, peak_cell bigint,"
        " peak_lat double, peak_lng double, peak_std_excess double, pseudo_p double,"
        " significant boolean, unpopulated_cells bigint, unpopulated_points bigint,"
        " unpopulated_share double",
        rows,
    )


def scale_verdict(per_resolution: DataFrame) -> DataFrame:
    """(verdict): robuste if every resolution is significant, absente if none is, else fragile."""
    return per_resolution.agg(
        F.when(F.every("significant"), "robuste")
        .when(~F.bool_or("significant"), "absente")
        .otherwise("fragile")
        .alias("verdict")
    )


def scale_robustness(
    points: DataFrame,
    point: str,
    grid: DataFrame | None,
    resolutions: Sequence[int] = DEFAULT_RESOLUTIONS,
    replicates: int = DEFAULT_REPLICATES,
    seed: int = 42,
    srid: int = 2056,
    model: str = "grid",
    rounded: bool = True,
) -> DataFrame:
    """One row per resolution with the common verdict; an abstention row without a grid.

    Points and grid are each scanned once for all resolutions; only cells reach the null model.
    """
    resolutions = checked_resolutions(resolutions)
    replicates = max(1, int(replicates))
    spark = points.sparkSession
    if grid is None:
        reason = "no declared spatial exposure: robustness cannot be judged"
        return inline_rows(
            spark,
            "spatial_col string, exposure_model string, reason string, resolution int",
            [(point, "abstention", reason, r) for r in resolutions],
        )
    cells = settle(
        split_cells(cell_counts(points, point, resolutions), cell_exposure(grid, resolutions))
    )
    per = cell_tests(cells, resolutions, replicates, seed, srid)
    verdict = scale_verdict(per).first()["verdict"]

    def shown(c, digits):
        return F.round(c, digits).alias(c) if rounded else F.col(c)

    return per.select(
        F.lit(point).alias("spatial_col"),
        F.lit(f"declared:{model}").alias("exposure_model"),
        F.lit(seed).alias("seed"),
        F.lit(replicates).alias("n_permutations"),
        F.lit(verdict).alias("verdict"),
        "resolution", "n_cells_tested", "n_total_tested", "peak_cell",
        shown("peak_lat", 5), shown("peak_lng", 5), shown("peak_std_excess", 2),
        shown("pseudo_p", 4), "significant", "unpopulated_cells", "unpopulated_points",
        shown("unpopulated_share", 4),
        F.array(*map(F.lit, CAVEATS)).alias("caveats"),
    )


def declared_scale_robustness(
    points: DataFrame, catalog: Catalog, dataset: str, base_dir: str, **options
) -> DataFrame:
    """The test with the point column and exposure grid the catalog declares."""
    column = catalog.point_column(dataset)
    declared = catalog.exposure(dataset, column["column"])
    if declared is None or declared["kind"] != "spatial_grid":
        return scale_robustness(points, column["column"], None, **options)
    entry = catalog.entry(declared["entry"])
    grid = exposure_grid(
        scan(points.sparkSession, f"{base_dir}/{entry['data']}"),
        entry["east"], entry["north"], declared["weight"], entry["cell_size"], entry["coord_ref"],
    )
    return scale_robustness(
        points, column["column"], grid, srid=column["srid"], model=declared["entry"], **options
    )
