"""Points and weights per hexagonal cell, all resolutions in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hexgrid import EDGE_METRES, cell_centre, cell_of, edge_of
from plumbline.functions.lv95 import to_wgs84


def checked_resolutions(resolutions: Sequence[int]) -> list[int]:
    """The resolutions as a list; none, repeated or unknown ones are errors."""
    out = list(resolutions)
    if not out:
        raise ValueError("no resolution given")
    if len(set(out)) != len(out):
        raise ValueError(f"repeated resolutions: {out}")
    for r in out:
        edge_of(r)
    return out


def _at_resolutions(df: DataFrame, x: Column, y: Column, resolutions: Sequence[int], *keep: str) -> DataFrame:
    """Rows repeated per resolution with the (resolution, cell) they fall in.

    Rows without coordinates get cell -1 and `known` false. They are sorted out after the counting,
    where a filter is cheap, and not before, where it would repeat the caller's point formula.
    """
    sizes = F.array(
        *[
            F.struct(F.lit(r).alias("resolution"), F.lit(edge_of(r)).alias("edge"))
            for r in resolutions
        ]
    )
    cell = cell_of(F.col("x"), F.col("y"), F.col("resolution"), F.col("edge"))
    x_known, y_known = F.col("x").isNotNull(), F.col("y").isNotNull()
    # The constant makes the id non-nullable: a join on it then needs no filter of its own, which
    # would work the formula out a second time.
    return df.select(x.alias("x"), y.alias("y"), *keep).select("*", F.inline(sizes)).select(
        "resolution", F.coalesce(cell, F.lit(-1)).alias("cell"), (x_known & y_known).alias("known"), *keep
    )


def cell_counts(df: DataFrame, point: str, resolutions: Sequence[int]) -> DataFrame:
    """(resolution, cell, observed); rows without a point or coordinates are skipped."""
    p = F.col(point)
    placed = _at_resolutions(df.filter(p.isNotNull()), p["x"], p["y"], resolutions)
    counts = placed.groupBy("resolution", "cell").agg(F.count_if("known").alias("observed"))
    return counts.filter(F.col("observed") > 0)


def cell_exposure(grid: DataFrame, resolutions: Sequence[int]) -> DataFrame:
    """(resolution, cell, weight) from an (x, y, weight) grid."""
    placed = _at_resolutions(grid, F.col("x"), F.col("y"), resolutions, "weight")
    summed = placed.groupBy("resolution", "cell").agg(
        F.sum("weight").alias("weight"), F.bool_or("known").alias("known")
    )
    return summed.filter("known").drop("known")


def split_cells(counts: DataFrame, exposure: DataFrame) -> DataFrame:
    """Occupied cells with their weight and whether they can be tested (weight > 0)."""
    joined = counts.join(exposure, ["resolution", "cell"], "left")
    return joined.withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn(
        "testable", F.col("weight") > 0
    )


def unpopulated(cells: DataFrame) -> DataFrame:
    """(resolution, n_cells, n_points, share) of occupied cells without exposure."""
    points = F.coalesce(F.sum(F.when(~F.col("testable"), F.col("observed"))), F.lit(0))
    return cells.groupBy("resolution").agg(
        F.count_if(~F.col("testable")).alias("n_cells"),
        points.alias("n_points"),
        (points / F.greatest(F.lit(1), F.sum("observed"))).alias("share"),
    )


def with_centres(cells: DataFrame, srid: int = 2056) -> DataFrame:
    """Add x, y, lng and lat of each (resolution, cell) centre."""
    edges = F.array(*[F.lit(e) for e in EDGE_METRES])
    x, y = cell_centre(F.col("cell"), F.element_at(edges, F.col("resolution") + 1))
    placed = cells.withColumn("x", x).withColumn("y", y)
    lng, lat = to_wgs84(F.col("x"), F.col("y"), srid)
    return placed.withColumn("lng", lng).withColumn("lat", lat)
