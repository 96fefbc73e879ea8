"""Exposure scans: (key, weight) tables and weighted point grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exposure_table(df: DataFrame, key: str, weight: str) -> DataFrame:
    """(key STRING, weight DOUBLE); only these two columns reach the file scan."""
    return df.select(F.col(key).cast("string").alias("key"), F.col(weight).cast("double").alias("weight"))


def exposure_grid(
    df: DataFrame,
    east: str,
    north: str,
    weight: str,
    cell_size: float = 0.0,
    coord_ref: str | None = None,
) -> DataFrame:
    """(x, y, weight) at cell centres: south-west corners move by half a cell."""
    half = float(cell_size) / 2 if coord_ref == "sw_corner" else 0.0
    return df.select(
        (F.col(east).cast("double") + F.lit(half)).alias("x"),
        (F.col(north).cast("double") + F.lit(half)).alias("y"),
        F.col(weight).cast("double").alias("weight"),
    )
