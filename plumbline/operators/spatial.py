"""Spatial column profile over decoded geometry, one grouped pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import ratio

# Approximate LV95 (EPSG:2056) envelope of Switzerland, (xmin, xmax, ymin, ymax).
LV95_BOX = (2_480_000, 2_840_000, 1_070_000, 1_300_000)


def out_of_envelope(geometry: Column, box: tuple = LV95_BOX) -> Column:
    """Lower corner at (0, 0) or outside the inclusive box; NULL geometry gives NULL."""
    x, y = geometry["xmin"], geometry["ymin"]
    return ((x == 0) & (y == 0)) | ~x.between(box[0], box[1]) | ~y.between(box[2], box[3])


def measures_by_type(df: DataFrame, geometry: str, box: tuple = LV95_BOX) -> DataFrame:
    """Counts and extremes per geometry type; NULL geometry is a group of its own."""
    g = F.col(geometry)
    inside = ~out_of_envelope(g, box)
    return df.groupBy(g["type"].alias("type")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(g["is_empty"]).alias("empties"),
        F.count_if(~g["is_valid"]).alias("invalids"),
        F.count_if(g["has_z"]).alias("zs"),
        F.count_if(out_of_envelope(g, box)).alias("outside"),
        F.min(F.when(inside, g["xmin"])).alias("min_x"),
        F.max(F.when(inside, g["xmax"])).alias("max_x"),
        F.min(F.when(inside, g["ymin"])).alias("min_y"),
        F.max(F.when(inside, g["ymax"])).alias("max_y"),
        F.max(g["length"]).alias("max_length"),
        F.max(g["area"]).alias("max_area"),
    )


def geometry_types(by_type: DataFrame) -> DataFrame:
    """(type, n) of non-null geometry."""
    return by_type.filter(F.col("type").isNotNull()).select("type", "n")


def spatial_profile(
    df: DataFrame, geometry: str, column: str, srid: int | None = None, box: tuple = LV95_BOX
) -> DataFrame:
    """One row: rates over all rows, extent of in-box geometry, largest sizes, types map.

    An empty table gives n = 0 and NULL rates.
    """
    by_type = measures_by_type(df, geometry, box)
    n = F.coalesce(F.sum("n"), F.lit(0).cast("bigint"))

    def rate(count: str) -> Column:
        return ratio(F.sum(count), n)

    nulls = F.coalesce(F.sum(F.when(F.col("type").isNull(), F.col("n"))), F.lit(0))
    return by_type.agg(
        F.lit(column).alias("column"),
        n.alias("n"),
        F.lit(srid).cast("int").alias("srid_declared"),
        ratio(nulls, n).alias("null_rate"),
        rate("empties").alias("empty_rate"),
        rate("invalids").alias("invalid_rate"),
        rate("zs").alias("has_z_rate"),
        rate("outside").alias("out_of_envelope_rate"),
        F.min("min_x").alias("min_x"),
        F.max("max_x").alias("max_x"),
        F.min("min_y").alias("min_y"),
        F.max("max_y").alias("max_y"),
        F.max("max_length").alias("max_length"),
        F.max("max_area").alias("max_area"),
        # One entry per OGC type name.
        F.map_from_entries(
            F.filter(
                F.collect_list(F.struct("type", "n")), lambda e: e["type"].isNotNull()
            )
        ).alias("geometry_types"),
    )
