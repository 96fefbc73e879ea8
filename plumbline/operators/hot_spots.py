"""Local hot-spot statistics over hexagonal cells: Gi* and local Moran, with a false discovery rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hexgrid import shifted
from plumbline.functions.stats import normal_tail
from plumbline.operators.ranking import adjusted_p
from plumbline.session import settle


def hex_offsets(rings: int) -> list[tuple[int, int]]:
    """Axial steps to all cells within `rings` rings, the cell itself included."""
    reach = range(-rings, rings + 1)
    return [(q, r) for q in reach for r in reach if abs(q + r) <= rings]


def local_statistics(cells: DataFrame, value: str, rings: int = 1) -> DataFrame:
    """(resolution, cell, value, n_near, near_sum, gi_star, gi_p, gi_p_adjusted, moran) per cell.

    Cells within `rings` rings of a cell that are in the table are its neighbours, with weight 1. Gi* standardises
    the sum over a cell and its neighbours; `gi_p` is its upper normal tail and `gi_p_adjusted` that adjusted for
    all cells of the resolution. Moran's statistic is the cell's deviation from the mean times the sum of its
    neighbours' deviations, over the variance. Both are NULL where a resolution's values are all equal, and Gi*
    where every cell is a neighbour. Cells are told by (resolution, cell), which must be unique; those with a
    NULL value take no part.

    Every cell sends its value to at most 1 + 3 * rings * (rings + 1) places, so a crowded region costs no more
    than any other, and no pair of cells is looked at that is not adjacent.
    """
    if rings < 1:
        raise ValueError(f"at least one ring: {rings}")
    own = settle(cells.filter(F.col(value).isNotNull()).select("resolution", "cell", F.col(value).cast("double").alias("value")))
    steps = F.array(*[F.struct(F.lit(q).alias("dq"), F.lit(r).alias("dr")) for q, r in hex_offsets(rings)])
    moved = own.select("resolution", "cell", "value", F.inline(steps)).select(
        "resolution", shifted(F.col("cell"), F.col("dq"), F.col("dr")).alias("cell"), "value"
    )
    near = moved.groupBy("resolution", "cell").agg(F.sum("value").alias("near_sum"), F.count(F.lit(1)).alias("n_near"))
    whole = own.groupBy("resolution").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_mean"), F.var_pop("value").alias("_var")
    )
    joined = own.join(near, ["resolution", "cell"]).join(F.broadcast(whole), "resolution")  # at most 16 resolutions
    n, k = F.col("_n"), F.col("n_near")
    spread = F.sqrt(F.col("_var") * (k * (n - k)) / (n - 1))
    gi = F.when((F.col("_var") > 0) & (k < n), (F.col("near_sum") - k * F.col("_mean")) / spread)
    deviation = F.col("value") - F.col("_mean")
    others = F.col("near_sum") - F.col("value") - (k - 1) * F.col("_mean")
    placed = joined.select(
        "resolution", "cell", "value", "n_near", "near_sum", gi.alias("gi_star"),
        F.when(F.col("_var") > 0, deviation * others / F.col("_var") + 0.0).alias("moran"),
    ).withColumn("gi_p", normal_tail(F.col("gi_star")))
    return adjusted_p(placed, "gi_p", ["resolution"], "gi_p_adjusted").select(
        "resolution", "cell", "value", "n_near", "near_sum", "gi_star", "gi_p", "gi_p_adjusted", "moran"
    )
