"""Exact ranks in groups of any size, and p-values adjusted for many tests.

A window over a whole group would rank it in one task. Here equal values are counted first, so a value that fills
a third of the rows is one row; the distinct values are cut into ranges along their order; a window runs within
each range, and what the ranges before or behind contribute is one row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import settle


def _ranges(df: DataFrame, by: Sequence[str], value: str, ranges: int | None) -> DataFrame:
    """(_key, _value, _n, _range): counted distinct values with the number of the range they lie in.

    Ranges are Spark's own range partitions, so no range crosses another one. They are settled with their numbers:
    what reads them later sees one numbering, whatever executor is lost.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*by) if by else F.struct(F.lit(0))
    counted = (
        df.filter(F.col(value).isNotNull())
        .select(key.alias("_key"), (F.col(value).cast("double") + 0.0).alias("_value"))
        .groupBy("_key", "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return settle(counted.repartitionByRange(ranges, "_key", "_value").withColumn("_range", F.spark_partition_id()))


def _with_below(cut: DataFrame) -> DataFrame:
    """Add `_below`, the rows of the group with a smaller value, and `_total`, those with any."""
    sums = cut.groupBy("_key", "_range").agg(F.sum("_n").alias("_rows"))
    order = Window.partitionBy("_key").orderBy("_range")
    sums = sums.select(
        "_key", "_range",
        F.coalesce(F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy("_key")).alias("_total"),
    )
    here = Window.partitionBy("_key", "_range").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(sums, ["_key", "_range"])
        .withColumn("_below", F.col("_before") + F.sum("_n").over(here) - F.col("_n"))
        .drop("_before")
    )


def value_ranks(df: DataFrame, by: Sequence[str], value: str, ranges: int | None = None) -> DataFrame:
    """(by..., value, n, below, total, average_rank) per distinct value of each group.

    `below` counts the group's rows with a smaller value, `average_rank` is the mean rank, from 1, of the equal
    ones. NULL values have no rank, NULL keys are a group, NaN is above all numbers, and both zeros are one value.
    """
    ranked = _with_below(_ranges(df, by, value, ranges))
    return ranked.select(
        *[F.col("_key")[name].alias(name) for name in by],
        F.col("_value").alias(value), F.col("_n").alias("n"), F.col("_below").alias("below"),
        F.col("_total").alias("total"), (F.col("_below") + (F.col("_n") + 1) / 2.0).alias("average_rank"),
    )


def adjusted_p(df: DataFrame, p: str, by: Sequence[str] = (), name: str = "p_adjusted", ranges: int | None = None) -> DataFrame:
    """Add the Benjamini-Hochberg adjusted p-value within each group.

    The least of p * tests / rank over this and all greater p of the group, at most 1; rejecting where it is at
    most q keeps the expected share of false rejections at q. Equal p-values share the highest of their ranks.
    NULL p-values are no tests and stay NULL; an empty table stays empty.

    The rows are settled first, because they are ranked and then joined with their ranks: p-values that rest on sums
    of doubles change their last digit with the order in which parts arrive, and one worked out anew would miss its rank.
    """
    df = settle(df)
    raised = _with_below(_ranges(df, by, p, ranges)).withColumn(
        "_raw", F.col("_value") * F.col("_total") / (F.col("_below") + F.col("_n"))
    )
    least = raised.groupBy("_key", "_range").agg(F.min("_raw").alias("_least"))
    # Descending, since a frame that ends with the partition is read anew for every row.
    behind = Window.partitionBy("_key").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    least = least.select("_key", "_range", F.min("_least").over(behind).alias("_far"))
    rest = Window.partitionBy("_key", "_range").orderBy(F.desc("_value")).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = raised.join(least, ["_key", "_range"]).select(
        "_key", "_value", F.least(F.lit(1.0), F.min("_raw").over(rest), F.col("_far")).alias(name)
    )
    key = F.struct(*by) if by else F.struct(F.lit(0))
    rows = df.withColumn("_key", key).withColumn("_value", F.col(p).cast("double") + 0.0)
    return rows.join(adjusted, ["_key", "_value"], "left").drop("_key", "_value")
