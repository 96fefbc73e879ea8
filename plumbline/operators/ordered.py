"""Ordered scans that stay parallel inside one huge group.

A plain window puts a whole group into one task, which fails when one group holds a third of the
rows. Here every group is cut into buckets that follow its order. A bucket is small, so the window
runs per (group, bucket); what earlier buckets contribute is one aggregate row per bucket, carried
forward by windows over those few rows, in two levels, and joined back on the columns the rows are
already partitioned by. NULL keys are a group, as in a window, and NULL positions come last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_WIDTH = 1 << 16
STRETCH_BUCKETS = 1 << 12
_LAST = (1 << 63) - 1


def _cut(df: DataFrame, keys: Sequence[str], position: str, width: int) -> DataFrame:
    """Add `_key`, one value per group, and `_bucket`, which never decreases along an integer column.

    The struct is never NULL itself, and structs with NULL fields are equal, so joining on it keeps every row.
    """
    bucket = F.coalesce(F.expr(f"`{position}` div {width}"), F.lit(_LAST))
    return df.withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0))).withColumn("_bucket", bucket)


def _along(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def _carried(cut: DataFrame, carry: Column, total) -> DataFrame:
    """One row per (key, bucket) with `carry` combined by `total` over all earlier buckets.

    Buckets are themselves cut into stretches: a window runs over the buckets of a stretch and one over the
    stretches of a group, so that neither holds a whole group, even where sparse positions give every
    row a bucket of its own.
    """
    own = cut.groupBy("_key", "_bucket").agg(carry.alias("_own"))
    own = own.withColumn("_stretch", F.expr(f"`_bucket` div {STRETCH_BUCKETS}"))
    stretches = own.groupBy("_key", "_stretch").agg(total(F.col("_own")).alias("_whole"))

    def earlier(column: str, order: str, *group: str) -> Column:
        window = Window.partitionBy("_key", *group).orderBy(order)
        return total(F.col(column)).over(window.rowsBetween(Window.unboundedPreceding, -1))

    stretches = stretches.select("_key", "_stretch", earlier("_whole", "_stretch").alias("_far"))
    near = own.select("_key", "_bucket", "_stretch", earlier("_own", "_bucket", "_stretch").alias("_near"))
    return near.join(stretches, ["_key", "_stretch"]).select("_key", "_bucket", "_near", "_far")


def running_number(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    width: int = BUCKET_WIDTH,
) -> DataFrame:
    """row_number() per `keys` along `order`; the first order column must be an integer."""
    cut = _cut(df, keys, order[0], width)
    carried = _carried(cut, F.count(F.lit(1)), F.sum)
    local = F.row_number().over(Window.partitionBy("_key", "_bucket").orderBy(*_along(order)))
    zero = F.lit(0)
    return (
        cut.join(carried, ["_key", "_bucket"])
        .withColumn(name, (F.coalesce("_near", zero) + F.coalesce("_far", zero) + local).cast("bigint"))
        .drop("_key", "_bucket", "_near", "_far")
    )


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    width: int = BUCKET_WIDTH,
    inclusive: bool = False,
) -> DataFrame:
    """Largest `value` among the earlier rows of the group (and the row itself if `inclusive`).

    NULL where there is none. The latest of an increasing value is its maximum, so this also
    answers as-of questions.
    """
    cut = _cut(df, keys, order[0], width)
    carried = _carried(cut, F.max(value), F.max)
    window = (
        Window.partitionBy("_key", "_bucket")
        .orderBy(*_along(order))
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    # greatest() skips NULL: at the start of a bucket only the carried values count.
    return (
        cut.join(carried, ["_key", "_bucket"])
        .withColumn(name, F.greatest(F.max(value).over(window), "_near", "_far"))
        .drop("_key", "_bucket", "_near", "_far")
    )
