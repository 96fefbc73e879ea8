"""Temporal column profiles, all read from one (column, year, month) count table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.stats import ratio


def month_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, year, month, freq, lo, hi); rows without a date have year and month NULL.

    A few hundred rows per column however large the table: everything below reads only this.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    entries = []
    for c in columns:
        moment = F.col(c).cast("timestamp_ntz")
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(isinstance(kinds[c], T.DateType)).alias("is_date"),
                moment.alias("moment"),
            )
        )
    return (
        df.select(F.inline(F.array(*entries)))
        .groupBy("column", "is_date", F.year("moment").alias("year"), F.month("moment").alias("month"))
        .agg(F.count(F.lit(1)).alias("freq"), F.min("moment").alias("lo"), F.max("moment").alias("hi"))
    )


def bounds_and_gaps(months: DataFrame) -> DataFrame:
    """(column, n, null_rate, min, max, gap_months); gaps count empty months between the ends.

    The number of empty months is the span in months less the months present, so no calendar has to be
    generated and joined.
    """
    dated = F.col("year").isNotNull()
    known = F.coalesce(F.sum(F.when(dated, F.col("freq"))), F.lit(0))
    n = F.sum("freq")
    index = F.col("year") * 12 + F.col("month")
    span = F.max(index) - F.min(index) + 1

    def shown(moment):
        return F.when(F.col("is_date"), F.date_format(moment, "yyyy-MM-dd")).otherwise(moment.cast("string"))

    return (
        months.groupBy("column", "is_date")
        .agg(
            n.alias("n"),
            ratio(n - known, n).alias("null_rate"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            (span - F.count_if(dated)).cast("bigint").alias("gap_months"),
        )
        .select(
            "column", "n", "null_rate",
            shown(F.col("lo")).alias("min"), shown(F.col("hi")).alias("max"),
            F.coalesce("gap_months", F.lit(0).cast("bigint")).alias("gap_months"),
        )
    )


def missing_months(months: DataFrame) -> DataFrame:
    """(column, month): the empty months themselves, as first days."""
    present = months.filter(F.col("year").isNotNull()).select(
        "column", F.make_date("year", "month", F.lit(1)).alias("month")
    )
    calendar = present.groupBy("column").agg(
        F.min("month").alias("a"), F.max("month").alias("b")
    ).select("column", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    return calendar.join(present, ["column", "month"], "left_anti")


def seasonality(months: DataFrame) -> DataFrame:
    """(column, month 1..12, freq) over dated rows."""
    return (
        months.filter(F.col("year").isNotNull())
        .groupBy("column", "month")
        .agg(F.sum("freq").alias("freq"))
    )


def volume_by_year(months: DataFrame) -> DataFrame:
    """(column, year, freq) over dated rows."""
    return (
        months.filter(F.col("year").isNotNull())
        .groupBy("column", "year")
        .agg(F.sum("freq").alias("freq"))
    )


def temporal_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: bounds, rates, gaps and the two count maps."""
    months = month_counts(df, columns)
    # Both maps are bounded by the calendar: 12 months, one entry per year.
    by_month = seasonality(months).groupBy("column").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("month", "freq")))).alias("seasonality_by_month")
    )
    by_year = volume_by_year(months).groupBy("column").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "freq")))).alias("volume_by_year")
    )
    return bounds_and_gaps(months).join(by_month, "column", "left").join(by_year, "column", "left")
