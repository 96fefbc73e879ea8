"""Numeric column profiles: all columns in one aggregation, outliers and quantiles in later passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.local import inline_rows
from plumbline.functions.stats import ratio, sample_skewness
from plumbline.operators.quantiles import (
    MAP_ROWS,
    PROFILE_PROBS,
    cut_points,
    exact_quantiles,
    quantiles_by_slots,
)

_NAMES = ("p5", "p25", "median", "p75", "p95")
_MOMENTS = "n bigint, known bigint, min double, max double, mean double, std double, skewness double, zeros bigint"


def _moments(columns: Sequence[str]) -> list:
    per_column = []
    for c in columns:
        v = F.col(c).cast("double")
        per_column.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(F.lit(1)).alias("n"),
                F.count(v).alias("known"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                sample_skewness(v).alias("skewness"),
                F.count_if(v == 0).alias("zeros"),
            )
        )
    return per_column


def numeric_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, known, min, max, mean, std, skewness, zeros), one scan for all columns."""
    return df.agg(F.array(*_moments(columns)).alias("m")).select(F.inline("m"))


def outliers_3sigma(df: DataFrame, moments: list) -> DataFrame:
    """(column, outliers): values further than three sample deviations from the mean.

    `moments` are the collected rows of `numeric_moments`, one per column; they enter the scan as
    literals, so the pass needs no join.
    """
    counts = []
    for m in moments:
        far = (
            F.count_if(F.abs(F.col(m["column"]).cast("double") - m["mean"]) > 3 * m["std"])
            if m["std"]
            else F.lit(0).cast("bigint")
        )
        counts.append(F.struct(F.lit(m["column"]).alias("column"), far.alias("outliers")))
    # The count keeps this an aggregate where every column is constant.
    return df.agg(F.array(*counts).alias("o"), F.count(F.lit(1))).select(F.inline("o"))


def numeric_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, null_rate, zero_rate), both over all rows."""
    m = numeric_moments(df, columns)
    return m.select(
        "column",
        "n",
        ratio(F.col("n") - F.col("known"), F.col("n")).alias("null_rate"),
        ratio(F.col("zeros"), F.col("n")).alias("zero_rate"),
    )


def numeric_profile(
    df: DataFrame, columns: Sequence[str], map_rows: int = MAP_ROWS
) -> DataFrame:
    """One row per column with every numeric measure.

    The first pass takes the moments and the cut points for the quantiles together. They are one
    small row per column and are collected: they bound the outlier pass and tell whether the
    input is small enough for single-pass quantiles.
    """
    columns = list(columns)
    spark = df.sparkSession
    first = df.agg(
        F.array(*_moments(columns)).alias("moments"),
        *[cut_points(F.col(c).cast("double")).alias(f"b{i}") for i, c in enumerate(columns)],
    ).first()
    moments = first["moments"]
    known = inline_rows(spark, f"column string, {_MOMENTS}", [tuple(m) for m in moments])
    if max(m["n"] for m in moments) <= map_rows:
        quantiles = exact_quantiles(df, columns, PROFILE_PROBS, map_rows, 0)
    else:
        bounds = [first[f"b{i}"] for i in range(len(columns))]
        quantiles = quantiles_by_slots(df, columns, PROFILE_PROBS, bounds)
    wide = quantiles.groupBy("column").agg(
        *[
            F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
            for p, name in zip(PROFILE_PROBS, _NAMES)
        ]
    )
    return (
        known.join(wide, "column")
        .join(outliers_3sigma(df, moments), "column")
        .select(
            "column", "n", "min", "max", "mean", "median", "p5", "p25", "p75", "p95",
            F.coalesce("std", F.lit(0.0)).alias("std"),
            F.coalesce("skewness", F.lit(0.0)).alias("skewness"),
            ratio(F.col("n") - F.col("known"), F.col("n")).alias("null_rate"),
            ratio(F.col("zeros"), F.col("n")).alias("zero_rate"),
            F.col("outliers").alias("n_outliers_3sigma"),
        )
    )
