"""Value-frequency tables and what a categorical profile reads from them.

One pass turns all columns into (column, key) counts. Short values are their own key. A column
that holds long texts can be keyed by SHA-256 instead, so the shuffle moves 64 characters per
distinct text and not the text; only the few reported values are then looked up again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.stats import entropy_bits, ratio

TOP_K = 15
KEY_LENGTH = 64


def value_key(value: Column, wide: bool = False) -> Column:
    text = value.cast("string")
    if not wide:
        return text
    return F.when(F.length(text) <= KEY_LENGTH, text).otherwise(F.sha2(text, 256))


def value_frequencies(
    df: DataFrame, columns: Sequence[str], wide_columns: Sequence[str] = ()
) -> DataFrame:
    """(column, key, freq); NULL is a key of its own."""
    pairs = [
        F.struct(
            F.lit(c).alias("column"), value_key(F.col(c), c in wide_columns).alias("key")
        )
        for c in columns
    ]
    return (
        df.select(F.inline(F.array(*pairs)))
        .groupBy("column", "key")
        .agg(F.count(F.lit(1)).alias("freq"))
    )


def cardinality_entropy(frequencies: DataFrame) -> DataFrame:
    """Per column: rows, distinct non-null values, their share of rows, entropy in bits."""
    n = F.sum("freq")
    distinct = F.count("key")
    return frequencies.groupBy("column").agg(
        n.alias("n"),
        distinct.alias("cardinality"),
        ratio(distinct, n).alias("uniqueness"),
        entropy_bits(F.col("freq")).alias("entropy"),
    )


def top_values(
    frequencies: DataFrame,
    k: int = TOP_K,
    source: DataFrame | None = None,
    wide_columns: Sequence[str] = (),
) -> DataFrame:
    """The k most frequent keys per column with their share of rows; ties go to the smaller key.

    `row_number <= k` is planned as a group limit below the shuffle, so a column sends at most k rows
    per task to its final task. With `wide_columns`, hashed keys are replaced by the text
    they stand for.
    """
    order = Window.partitionBy("column").orderBy(
        F.col("freq").desc(), F.col("key").asc_nulls_last()
    )
    totals = frequencies.groupBy("column").agg(F.sum("freq").alias("n"))
    top = (
        frequencies.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .join(totals, "column")
        .select(
            "column", "rank", F.col("key").alias("value"), "freq",
            (F.col("freq") / F.col("n")).alias("share"),
        )
    )
    if source is None or not wide_columns:
        return top
    hashed = top.filter(F.col("column").isin(list(wide_columns))).select(
        "column", F.col("value").alias("key")
    )
    texts = source.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        value_key(F.col(c), True).alias("key"),
                        F.col(c).cast("string").alias("text"),
                    )
                    for c in wide_columns
                ]
            )
        )
    ).filter(F.length("text") > KEY_LENGTH)
    # At most k keys per column are looked up, so this side is bounded by k * columns.
    found = (
        texts.join(F.broadcast(hashed), ["column", "key"])
        .groupBy("column", "key")
        .agg(F.first("text").alias("text"))
    )
    return (
        top.join(found.withColumnRenamed("key", "value"), ["column", "value"], "left")
        .withColumn("value", F.coalesce("text", "value"))
        .select("column", "rank", "value", "freq", "share")
    )


def categorical_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: n, cardinality, uniqueness, entropy."""
    return cardinality_entropy(value_frequencies(df, columns))
