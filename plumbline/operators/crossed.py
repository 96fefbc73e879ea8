"""Profiles of column pairs: correlation matrix and contingency of categorical columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ranking import value_ranks
from plumbline.session import settle

_MOMENTS = "a int, b int, n double, sa double, sb double, saa double, sbb double, sab double"
ROWS_PER_TASK = 1 << 18  # whose ranks one task puts together
_NO_SPREAD = 1e-13  # a variance below this share of the squares about the shift is rounding


def co_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, n, var_a, var_b, cov): sums of squares and products about the means, for all pairs a <= b.

    Every pair uses the rows where both values are finite. Values are taken about the column's mean over all rows,
    so sums from different tasks add up without losing digits; a task holds one matrix of columns x columns per
    sum and emits it once. Two scans, whatever the number of columns.
    """
    columns = list(columns)
    wide = df.select([F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    finite = [F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c) for c in map(F.col, wide.columns)]
    shift = np.array([m or 0.0 for m in wide.agg(*[F.avg(c) for c in finite]).first()])

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(shift)
        n, s, ss, products = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            values = batch.to_numpy(dtype=float, na_value=np.nan)
            known = np.isfinite(values)
            values = np.where(known, values, shift) - shift
            known = known.astype(float)
            n += known.T @ known
            s += values.T @ known
            ss += (values * values).T @ known
            products += values.T @ values
        i, j = np.triu_indices(k)
        yield pd.DataFrame({
            "a": i.astype("int32"), "b": j.astype("int32"), "n": n[i, j], "sa": s[i, j], "sb": s[j, i],
            "saa": ss[i, j], "sbb": ss[j, i], "sab": products[i, j],
        })

    sums = wide.mapInPandas(gathered, _MOMENTS).groupBy("a", "b").agg(
        *[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")]
    )

    def spread(squares: str, total: str):
        about = F.col(squares) - F.col(total) * F.col(total) / F.col("n")
        return F.when(F.col("n") > 0, F.when(about > F.col(squares) * _NO_SPREAD, about).otherwise(0.0))

    return sums.select(
        "a", "b", F.col("n").cast("bigint").alias("n"), spread("saa", "sa").alias("var_a"), spread("sbb", "sb").alias("var_b"),
        F.when(F.col("n") > 0, F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")).alias("cov"),
    )


def _coefficient(moments: DataFrame, name: str) -> DataFrame:
    varied = (F.col("var_a") > 0) & (F.col("var_b") > 0)
    r = F.col("cov") / (F.sqrt("var_a") * F.sqrt("var_b"))
    return moments.select("a", "b", "n", F.when(varied, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias(name))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_a, column_b, n, pearson, spearman) for all pairs of different columns, in the order given.

    Each pair uses its complete rows, `n` of them; NULL, NaN and infinite values are missing. Spearman's is
    Pearson's of average ranks, a column ranked over all its own values. Both are NULL where a column does not vary
    on the pair's rows; an empty table gives n = 0.

    The input is read once, into a narrow table with row numbers. Ranks are found per distinct value of a column,
    so frequent values are one row, and return to the rows by a join and one grouping by row number, in tasks of
    about ROWS_PER_TASK rows, so a task's memory does not grow with the table.
    """
    columns = list(columns)
    if len(columns) < 2 or len(set(columns)) < len(columns):
        raise ValueError(f"two or more different columns: {columns}")
    names = [f"c{i}" for i in range(len(columns))]
    doubles = [F.col(c).cast("double") for c in columns]
    finite = [F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c + 0.0) for c in doubles]
    rows = settle(df.select(F.monotonically_increasing_id().alias("row"), *[c.alias(n) for c, n in zip(finite, names)]))
    each = F.array(*[F.struct(F.lit(i).alias("c"), F.col(n).alias("v")) for i, n in enumerate(names)])
    long = rows.select("row", F.inline(each)).filter(F.col("v").isNotNull())
    ranks = value_ranks(long, ["c"], "v").select("c", "v", "average_rank")
    tasks = max(-(-rows.count() // ROWS_PER_TASK), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Dealt out before they are grouped: row numbers hardly repeat within a task, so combining there would only fill memory.
    dealt = long.join(ranks, ["c", "v"]).select("row", "c", "average_rank").repartition(tasks, "row")
    of_row = [F.max(F.when(F.col("c") == i, F.col("average_rank"))).alias(n) for i, n in enumerate(names)]
    ranked = settle(dealt.groupBy("row").agg(*of_row).select(names))
    plain = _coefficient(co_moments(rows, names), "pearson")
    ordered = _coefficient(co_moments(ranked, names), "spearman").drop("n")
    labels = F.array(*[F.lit(c) for c in columns])
    return plain.join(ordered, ["a", "b"]).filter("a < b").select(
        labels[F.col("a")].alias("column_a"), labels[F.col("b")].alias("column_b"), "n", "pearson", "spearman"
    )


def contingency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_a, column_b, n, n_a, n_b, chi_square, cramers_v, mutual_bits) for all pairs of different columns.

    A pair uses the rows where both values are known; `n_a` and `n_b` are the distinct values on them. Cramer's V is
    NULL where a column has one value only. Pairs without complete rows give no row. Values are compared as text.

    One pass counts the value pairs of all column pairs, combined within each task before they move, so a value
    that fills a third of the rows is one counter per partner value. All else works on these counters.
    """
    columns = list(columns)
    if len(columns) < 2 or len(set(columns)) < len(columns):
        raise ValueError(f"two or more different columns: {columns}")
    texts = df.select([F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[
        F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.col(f"c{i}").alias("va"), F.col(f"c{j}").alias("vb"))
        for i in range(len(columns)) for j in range(i + 1, len(columns))
    ])
    # Rows that agree in all columns are one before they are spread over the pairs.
    equal = texts.groupBy(*texts.columns).agg(F.count(F.lit(1)).alias("_rows"))
    cells = settle(
        equal.select("_rows", F.inline(pairs)).filter(F.col("va").isNotNull() & F.col("vb").isNotNull())
        .groupBy("a", "b", "va", "vb").agg(F.sum("_rows").alias("n_ab"))
    )
    left = cells.groupBy("a", "b", "va").agg(F.sum("n_ab").alias("n_va"))
    right = cells.groupBy("a", "b", "vb").agg(F.sum("n_ab").alias("n_vb"))
    sizes = left.groupBy("a", "b").agg(F.sum("n_va").alias("n"), F.count(F.lit(1)).alias("n_a")).join(
        right.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_b")), ["a", "b"]
    )
    both = cells.join(left, ["a", "b", "va"]).join(right, ["a", "b", "vb"])
    share = F.col("n_ab") / F.col("n_va") * F.col("n_ab") / F.col("n_vb")
    # log2(n_ab * n / (n_va * n_vb)) in parts, so that the total need not be known yet.
    bits = F.col("n_ab") * (F.log2("n_ab") - F.log2("n_va") - F.log2("n_vb"))
    sums = both.groupBy("a", "b").agg(F.sum(share).alias("_share"), F.sum(bits).alias("_bits")).join(sizes, ["a", "b"])
    n = F.col("n")
    chi = F.greatest(F.lit(0.0), n * (F.col("_share") - 1))
    least = F.least("n_a", "n_b") - 1
    labels = F.array(*[F.lit(c) for c in columns])
    return sums.select(
        labels[F.col("a")].alias("column_a"), labels[F.col("b")].alias("column_b"), "n", "n_a", "n_b",
        chi.alias("chi_square"), F.when(least > 0, F.sqrt(chi / (n * least))).alias("cramers_v"),
        F.greatest(F.lit(0.0), F.col("_bits") / n + F.log2(n)).alias("mutual_bits"),
    )
