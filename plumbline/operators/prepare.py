"""Preparation jobs: filters, dates, points, fixed-size samples and planted anomalies.

Random choices come from a hash of the row's key, so a job gives the same rows on any number of
partitions and after a lost executor recomputes them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The planted sentinel, its rate, the ordinary choices and the coordinate rates.
SENTINEL = 999
SENTINEL_RATE = 0.002
ORDINARY_VALUES = (30, 50, 60, 80, 120)
NULL_ISLAND_RATE = 0.005
SWAPPED_RATE = 0.01
HOTSPOT_DIVISOR = 4



def keep_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def keep_positive(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) > 0)


def drop_values(df: DataFrame, value: Column, values: Sequence) -> DataFrame:
    """Rows whose value is in none of `values` (NULL rows go too, as with SQL NOT IN)."""
    return df.filter(~value.isin(list(values)))


def first_of_month(year: Column, month: Column) -> Column:
    return F.make_date(year.cast("int"), month.cast("int"), F.lit(1))


def point(east: Column, north: Column) -> Column:
    return F.struct(east.cast("double").alias("x"), north.cast("double").alias("y"))


def hashed_word(key: Column, seed: int, branch: str = "") -> Column:
    """32 pseudo-random bits of md5(seed|branch|key), as BIGINT."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(branch), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hashed_uniform(key: Column, seed: int, branch: str = "") -> Column:
    """Uniform number in [0, 1) per row; independent for different branches."""
    return hashed_word(key, seed, branch) / F.lit(4294967296.0)


def fixed_size_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows: those with the smallest (hash, key).

    No global sort: rows are counted per 16-bit hash prefix, whole prefixes below the cut are
    kept as they are, and only the one prefix on the cut (1/65536 of the rows) is ranked.
    """
    marked = df.withColumn("_h", hashed_word(F.col(key), seed)).withColumn(
        "_prefix", F.shiftright("_h", 16).cast("int")
    )
    earlier = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    takes = (
        marked.groupBy("_prefix")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_left", F.lit(n) - F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .filter(F.col("_left") > 0)
    )
    # One row per 16-bit prefix: at most 65536 rows on the broadcast side.
    chosen = marked.join(F.broadcast(takes), "_prefix")
    whole = chosen.filter(F.col("_rows") <= F.col("_left"))
    rank = F.row_number().over(Window.partitionBy("_prefix").orderBy("_h", key))
    cut = (
        chosen.filter(F.col("_rows") > F.col("_left"))
        .withColumn("_rank", rank)
        .filter(F.col("_rank") <= F.col("_left"))
        .drop("_rank")
    )
    return whole.unionByName(cut).drop("_h", "_prefix", "_rows", "_left")


def planted_sentinel(key: Column, seed: int, rate: float = SENTINEL_RATE) -> Column:
    """The sentinel at the given rate, else one of the ordinary values."""
    pick = (F.floor(hashed_uniform(key, seed, "pick") * len(ORDINARY_VALUES)) + 1).cast("int")
    ordinary = F.element_at(F.array(*[F.lit(v) for v in ORDINARY_VALUES]), pick)
    return F.when(hashed_uniform(key, seed, "sentinel") < rate, F.lit(SENTINEL)).otherwise(ordinary)


def planted_point(
    east: Column,
    north: Column,
    key: Column,
    seed: int,
    null_rate: float = NULL_ISLAND_RATE,
    swap_rate: float = SWAPPED_RATE,
) -> Column:
    """The point, or (0, 0), or its axes swapped; each branch draws its own number."""
    return (
        F.when(hashed_uniform(key, seed, "null island") < null_rate, point(F.lit(0), F.lit(0)))
        .when(hashed_uniform(key, seed, "swapped") < swap_rate, point(north, east))
        .otherwise(point(east, north))
    )


def derive_exposure(df: DataFrame, unit: str, divisor: int = HOTSPOT_DIVISOR) -> DataFrame:
    """(unit, exposure, role): exposure equals the count, but a divided one for the true hot spot.

    The false hot spot is the unit with the largest count, the true one the second largest.
    The two are found by a top-2 over the unit counts, not by ranking every unit.
    """
    counts = df.groupBy(F.col(unit).alias("unit")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.col("n").desc(), F.col("unit").asc_nulls_last()).limit(2)
    ranked = top.select(
        "unit",
        F.row_number()
        .over(Window.orderBy(F.col("n").desc(), F.col("unit").asc_nulls_last()))
        .alias("rank"),
    )
    return (
        counts.alias("c")
        .join(
            F.broadcast(ranked.alias("r")), F.expr("c.unit <=> r.unit"), "left"
        )  # two rows
        .select(
            "c.unit",
            F.when(
                F.col("r.rank") == 2,
                F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("c.n") / divisor)),
            )
            .otherwise(F.col("c.n"))
            .cast("bigint")
            .alias("exposure"),
            F.when(F.col("r.rank") == 1, "false_hotspot")
            .when(F.col("r.rank") == 2, "true_hotspot")
            .otherwise("ordinary")
            .alias("role"),
        )
    )


def lattice_clusters(spark, clusters: Sequence[tuple[int, float, float]], step: float = 10.0) -> DataFrame:
    """Points on a 5-wide lattice: for (n, x0, y0), point i is at (i mod 5, i div 5) steps."""
    out = None
    for n, x0, y0 in clusters:
        part = spark.range(n).select(
            point(
                F.lit(float(x0)) + (F.col("id") % 5) * step,
                F.lit(float(y0)) + F.floor(F.col("id") / 5) * step,
            ).alias("geom")
        )
        out = part if out is None else out.unionByName(part)
    return out
