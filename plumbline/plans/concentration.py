"""Is a categorical unit over-concentrated, given its exposure?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import pseudo_p, std_excess
from plumbline.operators.exposure_tests import (
    DEFAULT_REPLICATES,
    argmax_units,
    bad_weights,
    clamp_replicates,
    distinct_exposure,
    null_statistics,
    uniform_exposure,
    unit_counts,
)
from plumbline.session import settle
from plumbline.sources.catalog import Catalog
from plumbline.sources.exposure import exposure_table
from plumbline.sources.tables import scan

REPORT = (
    "unit_col string, exposure_model string, reason string, n_permutations int, seed int,"
    " n_total bigint, n_units bigint, subject string, unit string, observed bigint,"
    " expected double, std_excess double, pseudo_p double"
)
_ABSTENTION = (
    "over-concentration cannot be judged without a declared exposure"
    " (neither an exposure table nor an explicit uniform opt-in)"
)
_SHOWN = 20


def abstention(counts: DataFrame, unit: str) -> DataFrame:
    """One row saying why no test was made, with the counts that are known."""
    return counts.agg(
        F.count(F.lit(1)).alias("n_units"), F.sum("observed").alias("n_total")
    ).select(
        F.lit(unit).alias("unit_col"),
        F.lit("abstention").alias("exposure_model"),
        F.lit(_ABSTENTION).alias("reason"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("n_permutations", "int"), ("seed", "int"))],
        "n_total",
        "n_units",
        F.lit(None).cast("string").alias("subject"),
        F.lit(None).cast("string").alias("unit"),
        F.lit(None).cast("bigint").alias("observed"),
        *[F.lit(None).cast("double").alias(c) for c in ("expected", "std_excess", "pseudo_p")],
    )


def concentration_test(
    df: DataFrame,
    unit: str,
    exposure: DataFrame | None = None,
    model: str | None = None,
    uniform: bool = False,
    replicates: int = DEFAULT_REPLICATES,
    seed: int = 42,
    rounded: bool = True,
) -> DataFrame:
    """Report rows `most_concentrated` and `highest_raw_count` (see REPORT).

    The most concentrated unit is held against the largest excess of any unit per replicate, the
    highest raw count against its own excess. Without `exposure` and without `uniform` the result
    is an abstention. Missing, zero, negative or repeated exposures are errors.
    """
    if unit not in df.columns:
        raise ValueError(f"no such column: {unit!r}")
    replicates = clamp_replicates(replicates)
    counts = unit_counts(df, unit)
    if uniform:
        exposed, model = uniform_exposure(counts).withColumn("copies", F.lit(1)), "uniform:declared"
    elif exposure is None:
        counts = settle(counts)
        if counts.isEmpty():
            raise ValueError("no rows: nothing to test")
        return abstention(counts, unit)
    else:
        declared = distinct_exposure(exposure).alias("e")
        exposed = counts.alias("c").join(declared, F.expr("c.unit <=> e.key"), "left").select(
            "c.unit", "c.observed", "e.weight", "e.copies"
        )
        model = f"declared:{model or 'exposure'}"
    exposed = settle(exposed)  # the data is scanned once, all further steps read units
    seen = exposed.agg(
        F.count(F.lit(1)).alias("units"),
        F.sum("observed").alias("total"),
        F.sum("weight").alias("weight"),
        F.count_if(F.col("weight").isNull()).alias("missing"),
        F.count_if(F.col("weight") <= 0).alias("bad"),
        F.count_if(F.col("copies") > 1).alias("repeated"),
    ).first()
    if not seen["units"]:
        raise ValueError("no rows: nothing to test")
    if seen["missing"]:
        _reject(exposed.filter(F.col("weight").isNull()), "units without declared exposure")
    if seen["bad"]:
        _reject(bad_weights(exposed), "zero or negative exposure")
    if seen["repeated"]:
        _reject(exposed.filter(F.col("copies") > 1), "repeated exposure keys")

    n_units, n_total = seen["units"], seen["total"]
    expected = F.lit(n_total) * (F.col("weight") / F.lit(seen["weight"]))
    tested = exposed.withColumn("n_total", F.lit(n_total)).withColumn("expected", expected)
    tested = tested.withColumn("z", std_excess(F.col("observed").cast("double"), F.col("expected")))
    most, raw = argmax_units(tested).collect()  # two rows
    units = tested.select(
        F.lit(0).cast("bigint").alias("group"),
        "unit", "weight", "expected", "n_total",
        F.col("unit").eqNullSafe(F.lit(raw["unit"])).alias("fixed"),
    )
    nulls = null_statistics(units, replicates, seed, n_units)
    p = nulls.agg(
        pseudo_p(F.col("max_z"), F.lit(most["z"])).alias("most_p"),
        pseudo_p(F.col("fixed_z"), F.lit(raw["z"])).alias("raw_p"),
    )

    def shown(value, digits):
        value = value if not isinstance(value, float) else F.lit(value)
        return F.round(value, digits) if rounded else value

    rows = [
        F.struct(
            F.lit(unit).alias("unit_col"),
            F.lit(model).alias("exposure_model"),
            F.lit(None).cast("string").alias("reason"),
            F.lit(replicates).alias("n_permutations"),
            F.lit(seed).alias("seed"),
            F.lit(n_total).cast("bigint").alias("n_total"),
            F.lit(n_units).cast("bigint").alias("n_units"),
            F.lit(b["subject"]).alias("subject"),
            F.lit(b["unit"]).cast("string").alias("unit"),
            F.lit(b["observed"]).cast("bigint").alias("observed"),
            shown(float(b["expected"]), 2).alias("expected"),
            shown(float(b["z"]), 2).alias("std_excess"),
            shown(F.col(column), 4).alias("pseudo_p"),
        )
        for b, column in ((most, "most_p"), (raw, "raw_p"))
    ]
    return p.select(F.inline(F.array(*rows)))


def declared_concentration_test(
    df: DataFrame, catalog: Catalog, dataset: str, unit: str, base_dir: str, **options
) -> DataFrame:
    """The test with the exposure the catalog declares for the column."""
    if unit not in catalog.column_specs(dataset):
        raise ValueError(f"column not in the catalog entry: {unit!r}")
    declared = catalog.exposure(dataset, unit)
    if declared is None:
        return concentration_test(df, unit, **options)
    if declared["uniform"]:
        return concentration_test(df, unit, uniform=True, **options)
    exposure = exposure_table(
        scan(df.sparkSession, f"{base_dir}/{declared['path']}"), declared["key"], declared["weight"]
    )
    return concentration_test(df, unit, exposure, declared["path"].rsplit("/", 1)[-1], **options)


def _reject(bad: DataFrame, message: str) -> None:
    shown = [r["unit"] for r in bad.select("unit").limit(_SHOWN).collect()]  # for the message only
    raise ValueError(f"{message}: {shown}")
