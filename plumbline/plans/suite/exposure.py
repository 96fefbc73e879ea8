"""Counts against exposure: orders per nation, exposed by customers per nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.stats import std_excess
from plumbline.operators import exposure_tests as x
from plumbline.plans.concentration import abstention, concentration_test
from plumbline.plans.suite import query, table
from plumbline.sources.exposure import exposure_table

# Orders with their nation, every 20th without one; customers per nation, one row without a nation.
_EVENTS = """(SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS unit
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
_WEIGHTS = """(SELECT CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS key,
  CAST(count(*) AS DOUBLE) AS weight FROM customer GROUP BY 1)"""
_COUNTS = f"(SELECT unit, count(*) AS observed FROM {_EVENTS} GROUP BY 1)"
_EXPOSED = f"(SELECT c.unit, c.observed, e.weight FROM {_COUNTS} c LEFT JOIN {_WEIGHTS} e ON c.unit IS NOT DISTINCT FROM e.key)"
_TESTED = f"""(SELECT *, (observed - expected) / sqrt(expected) AS z FROM (SELECT *, n_total * (weight / sum(weight) OVER ()) AS expected
  FROM (SELECT *, CAST(sum(observed) OVER () AS BIGINT) AS n_total FROM {_EXPOSED})))"""


def events(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 20 != 0, F.col("c_nationkey").cast("string")).alias("unit"),
    )


def weights(spark, folder):
    counted = (
        table(spark, folder, "customer")
        .groupBy(F.when(F.col("c_custkey") % 20 != 0, F.col("c_nationkey")).alias("nation"))
        .agg(F.count(F.lit(1)).alias("customers"))
    )
    return exposure_table(counted, "nation", "customers")


def exposed(spark, folder):
    return x.join_exposure(x.unit_counts(events(spark, folder), "unit"), weights(spark, folder))


@query("exp_counts", f"SELECT * FROM {_COUNTS}")
def exp_counts(spark, folder):
    return x.unit_counts(events(spark, folder), "unit")


@query("exp_scan", f"SELECT * FROM {_WEIGHTS}")
def exp_scan(spark, folder):
    return weights(spark, folder)


@query("exp_join", f"SELECT * FROM {_EXPOSED}")
def exp_join(spark, folder):
    return exposed(spark, folder)


@query("exp_total", f"SELECT CAST(sum(observed) AS BIGINT) AS n_total FROM {_COUNTS}")
def exp_total(spark, folder):
    return x.unit_counts(events(spark, folder), "unit").agg(F.sum("observed").alias("n_total"))


@query(
    "exp_missing",
    f"SELECT c.unit, c.observed FROM {_COUNTS} c LEFT JOIN (SELECT * FROM {_WEIGHTS} WHERE key IS NULL OR CAST(key AS INTEGER) % 3 <> 0) e ON c.unit IS NOT DISTINCT FROM e.key WHERE e.weight IS NULL",
)
def exp_missing(spark, folder):
    partial = weights(spark, folder).filter(F.col("key").isNull() | (F.col("key").cast("int") % 3 != 0))
    return x.missing_exposure(x.unit_counts(events(spark, folder), "unit"), partial)


@query(
    "exp_bad_weights",
    f"SELECT unit, observed, weight - 60 AS weight FROM {_EXPOSED} WHERE weight - 60 <= 0",
)
def exp_bad_weights(spark, folder):
    lowered = exposed(spark, folder).withColumn("weight", F.col("weight") - 60)
    return x.bad_weights(lowered)


@query("exp_uniform", f"SELECT unit, observed, 1.0::DOUBLE AS weight FROM {_COUNTS}")
def exp_uniform(spark, folder):
    return x.uniform_exposure(x.unit_counts(events(spark, folder), "unit"))


@query(
    "exp_abstain",
    f"SELECT 'unit' AS unit_col, 'abstention' AS exposure_model, count(*) AS n_units, CAST(sum(observed) AS BIGINT) AS n_total FROM {_COUNTS}",
)
def exp_abstain(spark, folder):
    counts = x.unit_counts(events(spark, folder), "unit")
    return abstention(counts, "unit").select("unit_col", "exposure_model", "n_units", "n_total")


@query("exp_expected", f"SELECT unit, observed, round(expected, 6) AS expected FROM {_TESTED}")
def exp_expected(spark, folder):
    return x.with_expected(exposed(spark, folder)).select(
        "unit", "observed", F.round("expected", 6).alias("expected")
    )


@query("exp_zscore", f"SELECT unit, round(z, 6) AS z FROM {_TESTED}")
def exp_zscore(spark, folder):
    return x.with_expected(exposed(spark, folder)).select("unit", F.round("z", 6).alias("z"))


@query(
    "exp_std_excess",
    "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN round((s_nationkey - s_acctbal) / sqrt(s_acctbal), 6) ELSE 0.0 END AS z FROM supplier",
)
def exp_std_excess(spark, folder):
    z = std_excess(F.col("s_nationkey").cast("double"), F.col("s_acctbal"))
    return table(spark, folder, "supplier").select("s_suppkey", F.round(z, 6).alias("z"))


@query(
    "exp_argmax",
    f"""(SELECT 'most_concentrated' AS subject, unit, observed, round(expected, 6) AS expected, round(z, 6) AS z
      FROM {_TESTED} ORDER BY z DESC, unit NULLS LAST LIMIT 1)
    UNION ALL (SELECT 'highest_raw_count', unit, observed, round(expected, 6), round(z, 6)
      FROM {_TESTED} ORDER BY observed DESC, unit NULLS LAST LIMIT 1)""",
)
def exp_argmax(spark, folder):
    best = x.argmax_units(x.with_expected(exposed(spark, folder)))
    return best.withColumn("expected", F.round("expected", 6)).withColumn("z", F.round("z", 6))


_REDRAWS = f"""(WITH edges AS (SELECT key, sum(weight) OVER (ORDER BY key NULLS LAST) AS hi, sum(weight) OVER () AS total FROM {_WEIGHTS}),
  spans AS (SELECT key, hi, lag(hi, 1, 0.0) OVER (ORDER BY hi) AS lo, total FROM edges),
  draws AS (SELECT r.replicate, CAST('0x' || substr(md5('42|' || r.replicate || '|' || o_orderkey), 1, 8) AS BIGINT) / 4294967296.0 AS u
    FROM {_EVENTS} CROSS JOIN (SELECT unnest(range(19)) AS replicate) r)
  SELECT replicate, key AS unit, count(*) AS n FROM draws JOIN spans ON u * total >= lo AND u * total < hi GROUP BY 1, 2)"""


def _redraws(spark, folder):
    return x.hashed_redraws(events(spark, folder), "o_orderkey", weights(spark, folder), 19)


@query("null_hashed", f"SELECT CAST(replicate AS BIGINT) AS replicate, unit, n FROM {_REDRAWS}")
def null_hashed(spark, folder):
    return _redraws(spark, folder).withColumn("replicate", F.col("replicate").cast("bigint"))


@query(
    "null_hashed_p",
    f"""WITH t AS {_TESTED}, d AS {_REDRAWS},
    s AS (SELECT r.replicate, max((coalesce(d.n, 0) - t.expected) / sqrt(t.expected)) AS max_z
      FROM t CROSS JOIN (SELECT unnest(range(19)) AS replicate) r
      LEFT JOIN d ON d.replicate = r.replicate AND d.unit IS NOT DISTINCT FROM t.unit GROUP BY 1)
    SELECT (count(*) FILTER (WHERE max_z >= (SELECT max(z) FROM t) - 1e-9) + 1) / (count(*) + 1) AS pseudo_p FROM s""",
)
def null_hashed_p(spark, folder):
    """Pseudo-p of the largest excess over redraws that SQL can repeat.

    A unit that a replicate leaves out has a negative excess, so it never decides the maximum.
    """
    tested = x.with_expected(exposed(spark, folder)).select("unit", "expected", "z")
    redrawn = _redraws(spark, folder).alias("d").join(
        tested.alias("t"), F.expr("d.unit <=> t.unit")
    )
    largest = redrawn.groupBy("replicate").agg(
        F.max(std_excess(F.col("n").cast("double"), F.col("expected"))).alias("max_z")
    )
    observed = tested.agg(F.max("z")).scalar()
    return largest.agg(
        (
            (F.count_if(F.col("max_z") >= observed - 1e-9) + 1) / (F.count(F.lit(1)) + 1)
        ).alias("pseudo_p")
    )


@query("null_multinomial")
def null_multinomial(spark, folder):
    """Replicates of the null statistics; random by nature, so checked by its properties in tests."""
    tested = x.with_expected(exposed(spark, folder))
    raw = x.argmax_units(tested).filter(F.col("subject") == "highest_raw_count").first()
    units = tested.select(
        F.lit(0).cast("bigint").alias("group"), "unit", "weight", "expected", "n_total",
        F.col("unit").eqNullSafe(F.lit(raw["unit"])).alias("fixed"),
    )
    return x.null_statistics(units, 999, 42)


@query(
    "concentration_report",
)
def concentration_report(spark, folder):
    """The full test with 999 replicates; its pseudo-p rests on random draws."""
    return concentration_test(
        events(spark, folder), "unit", weights(spark, folder), "customers per nation"
    )


@query(
    "concentration_measures",
    f"""SELECT subject, unit, observed, round(expected, 6) AS expected, round(z, 6) AS std_excess, n_total, n_units FROM (
      (SELECT 'most_concentrated' AS subject, unit, observed, expected, z, n_total, (SELECT count(*) FROM {_COUNTS}) AS n_units
        FROM {_TESTED} ORDER BY z DESC, unit NULLS LAST LIMIT 1)
      UNION ALL (SELECT 'highest_raw_count', unit, observed, expected, z, n_total, (SELECT count(*) FROM {_COUNTS})
        FROM {_TESTED} ORDER BY observed DESC, unit NULLS LAST LIMIT 1))""",
)
def concentration_measures(spark, folder):
    """The report without its random part."""
    report = concentration_test(
        events(spark, folder), "unit", weights(spark, folder), "customers per nation",
        rounded=False,
    )
    return report.select(
        "subject", "unit", "observed", F.round("expected", 6).alias("expected"),
        F.round("std_excess", 6).alias("std_excess"), "n_total", "n_units",
    )


_CROWDED = f"(SELECT unit, CAST(CASE WHEN unit = '7' THEN 6 ELSE 1 END * observed AS BIGINT) AS observed FROM {_COUNTS})"


@query(
    "concentration_planted",
    f"""WITH e AS (SELECT c.unit, c.observed, w.weight FROM {_CROWDED} c LEFT JOIN {_WEIGHTS} w ON c.unit IS NOT DISTINCT FROM w.key),
    t AS (SELECT unit, observed, CAST(sum(observed) OVER () AS BIGINT) AS n_total, count(*) OVER () AS n_units,
      sum(observed) OVER () * (weight / sum(weight) OVER ()) AS expected FROM e),
    top AS (SELECT *, (observed - expected) / sqrt(expected) AS z FROM t ORDER BY observed DESC LIMIT 1)
    SELECT s.subject, 999 AS n_permutations, n_total, n_units, unit, observed, round(expected, 6) AS expected,
      round(z, 6) AS std_excess, CAST(0.001 AS DOUBLE) AS pseudo_p FROM top, (VALUES ('most_concentrated'), ('highest_raw_count')) AS s(subject)""",
)
def concentration_planted(spark, folder):
    """The full test on orders of which one nation has six times its own: no draw reaches that, so p is 1 / 1000."""
    copies = F.when(F.col("unit") == "7", 6).otherwise(1)
    crowded = events(spark, folder).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    report = concentration_test(crowded, "unit", weights(spark, folder), "customers per nation", rounded=False)
    return report.select(
        "subject", "n_permutations", "n_total", "n_units", "unit", "observed",
        F.round("expected", 6).alias("expected"), F.round("std_excess", 6).alias("std_excess"), "pseudo_p",
    )
