"""Scoring of observations and measures against known truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import contains_any, whole_word

# Marks of a positive excess claim, and of its negation.
EXCESS_TERMS = (
    "excès", "exces", "sur-concentr", "sur-représent", "sur-represent", "point chaud",
    "point noir", "anormal",
)
NEGATION_TERMS = (
    "n'est pas", "ne sont pas", "pas un excès", "pas un exces", "sous-représent",
    "sous-represent", "déficit", "deficit", "négati", "negati", "pseudo-p = 1", "pseudo-p=1",
    "pseudo-p de 1",
)
# Terms of safety and of trend, the gate's quorum and number of runs.
SAFETY_TERMS = ("sûr", "sûre", "sécur", "danger", "risque")
TREND_TERMS = ("volume", "baisse", "diminu", "recul", "moins", "tendance")
QUORUM = 4


def check_truth(measured: DataFrame, manifest: DataFrame) -> DataFrame:
    """Measured (metric, value) against a manifest (metric, expected, tolerance, mode).

    Mode `equal` wants the same value, `near` a difference below the tolerance, `min` at least the
    expected value. A metric that was not measured fails.
    """
    value, expected = F.col("value"), F.col("expected")
    held = (
        F.when(F.col("mode") == "equal", value == expected)
        .when(F.col("mode") == "near", F.abs(value - expected) < F.col("tolerance"))
        .when(F.col("mode") == "min", value >= expected)
    )
    return manifest.join(measured, "metric", "left").select(
        "metric", "mode", "expected", "value", F.coalesce(held, F.lit(False)).alias("holds")
    )


def has_keyword(keywords: Sequence[str], statuses: Sequence[str]) -> Column:
    return contains_any(F.col("claim"), keywords) & F.col("statut").isin(list(statuses))


def mentions_both(
    first: Sequence[str], second: Sequence[str], statuses: Sequence[str] = ("fait",)
) -> Column:
    return (
        contains_any(F.col("claim"), first)
        & contains_any(F.col("claim"), second)
        & F.col("statut").isin(list(statuses))
    )


def asserted_excess(unit: str, statuses: Sequence[str] = ("fait",)) -> Column:
    """The claim names the unit as a whole word and asserts, not denies, an excess."""
    claim = F.col("claim")
    return (
        whole_word(claim, unit)
        & contains_any(claim, EXCESS_TERMS)
        & ~contains_any(claim, NEGATION_TERMS)
        & F.col("statut").isin(list(statuses))
    )


def _per_check(observations: DataFrame, checks: dict[str, Column]) -> DataFrame:
    flags = F.array(
        *[F.struct(F.lit(n).alias("check"), c.alias("hit")) for n, c in checks.items()]
    )
    return observations.select("run", F.inline(flags))


def runs_matching(observations: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, n): number of runs with at least one matching observation, all checks in one scan."""
    per_run = _per_check(observations, checks).groupBy("check", "run").agg(
        F.bool_or("hit").alias("hit")
    )
    return per_run.groupBy("check").agg(F.count_if("hit").alias("n"))


def observations_matching(observations: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, n): number of matching observations."""
    return _per_check(observations, checks).groupBy("check").agg(F.count_if("hit").alias("n"))


def threshold_gate(counts: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Counts (check, n) against thresholds (check, at_least, at_most); NULL limits are open."""
    passed = F.coalesce(F.col("n") >= F.col("at_least"), F.lit(True)) & F.coalesce(
        F.col("n") <= F.col("at_most"), F.lit(True)
    )
    return (
        thresholds.join(counts, "check", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .select("check", "n", "at_least", "at_most", passed.alias("passed"))
    )
