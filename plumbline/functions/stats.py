"""Column formulas shared by the profiles and the null-model tests."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL for an empty whole (an empty table has no rates)."""
    return F.when(whole > 0, part / whole)


def entropy_bits(counts: Column) -> Column:
    """Aggregate: Shannon entropy of a frequency table, H = log2(n) - sum(c log2 c) / n.

    This form needs no second pass for n, so it stays one partial aggregation.
    """
    n = F.sum(counts)
    return F.greatest(F.lit(0.0), F.log2(n) - F.sum(counts * F.log2(counts)) / n)


def sample_skewness(value: Column) -> Column:
    """Aggregate: bias-corrected skewness (Spark's own is the population form)."""
    n = F.count(value).cast("double")
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def std_excess(observed: Column, expected: Column) -> Column:
    """Standardised Poisson excess (O - E) / sqrt(E); 0 where nothing is expected."""
    return F.when(expected > 0, (observed - expected) / F.sqrt(expected)).otherwise(F.lit(0.0))


def pseudo_p(null_stat: Column, observed: Column) -> Column:
    """Aggregate: (#{null >= observed} + 1) / (replicates + 1)."""
    return (F.count_if(null_stat >= observed) + 1) / (F.count(F.lit(1)) + 1)


# Coefficients of the polynomial 26.2.17 of Abramowitz and Stegun, and its scale.
_TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
_TAIL_SCALE = 0.2316419
_TAIL_STEPS = 16


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal; NULL for NULL.

    Below 2 a polynomial (absolute error below 1e-7), beyond a continued fraction, which keeps small tails
    accurate relative to their own size.
    """
    a = F.abs(z)
    density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    t = 1 / (1 + a * _TAIL_SCALE)
    polynomial = F.lit(0.0)
    for c in reversed(_TAIL):
        polynomial = (polynomial + c) * t
    fraction = a
    for step in range(_TAIL_STEPS, 0, -1):
        fraction = a + step / fraction
    upper = density * F.when(a < 2, polynomial).otherwise(1 / fraction)
    return F.when(z < 0, 1 - upper).otherwise(upper)
