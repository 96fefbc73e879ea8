"""Neighbours, adjusted p-values and crossed profiles over the given tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from plumbline.operators.cells import cell_counts
from plumbline.operators.crossed import contingency, correlations
from plumbline.operators.hot_spots import local_statistics
from plumbline.operators.neighbours import nearest_neighbours
from plumbline.operators.ranking import value_ranks
from plumbline.plans.suite import query, table
from plumbline.plans.suite.cells import _COUNTS, RESOLUTIONS, points

# Orders as points: finished ones in a dense square of 875 m, every fiftieth on one of ten shared places, the others
# all over the country; some have no point.
_PLACES = """(SELECT k, CASE WHEN k % 50 = 0 THEN 2500000.0::DOUBLE + k % 10 * 1000
      WHEN hot THEN 2600000.0::DOUBLE + (k * 7919) % 7001 / 8.0::DOUBLE ELSE 2480000.0::DOUBLE + (k * 7919) % 360000 END AS x,
    CASE WHEN k % 50 = 0 THEN 1100000.0::DOUBLE
      WHEN hot THEN 1200000.0::DOUBLE + (k * 104729) % 7013 / 8.0::DOUBLE ELSE 1070000.0::DOUBLE + (k * 5407) % 230000 END AS y
  FROM (SELECT o_orderkey AS k, o_orderstatus = 'F' AS hot FROM orders) WHERE k % 97 <> 0)"""


def places(spark, folder):
    k, hot = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    x = F.when(k % 50 == 0, F.lit(2500000.0) + k % 10 * 1000).when(hot, F.lit(2600000.0) + (k * 7919) % 7001 / 8.0)
    y = F.when(k % 50 == 0, F.lit(1100000.0)).when(hot, F.lit(1200000.0) + (k * 104729) % 7013 / 8.0)
    x = x.otherwise(F.lit(2480000.0) + (k * 7919) % 360000)
    y = y.otherwise(F.lit(1070000.0) + (k * 5407) % 230000)
    placed = F.struct(x.alias("x"), y.alias("y"))
    return table(spark, folder, "orders").select(k.alias("k"), F.when(k % 97 != 0, placed).alias("geom"))


@query(
    "spa_nearest",
    f"""WITH p AS MATERIALIZED {_PLACES} SELECT k, m.k AS neighbour, sqrt(m.d) AS distance FROM (
      SELECT a.k, min({{'d': (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), 'k': b.k}}) AS m
      FROM p a JOIN p b ON a.k <> b.k GROUP BY 1)""",
)
def spa_nearest(spark, folder):
    return nearest_neighbours(places(spark, folder), "k", F.col("geom.x"), F.col("geom.y"))


# The same statistics from pairs of cells at most one ring apart, by the centres' axial coordinates.
_LOCAL = f"""WITH cells AS MATERIALIZED (SELECT resolution, cell, observed::DOUBLE AS v, (cell >> 28) % {1 << 28} AS q, cell % {1 << 28} AS r FROM {_COUNTS}),
  near AS (SELECT a.resolution, a.cell, sum(b.v) AS near_sum, count(*) AS n_near FROM cells a JOIN cells b
    ON a.resolution = b.resolution AND b.q BETWEEN a.q - 1 AND a.q + 1 AND b.r BETWEEN a.r - 1 AND a.r + 1
    AND abs(b.q - a.q + b.r - a.r) <= 1 GROUP BY 1, 2),
  whole AS (SELECT resolution, count(*) AS n, avg(v) AS m, var_pop(v) AS s2 FROM cells GROUP BY 1),
  stats AS (SELECT resolution, cell, v, n_near, near_sum,
      CASE WHEN s2 > 0 AND n_near < n THEN (near_sum - n_near * m) / sqrt(s2 * (n_near * (n - n_near)) / (n - 1)) END AS gi,
      CASE WHEN s2 > 0 THEN (v - m) * (near_sum - v - (n_near - 1) * m) / s2 + 0.0::DOUBLE END AS moran
    FROM cells JOIN near USING (resolution, cell) JOIN whole USING (resolution)),
  tails AS (SELECT *, CASE WHEN gi < 0 THEN 1 - upper ELSE upper END AS p FROM (SELECT *, exp(-gi * gi / 2) / sqrt(2 * pi()) *
      CASE WHEN abs(gi) < 2 THEN t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
      ELSE 1 / list_reduce([abs(gi)] || list_reverse(range(1, 17))::DOUBLE[], lambda f, s: abs(gi) + s / f) END AS upper
    FROM (SELECT *, 1 / (1 + 0.2316419 * abs(gi)) AS t FROM stats))),
  ranked AS (SELECT *, p * count(p) OVER (PARTITION BY resolution)
      / count(p) OVER (PARTITION BY resolution ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw FROM tails WHERE p IS NOT NULL)
SELECT resolution, cell, v AS value, n_near, near_sum, round(gi, 6) AS gi_star, round(moran, 6) AS moran, round(p, 6) AS gi_p,
  round(least(1, min(raw) OVER (PARTITION BY resolution ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS gi_p_adjusted FROM ranked"""


@query("cell_hot_spots", _LOCAL)
def cell_hot_spots(spark, folder):
    counts = cell_counts(points(spark, folder), "geom", RESOLUTIONS)
    rounded = ("gi_star", "moran", "gi_p", "gi_p_adjusted")
    local = local_statistics(counts, "observed")
    return local.select("resolution", "cell", "value", "n_near", "near_sum", *[F.round(c, 6).alias(c) for c in rounded])


@query(
    "num_ranks",
    """SELECT l_returnflag, v AS l_quantity, n, below, total, below + (n + 1) / 2.0::DOUBLE AS average_rank FROM (
      SELECT l_returnflag, v, n, CAST(sum(n) OVER (PARTITION BY l_returnflag ORDER BY v) - n AS BIGINT) AS below,
        CAST(sum(n) OVER (PARTITION BY l_returnflag) AS BIGINT) AS total
      FROM (SELECT l_returnflag, l_quantity::DOUBLE AS v, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1, 2))""",
)
def num_ranks(spark, folder):
    return value_ranks(table(spark, folder, "lineitem"), ["l_returnflag"], "l_quantity")


# Line items with a gap in one measure.
_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "part")
_MEASURED = "(SELECT l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax, l_linenumber::DOUBLE AS l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_partkey::DOUBLE END AS part FROM lineitem)"
_RANKED = "(SELECT {} FROM m)".format(", ".join(
    f"{c}, CASE WHEN {c} IS NOT NULL THEN rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE END AS rank_{c}"
    for c in _MEASURES
))


@query(
    "num_correlations",
    f"WITH m AS MATERIALIZED {_MEASURED}, r AS MATERIALIZED {_RANKED} " + " UNION ALL ".join(
        f"""SELECT '{a}' AS column_a, '{b}' AS column_b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n,
        round(corr({a}, {b}), 8) + 0.0::DOUBLE AS pearson, round(corr(rank_{a}, rank_{b}), 8) + 0.0::DOUBLE AS spearman FROM r"""
        for a, b in combinations(_MEASURES, 2)
    ),
)
def num_correlations(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("part", F.when(F.col("l_linenumber") != 3, F.col("l_partkey")))
    out = correlations(rows, _MEASURES)
    return out.withColumn("pearson", F.round("pearson", 8)).withColumn("spearman", F.round("spearman", 8))


_TRAITS = ("o_orderstatus", "o_orderpriority", "month", "clerk")
_TRAITED = """(SELECT o_orderstatus, o_orderpriority, CAST(month(o_orderdate) AS VARCHAR) AS month,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey % 300 AS VARCHAR) END AS clerk FROM orders)"""


def _contingency_sql(a: str, b: str) -> str:
    """Chi-square as the sum over all cells of the full table, also the empty ones."""
    return f"""SELECT '{a}' AS column_a, '{b}' AS column_b, n, n_a, n_b, round(chi, 6) AS chi_square,
      CASE WHEN least(n_a, n_b) > 1 THEN round(sqrt(chi / (n * (least(n_a, n_b) - 1))), 8) END AS cramers_v, round(bits, 8) AS mutual_bits FROM (
      SELECT CAST(sum(o) AS BIGINT) AS n, count(DISTINCT va) AS n_a, count(DISTINCT vb) AS n_b, sum((o - e) * (o - e) / e) AS chi,
        sum(CASE WHEN o > 0 THEN o / total * log2(o / e) ELSE 0 END) AS bits FROM (
        SELECT va, vb, coalesce(o, 0)::DOUBLE AS o, na::DOUBLE * nb / total AS e, total::DOUBLE AS total FROM
          (SELECT {a} AS va, count(*) AS na FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1)
          CROSS JOIN (SELECT {b} AS vb, count(*) AS nb FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1)
          CROSS JOIN (SELECT count(*) AS total FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL)
          LEFT JOIN (SELECT {a} AS va, {b} AS vb, count(*) AS o FROM t GROUP BY 1, 2) USING (va, vb)))"""


@query(
    "cat_contingency",
    f"WITH t AS MATERIALIZED {_TRAITED} " + " UNION ALL ".join(_contingency_sql(a, b) for a, b in combinations(_TRAITS, 2)),
)
def cat_contingency(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderstatus", "o_orderpriority", F.month("o_orderdate").alias("month"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") % 300).alias("clerk"),
    )
    out = contingency(rows, _TRAITS)
    for name, digits in (("chi_square", 6), ("cramers_v", 8), ("mutual_bits", 8)):
        out = out.withColumn(name, F.round(name, digits))
    return out
