"""Points in hexagonal cells: lineitem gives the points, orders the weighted grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.hexgrid import EDGE_METRES, ORIGIN, SQRT3
from plumbline.functions.lv95 import to_wgs84
from plumbline.operators import cells as c
from plumbline.operators.exposure_tests import with_expected
from plumbline.operators.prepare import point
from plumbline.plans.scale_robustness import scale_robustness
from plumbline.plans.suite import query, table
from plumbline.sources.catalog import catalog_from_entries
from plumbline.sources.exposure import exposure_grid

RESOLUTIONS = (6, 7, 8)

_POINTS = """(SELECT CASE WHEN k % 211 = 0 THEN 0.0 WHEN k % 307 = 0 THEN n ELSE e END AS x,
    CASE WHEN k % 211 = 0 THEN 0.0 WHEN k % 307 = 0 THEN e ELSE n END AS y
  FROM (SELECT k, CAST(CASE WHEN hot THEN 2600000 + k % 700 ELSE 2480000 + (k * 7919) % 360000 END AS DOUBLE) AS e,
      CAST(CASE WHEN hot THEN 1200000 + (k * 31) % 700 ELSE 1070000 + (k * 104729) % 230000 END AS DOUBLE) AS n
    FROM (SELECT l_orderkey * 8 + l_linenumber AS k, l_returnflag = 'R' AND l_quantity >= 48 AS hot FROM lineitem))
  WHERE k % 97 <> 0)"""
_GRID = """(SELECT CAST(2480000 + (o_orderkey * 7919) % 360000 AS DOUBLE) + 50.0 AS x,
  CAST(1070000 + (o_orderkey * 5407) % 230000 AS DOUBLE) + 50.0 AS y, o_totalprice AS weight FROM orders)"""


def cells_sql(source: str, aggregate: str) -> str:
    parts = []
    for r in RESOLUTIONS:
        edge = f"{EDGE_METRES[r]!r}::DOUBLE"
        parts.append(
            f"""SELECT {r} AS resolution, CAST({r << 56} AS BIGINT) + CAST(q + {1 << 27} AS BIGINT) * {1 << 28} + CAST(r + {1 << 27} AS BIGINT) AS cell, {aggregate}
      FROM (SELECT *, CASE WHEN near THEN i - j ELSE floor(u) - floor(v) END AS q, CASE WHEN near THEN 2 * j ELSE 2 * floor(v) + 1 END AS r
        FROM (SELECT *, abs(u - i) + abs(v - j) * 3.0::DOUBLE <= 1.0::DOUBLE AS near
          FROM (SELECT *, floor(u + 0.5::DOUBLE) AS i, floor(v + 0.5::DOUBLE) AS j
            FROM (SELECT *, (x - {ORIGIN[0]!r}::DOUBLE) / ({edge} * {SQRT3!r}::DOUBLE) AS u,
                (y - {ORIGIN[1]!r}::DOUBLE) / ({edge} * 3.0::DOUBLE) AS v FROM {source}))))
      GROUP BY 1, 2"""
        )
    return "(" + " UNION ALL ".join(parts) + ")"


_COUNTS = cells_sql(_POINTS, "count(*) AS observed")
_WEIGHTS = cells_sql(_GRID, "sum(weight) AS weight")
_SPLIT = f"""(SELECT resolution, cell, observed, coalesce(weight, 0) AS weight, coalesce(weight, 0) > 0 AS testable
  FROM {_COUNTS} LEFT JOIN {_WEIGHTS} USING (resolution, cell))"""
_TESTED = f"""(SELECT *, (observed - expected) / sqrt(expected) AS z FROM (
  SELECT *, sum(observed) OVER (PARTITION BY resolution) * (weight / sum(weight) OVER (PARTITION BY resolution)) AS expected
  FROM {_SPLIT} WHERE testable))"""


def points(spark, folder):
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    hot = (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 48)
    rows = table(spark, folder, "lineitem").select(
        k.alias("k"),
        F.when(hot, F.lit(2600000) + k % 700).otherwise(F.lit(2480000) + (k * 7919) % 360000).cast("double").alias("e"),
        F.when(hot, F.lit(1200000) + (k * 31) % 700).otherwise(F.lit(1070000) + (k * 104729) % 230000).cast("double").alias("n"),
    )
    e, n = F.col("e"), F.col("n")
    geom = (
        F.when(F.col("k") % 97 == 0, F.lit(None))
        .when(F.col("k") % 211 == 0, point(F.lit(0), F.lit(0)))
        .when(F.col("k") % 307 == 0, point(n, e))
        .otherwise(point(e, n))
    )
    return rows.select(geom.alias("geom"))


def grid(spark, folder):
    k = F.col("o_orderkey")
    corners = table(spark, folder, "orders").select(
        (F.lit(2480000) + (k * 7919) % 360000).alias("east"),
        (F.lit(1070000) + (k * 5407) % 230000).alias("north"),
        "o_totalprice",
    )
    return exposure_grid(corners, "east", "north", "o_totalprice", 100, "sw_corner")


def _split(spark, folder):
    return c.split_cells(
        c.cell_counts(points(spark, folder), "geom", RESOLUTIONS),
        c.cell_exposure(grid(spark, folder), RESOLUTIONS),
    )


@query("cell_grid", f"SELECT x, y, weight FROM {_GRID}")
def cell_grid(spark, folder):
    return grid(spark, folder)


@query("cell_counts", f"SELECT resolution, cell, observed FROM {_COUNTS}")
def cell_counts(spark, folder):
    return c.cell_counts(points(spark, folder), "geom", RESOLUTIONS)


@query("cell_exposure", f"SELECT resolution, cell, round(weight, 4) AS weight FROM {_WEIGHTS}")
def cell_exposure(spark, folder):
    out = c.cell_exposure(grid(spark, folder), RESOLUTIONS)
    return out.withColumn("weight", F.round("weight", 4))


@query("cell_split", f"SELECT resolution, testable, count(*) AS n, CAST(sum(observed) AS BIGINT) AS points FROM {_SPLIT} GROUP BY 1, 2")
def cell_split(spark, folder):
    return _split(spark, folder).groupBy("resolution", "testable").agg(
        F.count(F.lit(1)).alias("n"), F.sum("observed").alias("points")
    )


@query(
    "cell_unpopulated",
    f"""SELECT resolution, count(*) FILTER (WHERE NOT testable) AS n_cells,
    CAST(coalesce(sum(observed) FILTER (WHERE NOT testable), 0) AS BIGINT) AS n_points,
    coalesce(sum(observed) FILTER (WHERE NOT testable), 0) / greatest(1, sum(observed)) AS share FROM {_SPLIT} GROUP BY 1""",
)
def cell_unpopulated(spark, folder):
    return c.unpopulated(_split(spark, folder))


@query("cell_expected", f"SELECT resolution, cell, round(expected, 6) AS expected, round(z, 6) AS z FROM {_TESTED}")
def cell_expected(spark, folder):
    tested = with_expected(_split(spark, folder).filter("testable"), "resolution")
    return tested.select(
        "resolution", "cell", F.round("expected", 6).alias("expected"), F.round("z", 6).alias("z")
    )


_CENTRES = f"""(SELECT resolution, cell, {SQRT3!r}::DOUBLE * (q + r / 2.0::DOUBLE) * edge + {ORIGIN[0]!r}::DOUBLE AS x,
  1.5::DOUBLE * r * edge + {ORIGIN[1]!r}::DOUBLE AS y
  FROM (SELECT resolution, cell, CAST(cell % {1 << 28} - {1 << 27} AS DOUBLE) AS r,
    CAST((cell // {1 << 28}) % {1 << 28} - {1 << 27} AS DOUBLE) AS q,
    CASE resolution {" ".join(f"WHEN {r} THEN {EDGE_METRES[r]!r}::DOUBLE" for r in RESOLUTIONS)} END AS edge FROM {_COUNTS}))"""


def _wgs84_sql(source: str, keep: str) -> str:
    """The published approximation again, in SQL."""
    return f"""SELECT {keep},
      round((2.6779094 + 4.728982 * v + 0.791484 * v * u + 0.1306 * v * u * u - 0.0436 * v * v * v) * 100 / 36, 7) AS lng,
      round((16.9023892 + 3.238272 * u - 0.270978 * v * v - 0.002528 * u * u - 0.0447 * v * v * u - 0.0140 * u * u * u) * 100 / 36, 7) AS lat
      FROM (SELECT *, (x - 2600000)::DOUBLE / 1e6::DOUBLE AS v, (y - 1200000)::DOUBLE / 1e6::DOUBLE AS u FROM {source})"""


@query("cell_centre", _wgs84_sql(_CENTRES, "resolution, cell, round(x, 3) AS x, round(y, 3) AS y"))
def cell_centre(spark, folder):
    cells = c.cell_counts(points(spark, folder), "geom", RESOLUTIONS).drop("observed")
    placed = c.with_centres(cells)
    return placed.select(
        "resolution", "cell", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"),
        F.round("lng", 7).alias("lng"), F.round("lat", 7).alias("lat"),
    )


@query("reproject", _wgs84_sql(_GRID, "x, y"))
def reproject(spark, folder):
    lng, lat = to_wgs84(F.col("x"), F.col("y"))
    return grid(spark, folder).select(
        "x", "y", F.round(lng, 7).alias("lng"), F.round(lat, 7).alias("lat")
    )


@query(
    "cell_peak",
    f"""SELECT resolution, cell, round(z, 6) AS z, n FROM (SELECT *, row_number() OVER (PARTITION BY resolution ORDER BY z DESC, cell) AS rk,
    count(*) OVER (PARTITION BY resolution) AS n FROM {_TESTED}) WHERE rk = 1""",
)
def cell_peak(spark, folder):
    report = scale_robustness(points(spark, folder), "geom", grid(spark, folder), RESOLUTIONS, rounded=False)
    return report.select(
        "resolution", F.col("peak_cell").alias("cell"), F.round("peak_std_excess", 6).alias("z"),
        F.col("n_cells_tested").alias("n"),
    )


@query("scale_robustness")
def robustness(spark, folder):
    """The full report at three resolutions with 999 replicates each; its pseudo-p is random."""
    return scale_robustness(points(spark, folder), "geom", grid(spark, folder), RESOLUTIONS)


_EVEN = "(SELECT CAST(2480000 + (k * 7919) % 360000 AS DOUBLE) + 50.0 AS x, CAST(1070000 + (k * 5407) % 230000 AS DOUBLE) + 50.0 AS y FROM (SELECT {} AS k FROM orders {}))"
_EVEN_ALL = _EVEN.format("o_orderkey", "")
_CROWD = _EVEN.format("(SELECT min(o_orderkey) FROM orders)", "WHERE o_orderkey % 3 = 0")
_CROWDED = f"(SELECT * FROM {_EVEN_ALL} UNION ALL SELECT * FROM {_CROWD})"


def _even_grid(spark, folder):
    """Exposure 1 at the place of every order."""
    k = F.col("o_orderkey")
    corners = table(spark, folder, "orders").select(
        (F.lit(2480000) + (k * 7919) % 360000).alias("east"), (F.lit(1070000) + (k * 5407) % 230000).alias("north"), F.lit(1.0).alias("w")
    )
    return exposure_grid(corners, "east", "north", "w", 100, "sw_corner")


# No cell expects less than one point here, so an excess of 50 standard deviations is beyond all 999 redistributions
# (Chernoff's bound is below 1e-50 for each cell of each): p is 1 / 1000 at every resolution.
@query(
    "scale_planted",
    f"""SELECT resolution, n AS n_cells_tested, n_total AS n_total_tested, cell AS peak_cell, round(z, 2) AS peak_std_excess,
    CASE WHEN z > 50 AND least_expected >= 1 THEN 0.001::DOUBLE END AS pseudo_p, z > 50 AS significant,
    CASE WHEN min(z) OVER () > 50 THEN 'robuste' END AS verdict
    FROM (SELECT *, (observed - expected) / sqrt(expected) AS z, min(expected) OVER (PARTITION BY resolution) AS least_expected,
        row_number() OVER (PARTITION BY resolution ORDER BY (observed - expected) / sqrt(expected) DESC, cell) AS rk,
        count(*) OVER (PARTITION BY resolution) AS n
      FROM (SELECT resolution, cell, observed, CAST(sum(observed) OVER (PARTITION BY resolution) AS BIGINT) AS n_total,
          sum(observed) OVER (PARTITION BY resolution) * (weight / sum(weight) OVER (PARTITION BY resolution)) AS expected
        FROM {cells_sql(_CROWDED, "count(*) AS observed")} JOIN {cells_sql(_EVEN_ALL, "count(*)::DOUBLE AS weight")} USING (resolution, cell)))
    WHERE rk = 1""",
)
def scale_planted(spark, folder):
    """Points as the exposure, and a third as many again at one place: robust."""
    even, k = _even_grid(spark, folder), F.col("o_orderkey")
    first = table(spark, folder, "orders").agg(F.min(k)).first()[0]
    place = point(F.lit(2480000.0 + first * 7919 % 360000 + 50), F.lit(1070000.0 + first * 5407 % 230000 + 50))
    crowd = table(spark, folder, "orders").filter(k % 3 == 0).select(place.alias("geom"))
    points_here = even.select(point(F.col("x"), F.col("y")).alias("geom")).unionByName(crowd)
    report = scale_robustness(points_here, "geom", even, RESOLUTIONS)
    return report.select(
        "resolution", "n_cells_tested", "n_total_tested", "peak_cell", "peak_std_excess", "pseudo_p", "significant", "verdict"
    )


@query(
    "scale_proportional",
    f"""SELECT resolution, count(*) AS n_cells_tested, CAST(sum(observed) AS BIGINT) AS n_total_tested, 0.0::DOUBLE AS peak_std_excess,
    1.0::DOUBLE AS pseudo_p, false AS significant, 'absente' AS verdict, CAST(0 AS BIGINT) AS unpopulated_points
    FROM {cells_sql(_EVEN_ALL, "count(*) AS observed")} GROUP BY 1""",
)
def scale_proportional(spark, folder):
    """As many points as exposure in every cell: no excess, so every redistribution reaches the observed peak."""
    even = _even_grid(spark, folder)
    report = scale_robustness(even.select(point(F.col("x"), F.col("y")).alias("geom")), "geom", even, RESOLUTIONS)
    return report.select(
        "resolution", "n_cells_tested", "n_total_tested", (F.col("peak_std_excess") + 0.0).alias("peak_std_excess"),
        "pseudo_p", "significant", "verdict", "unpopulated_points",
    )


@query("scale_abstention", "SELECT unnest([6, 7, 8]) AS resolution, 'abstention' AS exposure_model, (SELECT count(*) FROM lineitem) AS n_rows")
def scale_abstention(spark, folder):
    rows = points(spark, folder)
    out = scale_robustness(rows, "geom", None, RESOLUTIONS).select("resolution", "exposure_model")
    return out.withColumn("n_rows", rows.agg(F.count(F.lit(1))).scalar())


# --- catalog of the given tables -------------------------------------------------------------------

_CLASSES = "CASE c_nationkey % 3 WHEN 0 THEN 'categorical' WHEN 1 THEN 'spatial' ELSE 'numeric' END"


def _customer_catalog(spark, folder):
    """One catalog entry per market segment with one column per nation, made from the data."""
    spec = F.struct(
        F.when(F.col("c_nationkey") % 3 == 0, "categorical")
        .when(F.col("c_nationkey") % 3 == 1, "spatial").otherwise("numeric").alias("type"),
        F.when(F.col("c_nationkey") % 2 == 0, "point").alias("geometry_type_attendu"),
        F.lit(2056).alias("srid"),
    )
    pairs = (
        table(spark, folder, "customer").select("c_mktsegment", "c_nationkey").distinct()
        .groupBy("c_mktsegment")
        .agg(F.array_sort(F.collect_list(F.struct("c_nationkey", spec.alias("spec")))).alias("p"))
    )
    named = F.transform("p", lambda e: F.struct(F.concat(F.lit("c"), e["c_nationkey"].cast("string")).alias("k"), e["spec"].alias("v")))
    entries = pairs.select(
        F.to_json(
            F.struct(
                F.col("c_mktsegment").alias("dataset"),
                F.map_from_entries(named).alias("columns"),
                F.create_map(
                    F.lit("c1"),
                    F.struct(F.lit("spatial_grid").alias("kind"), F.lit("BUILDING").alias("fiche"), F.lit("w").alias("weight")),
                ).alias("exposures"),
                F.struct(F.lit("e").alias("east"), F.lit("n").alias("north"), F.lit(100.0).alias("cell_size"), F.lit("sw_corner").alias("coord_ref")).alias("grid"),
            )
        )
    )
    # One text per market segment.
    return catalog_from_entries(spark, [r[0] for r in entries.collect()])


@query(
    "catalog_columns",
    f"""SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY nk) - 1 AS INTEGER) AS ordinal, 'c' || nk AS "column", kind AS type
    FROM (SELECT DISTINCT c_mktsegment AS dataset, c_nationkey AS nk, {_CLASSES} AS kind FROM customer)""",
)
def catalog_columns(spark, folder):
    return _customer_catalog(spark, folder).columns.select("dataset", "ordinal", "column", "type")


@query("catalog_datasets", "SELECT DISTINCT c_mktsegment AS dataset FROM customer")
def catalog_datasets(spark, folder):
    return _customer_catalog(spark, folder).list_datasets()


@query(
    "catalog_resolve",
    """SELECT DISTINCT c_mktsegment AS dataset, 'c1' AS "column", 'BUILDING' AS entry, 100.0 AS cell_size FROM customer
    WHERE (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') > 0
    UNION ALL SELECT DISTINCT c_mktsegment, 'c1', 'BUILDING', CAST(NULL AS DOUBLE) FROM customer
    WHERE (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') = 0""",
)
def catalog_resolve(spark, folder):
    return _customer_catalog(spark, folder).resolved_grids().select("dataset", "column", "entry", "cell_size")


@query(
    "catalog_point_column",
    f"""SELECT c_mktsegment AS dataset, 'c' || min(c_nationkey) AS "column", 2056 AS srid FROM customer
    WHERE c_nationkey % 3 = 1 AND c_nationkey % 2 = 0 GROUP BY 1""",
)
def catalog_point_column(spark, folder):
    return _customer_catalog(spark, folder).point_columns()
