"""Preparation jobs and planted anomalies, spatial profiles over planted points."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from plumbline.functions.wkb import (
    decode_wkb,
    geometry,
    point_geometry,
    point_wkb,
    polygons_wkb,
    polyline_wkb,
)
from plumbline.operators import prepare, scoring, temporal
from plumbline.operators.frequency import top_values, value_frequencies
from plumbline.operators.spatial import (
    geometry_types,
    measures_by_type,
    out_of_envelope,
    spatial_profile,
)
from plumbline.plans.suite import query, table
from plumbline.session import spread
from plumbline.sources.local import inline_rows
from plumbline.sources.tables import bounded_view, project, safe_name_column


def uniform_sql(key: str, seed: int, branch: str) -> str:
    return (
        f"(CAST('0x' || substr(md5('{seed}|{branch}|' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"
        " / 4294967296.0)"
    )


def word_sql(key: str, seed: int, branch: str = "") -> str:
    return f"CAST('0x' || substr(md5('{seed}|{branch}|' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"


_COLUMNS = {
    "order_id": ("o_orderkey", "bigint"),
    "status": ("o_orderstatus", "string"),
    "priority": ("o_orderpriority", "string"),
    "price": ("o_totalprice", "int"),
    "day": ("o_orderdate", "date"),
}


@query(
    "prep_project",
    """SELECT CAST(o_orderkey AS BIGINT) AS order_id, o_orderstatus AS status, o_orderpriority AS priority,
    CAST(trunc(o_totalprice) AS INTEGER) AS price, CAST(o_orderdate AS DATE) AS day FROM orders""",
)
def prep_project(spark, folder):
    return project(table(spark, folder, "orders"), _COLUMNS)


@query(
    "prep_view",
    "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
)
def prep_view(spark, folder):
    bounded_view(spark, f"{folder}/orders.parquet", "orders_view")
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM orders_view GROUP BY 1")


@query(
    "prep_not_null",
    """SELECT event_id, t FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS t,
    CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events) WHERE t IS NOT NULL AND v IS NOT NULL""",
)
def prep_not_null(spark, folder):
    df = table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("t"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"),
    )
    return prepare.keep_not_null(df, ["t", "v"]).select("event_id", "t")


@query("prep_positive", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def prep_positive(spark, folder):
    return prepare.keep_positive(table(spark, folder, "customer"), "c_acctbal").select(
        "c_custkey", "c_acctbal"
    )


@query(
    "prep_not_in",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders WHERE year(o_orderdate) NOT IN (1997, 1998)",
)
def prep_not_in(spark, folder):
    df = table(spark, folder, "orders")
    return prepare.drop_values(df, F.year("o_orderdate"), [1997, 1998]).select(
        "o_orderkey", F.year("o_orderdate").alias("y")
    )


@query(
    "prep_make_date",
    "SELECT o_orderkey, make_date(year(o_orderdate), month(o_orderdate), 1) AS first_day FROM orders",
)
def prep_make_date(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey",
        prepare.first_of_month(F.year("o_orderdate"), F.month("o_orderdate")).alias("first_day"),
    )


@query(
    "prep_sample",
    f"""SELECT o_orderkey, o_orderstatus FROM (SELECT * FROM orders
    ORDER BY {word_sql("o_orderkey", 42)}, o_orderkey LIMIT 5000)
    WHERE year(o_orderdate) NOT IN (1997, 1998)""",
)
def prep_sample(spark, folder):
    """The sample is drawn first and filtered after, so fewer rows than asked for come out."""
    drawn = prepare.fixed_size_sample(table(spark, folder, "orders"), "o_orderkey", 5000)
    kept = prepare.drop_values(drawn, F.year("o_orderdate"), [1997, 1998])
    return kept.select("o_orderkey", "o_orderstatus")


_SENTINEL = f"""CASE WHEN {uniform_sql("o_orderkey", 42, "sentinel")} < 0.002 THEN 999
  ELSE ([30, 50, 60, 80, 120])[CAST(floor({uniform_sql("o_orderkey", 42, "pick")} * 5) AS INTEGER) + 1] END"""


@query("prep_sentinel", f"SELECT o_orderkey, {_SENTINEL} AS planted FROM orders")
def prep_sentinel(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", prepare.planted_sentinel(F.col("o_orderkey"), 42).alias("planted")
    )


_EAST = "CAST(2480000 + (c_custkey * 7919) % 360000 AS DOUBLE)"
_NORTH = "CAST(1070000 + (c_custkey * 104729) % 230000 AS DOUBLE)"


def planted_points_sql(null_rate: float = 0.005, swap_rate: float = 0.01) -> str:
    zero = f"{uniform_sql('c_custkey', 42, 'null island')} < {null_rate}"
    swap = f"{uniform_sql('c_custkey', 42, 'swapped')} < {swap_rate}"
    return f"""SELECT c_custkey,
      CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN {zero} THEN 0.0 WHEN {swap} THEN {_NORTH} ELSE {_EAST} END AS x,
      CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN {zero} THEN 0.0 WHEN {swap} THEN {_EAST} ELSE {_NORTH} END AS y
      FROM customer"""


def planted_points(spark, folder, null_rate: float = 0.005, swap_rate: float = 0.01):
    key = F.col("c_custkey")
    east = (F.lit(2480000) + (key * 7919) % 360000).cast("double")
    north = (F.lit(1070000) + (key * 104729) % 230000).cast("double")
    point = prepare.planted_point(east, north, key, 42, null_rate, swap_rate)
    return table(spark, folder, "customer").select(
        "c_custkey", F.when(key % 97 != 0, point).alias("geom")
    )


@query("prep_bad_coords", planted_points_sql(0.05, 0.1))
def prep_bad_coords(spark, folder):
    return planted_points(spark, folder, 0.05, 0.1).select("c_custkey", "geom.x", "geom.y")


@query(
    "prep_exposure",
    """SELECT CAST(unit AS BIGINT) AS unit, CAST(CASE WHEN rk = 2 THEN greatest(1, n // 4) ELSE n END AS BIGINT) AS exposure,
    CASE rk WHEN 1 THEN 'false_hotspot' WHEN 2 THEN 'true_hotspot' ELSE 'ordinary' END AS role
    FROM (SELECT c_nationkey AS unit, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS rk
          FROM customer GROUP BY 1)""",
)
def prep_exposure(spark, folder):
    out = prepare.derive_exposure(table(spark, folder, "customer"), "c_nationkey")
    return out.withColumn("unit", F.col("unit").cast("bigint"))


@query(
    "prep_safe_name",
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), '[^0-9A-Za-z_]', '_', 'g') AS name
    FROM pages""",
)
def prep_safe_name(spark, folder):
    return table(spark, folder, "pages").select("page_id", safe_name_column(F.col("url")).alias("name"))


# --- truth of a planted table ----------------------------------------------------------------------

_PLANTED_SQL = f"""(SELECT o_orderkey, o_orderstatus AS severity, o_orderpriority AS kind, {_SENTINEL} AS speed,
  make_date(year(o_orderdate), month(o_orderdate), 1) AS day,
  CASE WHEN {uniform_sql("o_orderkey", 42, "null island")} < 0.005 THEN 0.0
       WHEN {uniform_sql("o_orderkey", 42, "swapped")} < 0.01 THEN 1200000.0 ELSE 2600000.0 END AS x
  FROM orders WHERE year(o_orderdate) NOT IN (1997, 1998))"""


@query(
    "score_truth",
    f"""WITH p AS {_PLANTED_SQL},
    m AS (SELECT 'row_count' AS metric, 'equal' AS mode, CAST(count(*) AS DOUBLE) AS value FROM p
      UNION ALL SELECT 'severity_cardinality', 'equal', count(DISTINCT severity) FROM p
      UNION ALL SELECT 'sentinel_rate', 'near', count(*) FILTER (WHERE speed = 999) / count(*) FROM p
      UNION ALL SELECT 'top_share', 'min', count(*) FILTER (WHERE kind = (SELECT mode(kind) FROM p)) / count(*) FROM p
      UNION ALL SELECT 'gap_months', 'equal', max(12 * year(day) + month(day)) - min(12 * year(day) + month(day)) + 1
        - count(DISTINCT 12 * year(day) + month(day)) FROM p
      UNION ALL SELECT 'out_of_envelope_rate', 'near', count(*) FILTER (WHERE x < 2480000) / count(*) FROM p),
    t(metric, expected, tolerance) AS (VALUES ('severity_cardinality', 3.0, 0.0), ('sentinel_rate', 0.002, 0.001),
      ('top_share', 0.19, 0.0), ('gap_months', 24.0, 0.0), ('out_of_envelope_rate', 0.015, 0.01), ('row_count', -1.0, 0.0))
    SELECT metric, mode, CAST(expected AS DOUBLE) AS expected, value,
      CASE mode WHEN 'equal' THEN value = expected WHEN 'near' THEN abs(value - expected) < tolerance
        ELSE value >= expected END AS holds FROM t JOIN m USING (metric)""",
)
def score_truth(spark, folder):
    """Plant the anomalies, measure them with the profile operators, hold them against a manifest.

    The manifest's row count is wrong on purpose: one line of the report has to fail.
    """
    key = F.col("o_orderkey")
    kept = prepare.drop_values(table(spark, folder, "orders"), F.year("o_orderdate"), [1997, 1998])
    planted = kept.select(
        F.col("o_orderstatus").alias("severity"),
        F.col("o_orderpriority").alias("kind"),
        prepare.planted_sentinel(key, 42).alias("speed"),
        prepare.first_of_month(F.year("o_orderdate"), F.month("o_orderdate")).alias("day"),
        prepare.planted_point(F.lit(2600000.0), F.lit(1200000.0), key, 42).alias("geom"),
    )
    freq = value_frequencies(planted, ["severity", "kind", "speed"])
    outside = out_of_envelope(point_geometry(F.col("geom")))
    shares = top_values(freq, k=1).filter(F.col("column") == "kind")
    measured = [
        planted.agg(F.lit("row_count").alias("metric"), F.count(F.lit(1)).cast("double").alias("value")),
        planted.agg(
            F.lit("out_of_envelope_rate").alias("metric"),
            (F.count_if(outside) / F.count(F.lit(1))).alias("value"),
        ),
        freq.filter(F.col("column") == "severity").agg(
            F.lit("severity_cardinality").alias("metric"), F.count("key").cast("double").alias("value")
        ),
        freq.filter(F.col("column") == "speed").agg(
            F.lit("sentinel_rate").alias("metric"),
            (F.sum(F.when(F.col("key") == "999", F.col("freq")).otherwise(0)) / F.sum("freq")).alias("value"),
        ),
        shares.select(F.lit("top_share").alias("metric"), F.col("share").alias("value")),
        temporal.bounds_and_gaps(temporal.month_counts(planted, ["day"])).select(
            F.lit("gap_months").alias("metric"), F.col("gap_months").cast("double").alias("value")
        ),
    ]
    rows = measured[0]
    for part in measured[1:]:
        rows = rows.unionByName(part)
    manifest = inline_rows(
        spark,
        "metric string, expected double, tolerance double, mode string",
        [
            ("severity_cardinality", 3.0, 0.0, "equal"), ("sentinel_rate", 0.002, 0.001, "near"),
            ("top_share", 0.19, 0.0, "min"), ("gap_months", 24.0, 0.0, "equal"),
            ("out_of_envelope_rate", 0.015, 0.01, "near"), ("row_count", -1.0, 0.0, "equal"),
        ],
    )
    return scoring.check_truth(rows, manifest)


# --- spatial profiles ------------------------------------------------------------------------------

_OUT = "((x = 0 AND y = 0) OR x NOT BETWEEN 2480000 AND 2840000 OR y NOT BETWEEN 1070000 AND 1300000)"


def _spatial_sql(points: str) -> str:
    return f"""SELECT count(*) AS n, count(*) FILTER (WHERE x IS NULL) / count(*) AS null_rate,
      0.0::DOUBLE AS empty_rate, 0.0::DOUBLE AS invalid_rate, 0.0::DOUBLE AS has_z_rate,
      count(*) FILTER (WHERE {_OUT}) / count(*) AS out_of_envelope_rate,
      min(x) FILTER (WHERE NOT {_OUT}) AS min_x, max(x) FILTER (WHERE NOT {_OUT}) AS max_x,
      min(y) FILTER (WHERE NOT {_OUT}) AS min_y, max(y) FILTER (WHERE NOT {_OUT}) AS max_y,
      0.0::DOUBLE AS max_length, 0.0::DOUBLE AS max_area FROM ({points})"""


@query("spa_profile", _spatial_sql(planted_points_sql()))
def spa_profile(spark, folder):
    points = planted_points(spark, folder).select(point_geometry(F.col("geom")).alias("g"))
    return spatial_profile(points, "g", "geom", 2056).drop("column", "srid_declared", "geometry_types")


@query("spa_wkb", _spatial_sql(planted_points_sql()))
def spa_wkb(spark, folder):
    """The same measures after a trip through well-known binary."""
    coded = planted_points(spark, folder).select(point_wkb("geom.x", "geom.y").alias("wkb"))
    shapes = coded.select(decode_wkb("wkb").alias("d")).select(geometry(F.col("d")).alias("g"))
    return spatial_profile(shapes, "g", "geom", 2056).drop("column", "srid_declared", "geometry_types")


@query(
    "spa_rates",
    f"""SELECT count(*) FILTER (WHERE x IS NULL) / count(*) AS null_rate,
    count(*) FILTER (WHERE {_OUT}) / count(*) AS out_of_envelope_rate FROM ({planted_points_sql(0.05, 0.1)})""",
)
def spa_rates(spark, folder):
    g = point_geometry(F.col("geom"))
    n = F.count(F.lit(1))
    return planted_points(spark, folder, 0.05, 0.1).agg(
        (F.count_if(F.col("geom").isNull()) / n).alias("null_rate"),
        (F.count_if(out_of_envelope(g)) / n).alias("out_of_envelope_rate"),
    )


def _shapes(spark, folder):
    """A line or a rectangle per customer, in well-known binary; every 11th ring is left open."""
    k = F.col("c_custkey")
    x, y = (F.lit(2600000) + k).cast("double"), (F.lit(1200000) + k).cast("double")
    w, h = (k % 7 + 1).cast("double"), (k % 5 + 1).cast("double")

    def at(a, b):
        return prepare.point(a, b)

    corners = F.array(at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h))
    ring = F.when(k % 11 == 0, corners).otherwise(F.array_append(corners, at(x, y)))
    line = F.array(at(x, y), at(x + w, y), at(x + w, y + h))
    closed = k % 2 == 0
    return spread(table(spark, folder, "customer").select("c_custkey"), "c_custkey").select(
        polyline_wkb(F.when(closed, ring).otherwise(line), closed).alias("wkb")
    )


@query(
    "spa_size",
    """SELECT type, count(*) AS n, count(*) FILTER (WHERE bad) AS invalids, max(len) AS max_length, max(area) AS max_area
    FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'POLYGON' ELSE 'LINESTRING' END AS type,
      c_custkey % 2 = 0 AND c_custkey % 11 = 0 AS bad,
      CASE WHEN c_custkey % 2 = 0 THEN 0.0 ELSE CAST(c_custkey % 7 + 1 + c_custkey % 5 + 1 AS DOUBLE) END AS len,
      CASE WHEN c_custkey % 2 = 1 THEN 0.0 WHEN c_custkey % 11 = 0 THEN (c_custkey % 7 + 1) * (c_custkey % 5 + 1) / 1.0
        ELSE (c_custkey % 7 + 1) * (c_custkey % 5 + 1) / 1.0 END AS area FROM customer) GROUP BY 1""",
)
def spa_size(spark, folder):
    shapes = _shapes(spark, folder).select(decode_wkb("wkb").alias("d")).select(geometry(F.col("d")).alias("g"))
    return measures_by_type(shapes, "g").select("type", "n", "invalids", "max_length", "max_area")


@query("spa_types", "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'POLYGON' ELSE 'LINESTRING' END AS type, count(*) AS n FROM customer GROUP BY 1")
def spa_types(spark, folder):
    shapes = _shapes(spark, folder).select(decode_wkb("wkb").alias("d")).select(geometry(F.col("d")).alias("g"))
    return geometry_types(measures_by_type(shapes, "g"))


# --- validity of polygons --------------------------------------------------------------------------


def _box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


_SHELL = _box(0, 0, 10, 10)
# Planted shapes: polygons as lists of rings, whether they are valid, and their area.
_PLANTED = {
    "hole inside": ([[_SHELL, _box(2, 2, 4, 4)]], True, 96),
    "hole outside": ([[_SHELL, _box(12, 2, 14, 4)]], False, 96),
    "hole meets shell once": ([[_SHELL, [(0, 0), (4, 2), (2, 4), (0, 0)]]], True, 94),
    "hole cuts shell in two": ([[_SHELL, [(0, 5), (5, 3), (10, 5), (5, 7), (0, 5)]]], False, 80),
    "hole along a side": ([[_SHELL, _box(0, 2, 4, 4)]], False, 92),
    "hole in a hole": ([[_SHELL, _box(1, 1, 9, 9), _box(2, 2, 4, 4)]], False, 32),
    "holes meet once": ([[_SHELL, _box(2, 2, 4, 4), _box(4, 4, 6, 6)]], True, 92),
    "holes meet in a circle": (
        [[_SHELL, [(2, 2), (5, 1), (8, 2), (2, 2)], [(2, 2), (5, 8), (2, 6), (2, 2)], [(8, 2), (8, 6), (5, 8), (8, 2)]]], False, 85,
    ),
    "polygons meet once": ([[_SHELL], [_box(10, 10, 12, 12)]], True, 104),
    "polygons share a side": ([[_SHELL], [_box(10, 2, 12, 4)]], False, 104),
    "polygon in a polygon": ([[_SHELL], [_box(2, 2, 4, 4)]], False, 104),
    "polygon in a hole": ([[_SHELL, _box(1, 1, 9, 9)], [_box(2, 2, 4, 4)]], True, 40),
    "spike": ([[[(0, 0), (10, 0), (10, 10), (10, 14), (10, 10), (0, 10), (0, 0)]]], False, 100),
    "corner on an own side": ([[[(0, 0), (10, 0), (10, 10), (5, 0), (0, 10), (0, 0)]]], False, 50),
    "nothing": ([], True, 0),
}
_SIZE = "(c_custkey % 3 + 1)"


@query(
    "spa_quality",
    f"""SELECT shape, count(*) AS n, count(*) FILTER (WHERE NOT valid) AS invalids, count(*) FILTER (WHERE shape = 'nothing') AS empties,
      max(CAST(area * {_SIZE} * {_SIZE} AS DOUBLE)) AS max_area FROM customer JOIN (VALUES """
    + ", ".join(f"({i}, '{name}', {valid}, {area})" for i, (name, (_, valid, area)) in enumerate(_PLANTED.items()))
    + f") AS planted(i, shape, valid, area) ON c_custkey % {len(_PLANTED)} = i GROUP BY 1",
)
def spa_quality(spark, folder):
    """A planted polygon or multipolygon per customer, through well-known binary, judged by the plane sweep."""
    k = F.col("c_custkey")
    kind = (k % len(_PLANTED) + 1).cast("int")
    all_shapes = F.from_json(F.lit(json.dumps([shape for shape, _, _ in _PLANTED.values()])), "array<array<array<array<array<double>>>>>")
    size = (k % 3 + 1).cast("double")

    def place(at):
        return prepare.point(2600000 + k + at[0] * size, 1200000 + k + at[1] * size)

    placed = F.transform(F.element_at(all_shapes, kind), lambda rings: F.transform(rings, lambda ring: F.transform(ring, place)))
    names = F.array(*map(F.lit, _PLANTED))
    coded = spread(table(spark, folder, "customer").select("c_custkey"), "c_custkey").select(F.element_at(names, kind).alias("shape"), polygons_wkb(placed).alias("wkb"))
    judged = coded.select("shape", decode_wkb("wkb").alias("d")).select("shape", geometry(F.col("d")).alias("g"))
    return judged.groupBy("shape").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("g.is_valid")).alias("invalids"),
        F.count_if(F.col("g.is_empty")).alias("empties"),
        F.max("g.area").alias("max_area"),
    )


# A ring of 4 to 7 corners per order; sides meet if they share a place other than the corner between neighbours.
_RINGS = """WITH place AS (SELECT o_orderkey AS o, o_custkey AS c, 4 + o_orderkey % 4 AS n, unnest(range(0, 4 + o_orderkey % 4)) AS i FROM orders),
  corner AS (SELECT o, i, n, (o * (2 * i + 3) + c * i) % 17 * 2 + CASE WHEN i = 0 THEN 1 ELSE 0 END AS x,
    (c * (i + 1) + o * i * i) % 17 * 2 + i % 2 AS y FROM place),
  side AS (SELECT a.o, a.n, a.i, a.x, a.y, b.x AS u, b.y AS v FROM corner a JOIN corner b ON a.o = b.o AND b.i = (a.i + 1) % a.n),
  pair AS (SELECT s.o, s.n, s.i, t.i AS j, s.x AS ax, s.y AS ay, s.u AS bx, s.v AS by_, t.x AS cx, t.y AS cy, t.u AS dx, t.v AS dy,
    sign((s.u - s.x) * (t.y - s.y) - (s.v - s.y) * (t.x - s.x)) AS abc, sign((s.u - s.x) * (t.v - s.y) - (s.v - s.y) * (t.u - s.x)) AS abd,
    sign((t.u - t.x) * (s.y - t.y) - (t.v - t.y) * (s.x - t.x)) AS cda, sign((t.u - t.x) * (s.v - t.y) - (t.v - t.y) * (s.u - t.x)) AS cdb
    FROM side s JOIN side t ON s.o = t.o AND s.i < t.i),
  met AS (SELECT o, CASE
      WHEN j = i + 1 THEN abd = 0 AND (ax - bx) * (dx - bx) + (ay - by_) * (dy - by_) > 0
      WHEN i = 0 AND j = n - 1 THEN abc = 0 AND (bx - ax) * (cx - ax) + (by_ - ay) * (cy - ay) > 0
      ELSE abc * abd < 0 AND cda * cdb < 0
        OR abc = 0 AND cx BETWEEN least(ax, bx) AND greatest(ax, bx) AND cy BETWEEN least(ay, by_) AND greatest(ay, by_)
        OR abd = 0 AND dx BETWEEN least(ax, bx) AND greatest(ax, bx) AND dy BETWEEN least(ay, by_) AND greatest(ay, by_)
        OR cda = 0 AND ax BETWEEN least(cx, dx) AND greatest(cx, dx) AND ay BETWEEN least(cy, dy) AND greatest(cy, dy)
        OR cdb = 0 AND bx BETWEEN least(cx, dx) AND greatest(cx, dx) AND by_ BETWEEN least(cy, dy) AND greatest(cy, dy) END AS meets FROM pair),
  ring AS (SELECT c.o, c.n AS corners, c.n >= 3 AND NOT coalesce(m.any_meets, false) AS valid
    FROM (SELECT DISTINCT o, n FROM corner) c LEFT JOIN (SELECT o, bool_or(meets) AS any_meets FROM met GROUP BY 1) m USING (o))
  SELECT corners, count(*) AS n, count(*) FILTER (WHERE valid) AS valids FROM ring GROUP BY 1"""


@query("spa_rings", _RINGS)
def spa_rings(spark, folder):
    """A ring per order from its keys, judged by the plane sweep; the SQL tests every pair of its sides."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")

    def corner(i):
        x = (o * (2 * i + 3) + c * i) % 17 * 2 + F.when(i == 0, 1).otherwise(0)
        y = (c * (i + 1) + o * i * i) % 17 * 2 + i % 2
        return prepare.point(x.cast("double"), y.cast("double"))

    corners = (4 + o % 4).cast("long")
    run = F.transform(F.sequence(F.lit(0).cast("long"), corners - 1), corner)
    coded = (
        spread(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
        .select(corners.alias("corners"), run.alias("run"))
        .select("corners", polygons_wkb(F.array(F.array(F.array_append("run", F.element_at("run", 1))))).alias("wkb"))
    )
    judged = coded.select("corners", decode_wkb("wkb").alias("d")).select("corners", geometry(F.col("d")).alias("g"))
    return judged.groupBy("corners").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("g.is_valid")).alias("valids"))
