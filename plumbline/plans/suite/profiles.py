"""Column profiles: categorical, numeric, temporal, inferred kinds, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import frequency, infer, numeric, quantiles, temporal
from plumbline.functions.wkb import point_wkb
from plumbline.plans.profile import profile_declared, profile_raw
from plumbline.plans.suite import query, table
from plumbline.sources.catalog import catalog_from_entries
from plumbline.sources.tables import schema_of

# Columns of the given tables by type, for the SQL side.
TABLES = {
    "region": "r_regionkey:n r_name:t",
    "nation": "n_nationkey:n n_name:t n_regionkey:n",
    "customer": "c_custkey:n c_name:t c_nationkey:n c_acctbal:n c_mktsegment:t",
    "supplier": "s_suppkey:n s_name:t s_nationkey:n s_acctbal:n",
    "part": "p_partkey:n p_name:t p_brand:t p_type:t p_size:n p_retailprice:n",
    "orders": "o_orderkey:n o_custkey:n o_orderstatus:t o_totalprice:n o_orderdate:d o_orderpriority:t",
    "lineitem": "l_orderkey:n l_partkey:n l_suppkey:n l_linenumber:n l_quantity:n l_extendedprice:n"
    " l_discount:n l_tax:n l_returnflag:t l_linestatus:t l_shipdate:d",
    "events": "event_id:n ts:d user_id:n event_type:t value:n props:t",
    "documents": "doc_id:n text:t lang:t source:t n_chars:n",
    "embeddings": "vec_id:n embedding:t label:n",
    "pages": "page_id:n url:t html:t",
    "benchmark": "item_id:n text:t",
    "labels": "doc_id:n quality:n toxic:n",
    "conversations": "conv_id:n turn:n role:t text:t",
}


def columns_of(name: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in TABLES[name].split()]


def _key(col: str) -> str:
    text = f"CAST({col} AS VARCHAR)"
    return f"CASE WHEN length({text}) <= 64 THEN {text} ELSE sha256({text}) END"


def cat_sql(src: str, col: str) -> str:
    return f"""SELECT '{col}' AS "column", n, cardinality,
      cardinality / n AS uniqueness, round(entropy, 6) AS entropy FROM (
      SELECT CAST(sum(f) AS BIGINT) AS n, count(v) AS cardinality,
        greatest(0.0, -sum(f / t * log2(f / t))) AS entropy
      FROM (SELECT {col} AS v, count(*) AS f, sum(count(*)) OVER () AS t FROM {src} GROUP BY {col}))"""


def topk_sql(src: str, col: str, k: int = 15) -> str:
    return f"""SELECT '{col}' AS "column", rank, value, freq, share FROM (
      SELECT CAST(row_number() OVER (ORDER BY freq DESC, ky NULLS LAST) AS INTEGER) AS rank, value, freq,
        freq / sum(freq) OVER () AS share
      FROM (SELECT {_key(col)} AS ky, min(CAST({col} AS VARCHAR)) AS value, count(*) AS freq
            FROM {src} GROUP BY ky)) WHERE rank <= {k}"""


def num_sql(src: str, col: str) -> str:
    return f"""SELECT '{col}' AS "column", s.n, s.mn AS "min", s.mx AS "max", round(s.av, 6) AS mean,
      s.md AS median, s.p5, s.p25, s.p75, s.p95, round(coalesce(s.sd, 0), 6) AS std,
      round(coalesce(s.sk, 0), 6) + 0.0 AS skewness, (s.n - s.nn) / s.n AS null_rate,
      s.zr / s.n AS zero_rate,
      (SELECT count(*) FROM {src} WHERE s.sd > 0 AND abs({col} - s.av) > 3 * s.sd) AS n_outliers_3sigma
      FROM (SELECT count(*) AS n, count({col}) AS nn, CAST(min({col}) AS DOUBLE) AS mn,
        CAST(max({col}) AS DOUBLE) AS mx, avg({col}) AS av, round(CAST(median({col}) AS DOUBLE), 6) AS md,
        round(CAST(quantile_cont({col}, 0.05) AS DOUBLE), 6) AS p5, round(CAST(quantile_cont({col}, 0.25) AS DOUBLE), 6) AS p25,
        round(CAST(quantile_cont({col}, 0.75) AS DOUBLE), 6) AS p75, round(CAST(quantile_cont({col}, 0.95) AS DOUBLE), 6) AS p95,
        stddev_samp({col}) AS sd, count(*) FILTER (WHERE {col} = 0) AS zr, skewness({col}) AS sk
      FROM {src}) s"""


def gaps_sql(src: str, col: str) -> str:
    """Months from the first to the last, less those that occur."""
    number = f"(12 * year({col}) + month({col}))"
    return f"(SELECT coalesce(max{number} - min{number} + 1, 0) - count(DISTINCT {number}) FROM {src})"


def _cells(rows: list[tuple[str, str, str, str]], col: str, kind: str, source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{col}' AS "column", '{kind}' AS kind, '{m}' AS metric, {item} AS item,
          {value} AS value, {text} AS text FROM {source}"""
        for m, item, value, text in rows
    )


def long_sql(src: str, col: str, kind: str) -> str:
    """All long profile rows of one column."""
    none_t, none_d = "CAST(NULL AS VARCHAR)", "CAST(NULL AS DOUBLE)"
    if kind == "categorical":
        parts = [
            _cells(
                [(m, none_t, f"CAST({m} AS DOUBLE)", none_t) for m in ("n", "cardinality", "uniqueness", "entropy")],
                col, kind, f"({cat_sql(src, col)})",
            ),
            _cells([("top_k", "value", "share", none_t)], col, kind, f"({topk_sql(src, col)})"),
        ]
    elif kind == "numeric":
        names = ("n min max mean median p5 p25 p75 p95 std skewness null_rate zero_rate n_outliers_3sigma").split()
        parts = [
            _cells([(m, none_t, f'CAST("{m}" AS DOUBLE)', none_t) for m in names], col, kind, f"({num_sql(src, col)})")
        ]
    else:
        parts = [
            _cells(
                [
                    ("n", none_t, "CAST(count(*) AS DOUBLE)", none_t),
                    ("null_rate", none_t, f"(count(*) - count({col})) / count(*)", none_t),
                    ("min", none_t, none_d, f"CAST(min({col}) AS VARCHAR)"),
                    ("max", none_t, none_d, f"CAST(max({col}) AS VARCHAR)"),
                ],
                col, kind, src,
            ),
            _cells([("gap_months", none_t, "CAST(g AS DOUBLE)", none_t)], col, kind, f"(SELECT {gaps_sql(src, col)} AS g)"),
        ]
        for metric, part in (("seasonality_by_month", "month"), ("volume_by_year", "year")):
            parts.append(
                _cells(
                    [(metric, "CAST(k AS VARCHAR)", "CAST(f AS DOUBLE)", none_t)], col, kind,
                    f"(SELECT {part}({col}) AS k, count(*) AS f FROM {src} WHERE {col} IS NOT NULL GROUP BY 1)",
                )
            )
    return " UNION ALL ".join(parts)


def _union(parts) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


def _rounded_long(df: DataFrame) -> DataFrame:
    shown = F.when(
        F.col("metric").isin("entropy", *_ROUNDED), F.round("value", 6) + 0.0
    ).otherwise(F.col("value"))
    return df.withColumn("value", shown)


# Sums and interpolations differ in their last digit with the order of the additions.
_ROUNDED = ("mean", "std", "skewness", "median", "p5", "p25", "p75", "p95", "quantile")


def _rounded_numeric(df: DataFrame) -> DataFrame:
    # Adding zero turns -0.0 into 0.0.
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in df.columns if c in _ROUNDED})


# --- categorical ---------------------------------------------------------------------------------

_NULLABLE = "(SELECT CASE WHEN event_type <> 'error' THEN event_type END AS kind, user_id FROM events)"


def _nullable(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"), "user_id"
    )


@query("cat_profile", _union(cat_sql("lineitem", c) for c in ("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey", "l_shipdate")))
def cat_profile(spark, folder):
    df = table(spark, folder, "lineitem")
    out = frequency.categorical_profile(
        df, ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey", "l_shipdate"]
    )
    return out.withColumn("entropy", F.round("entropy", 6))


@query("cat_profile_nulls", _union(cat_sql(_NULLABLE, c) for c in ("kind", "user_id")))
def cat_profile_nulls(spark, folder):
    out = frequency.categorical_profile(_nullable(spark, folder), ["kind", "user_id"])
    return out.withColumn("entropy", F.round("entropy", 6))


@query("cat_topk", _union([topk_sql(_NULLABLE, "kind"), topk_sql(_NULLABLE, "user_id")]))
def cat_topk(spark, folder):
    return frequency.top_values(
        frequency.value_frequencies(_nullable(spark, folder), ["kind", "user_id"])
    )


@query("cat_topk_text", _union([topk_sql("documents", "text"), topk_sql("documents", "source")]))
def cat_topk_text(spark, folder):
    df = table(spark, folder, "documents")
    freq = frequency.value_frequencies(df, ["text", "source"], ["text"])
    return frequency.top_values(freq, source=df, wide_columns=["text"])


@query("cat_entropy", """SELECT "column", entropy FROM (""" + _union(cat_sql("orders", c) for c in ("o_orderpriority", "o_orderstatus", "o_custkey")) + ")")
def cat_entropy(spark, folder):
    df = table(spark, folder, "orders")
    freq = frequency.value_frequencies(df, ["o_orderpriority", "o_orderstatus", "o_custkey"])
    return frequency.cardinality_entropy(freq).select("column", F.round("entropy", 6).alias("entropy"))


@query("cat_uniqueness", """SELECT "column", n, cardinality, uniqueness FROM (""" + _union(cat_sql("customer", c) for c in ("c_name", "c_mktsegment", "c_nationkey")) + ")")
def cat_uniqueness(spark, folder):
    df = table(spark, folder, "customer")
    freq = frequency.value_frequencies(df, ["c_name", "c_mktsegment", "c_nationkey"])
    return frequency.cardinality_entropy(freq).select("column", "n", "cardinality", "uniqueness")


# --- numeric -------------------------------------------------------------------------------------

_LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("num_profile", _union(num_sql("lineitem", c) for c in _LINE_NUMBERS))
def num_profile(spark, folder):
    return _rounded_numeric(numeric.numeric_profile(table(spark, folder, "lineitem"), _LINE_NUMBERS))


_SPARSE = "(SELECT CASE WHEN event_type <> 'click' THEN value END AS v, CASE WHEN event_type = 'view' THEN 0 ELSE value - 20 END AS w FROM events)"


@query("num_profile_nulls", _union(num_sql(_SPARSE, c) for c in ("v", "w")))
def num_profile_nulls(spark, folder):
    df = table(spark, folder, "events").select(
        F.when(F.col("event_type") != "click", F.col("value")).alias("v"),
        F.when(F.col("event_type") == "view", 0.0).otherwise(F.col("value") - 20).alias("w"),
    )
    return _rounded_numeric(numeric.numeric_profile(df, ["v", "w"]))


def _quantile_sql(src: str, cols) -> str:
    return _union(
        f"""SELECT '{c}' AS "column", CAST({p} AS DOUBLE) AS prob, round(CAST(quantile_cont({c}, {p}) AS DOUBLE), 6) AS quantile FROM {src}"""
        for c in cols
        for p in quantiles.PROFILE_PROBS
    )


@query("num_quantiles", _quantile_sql("orders", ["o_totalprice", "o_custkey"]))
def num_quantiles(spark, folder):
    return _rounded_numeric(
        quantiles.exact_quantiles(table(spark, folder, "orders"), ["o_totalprice", "o_custkey"])
    )


@query("num_quantiles_slots", _quantile_sql("lineitem", ["l_extendedprice", "l_quantity", "l_partkey"]))
def num_quantiles_slots(spark, folder):
    """The narrowing path that large inputs take, whatever the size of this one."""
    df = table(spark, folder, "lineitem")
    return _rounded_numeric(
        quantiles.exact_quantiles(df, ["l_extendedprice", "l_quantity", "l_partkey"], map_rows=0)
    )


@query(
    "num_moments",
    _union(
        f"""SELECT '{c}' AS "column", min({c}) AS "min", max({c}) AS "max", round(avg({c}), 6) AS mean,
        round(stddev_samp({c}), 6) AS std, round(skewness({c}), 6) + 0.0 AS skewness FROM part"""
        for c in ("p_retailprice", "p_size")
    ),
)
def num_moments(spark, folder):
    df = table(spark, folder, "part")
    return _rounded_numeric(
        numeric.numeric_moments(df, ["p_retailprice", "p_size"]).select(
            "column", "min", "max", "mean", "std", "skewness"
        )
    )


@query("num_outliers", _union(f"""SELECT '{c}' AS "column", (SELECT count(*) FROM events WHERE abs({c} - m.a) > 3 * m.s) AS outliers
    FROM (SELECT avg({c}) AS a, stddev_samp({c}) AS s FROM events) m""" for c in ("value", "user_id")))
def num_outliers(spark, folder):
    df = table(spark, folder, "events")
    moments = numeric.numeric_moments(df, ["value", "user_id"]).collect()
    return numeric.outliers_3sigma(df, moments)


@query("num_rates", _union(f"""SELECT '{c}' AS "column", count(*) AS n, (count(*) - count({c})) / count(*) AS null_rate,
    count(*) FILTER (WHERE {c} = 0) / count(*) AS zero_rate FROM {_SPARSE}""" for c in ("v", "w")))
def num_rates(spark, folder):
    df = table(spark, folder, "events").select(
        F.when(F.col("event_type") != "click", F.col("value")).alias("v"),
        F.when(F.col("event_type") == "view", 0.0).otherwise(F.col("value") - 20).alias("w"),
    )
    return numeric.numeric_rates(df, ["v", "w"])


# --- temporal ------------------------------------------------------------------------------------

_GAPPED = "(SELECT CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END AS d FROM orders WHERE year(o_orderdate) NOT IN (1997, 1998))"


def _gapped(spark, folder):
    df = table(spark, folder, "orders")
    kept = df.filter(~F.year("o_orderdate").isin(1997, 1998))
    return kept.select(F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate")).alias("d"))


@query(
    "tmp_bounds",
    _union(
        f"""SELECT '{c}' AS "column", count(*) AS n, (count(*) - count({c})) / count(*) AS null_rate,
        CAST(min({c}) AS VARCHAR) AS "min", CAST(max({c}) AS VARCHAR) AS "max", {gaps_sql(s, c)} AS gap_months FROM {s}"""
        for s, c in ((_GAPPED, "d"),)
    ),
)
def tmp_bounds(spark, folder):
    return temporal.bounds_and_gaps(temporal.month_counts(_gapped(spark, folder), ["d"]))


@query(
    "tmp_missing_months",
    f"""WITH seen AS (SELECT DISTINCT 12 * year(d) + month(d) - 1 AS k FROM {_GAPPED} WHERE d IS NOT NULL),
    steps AS (SELECT k, lead(k) OVER (ORDER BY k) AS next FROM seen),
    gaps AS (SELECT unnest(range(k + 1, next)) AS k FROM steps WHERE next > k + 1)
    SELECT 'd' AS "column", make_date(k // 12, k % 12 + 1, 1) AS month FROM gaps""",
)
def tmp_missing_months(spark, folder):
    return temporal.missing_months(temporal.month_counts(_gapped(spark, folder), ["d"]))


@query("tmp_seasonality", f"""SELECT 'd' AS "column", CAST(month(d) AS INTEGER) AS month, count(*) AS freq FROM {_GAPPED} WHERE d IS NOT NULL GROUP BY 2""")
def tmp_seasonality(spark, folder):
    return temporal.seasonality(temporal.month_counts(_gapped(spark, folder), ["d"]))


@query("tmp_volume", """SELECT 'l_shipdate' AS "column", CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS freq FROM lineitem GROUP BY 2""")
def tmp_volume(spark, folder):
    return temporal.volume_by_year(
        temporal.month_counts(table(spark, folder, "lineitem"), ["l_shipdate"])
    )


# --- inference and whole tables ------------------------------------------------------------------

def _infer_sql(name: str) -> str:
    parts = []
    for i, (c, k) in enumerate(columns_of(name)):
        kind = {
            "t": "'categorical'",
            "d": "'temporal'",
            "n": f"CASE WHEN count(DISTINCT {c}) <= 25 THEN 'categorical' ELSE 'numeric' END",
        }[k]
        parts.append(f"""SELECT '{name}' AS "table", {i} AS ordinal, '{c}' AS "column", {kind} AS kind FROM {name} GROUP BY ALL""")
    return _union(p.replace(" GROUP BY ALL", "") if "count(" in p else p.replace(f" FROM {name} GROUP BY ALL", "") for p in parts)


@query("infer_kinds", _union(_infer_sql(t) for t in TABLES))
def infer_kinds(spark, folder):
    out = None
    for name in TABLES:
        part = infer.infer_kinds(table(spark, folder, name)).withColumn("table", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "schema_types",
    _union(f"""SELECT '{t}' AS "table", count(*) AS n_columns FROM (VALUES {", ".join("(" + str(i) + ")" for i in range(len(columns_of(t))))})""" for t in TABLES),
)
def schema_types(spark, folder):
    out = None
    for name in TABLES:
        part = schema_of(table(spark, folder, name)).withColumn("table", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("table").agg(F.count(F.lit(1)).alias("n_columns"))


def _raw_sql(name: str, kinds: str) -> str:
    cols = [c for c, _ in columns_of(name)]
    full = {"c": "categorical", "n": "numeric", "t": "temporal"}
    return "SELECT *, true AS type_inferred FROM (" + _union(
        long_sql(name, c, full[k]) for c, k in zip(cols, kinds)
    ) + ")"


def _raw(name: str, kinds: str) -> None:
    @query(f"profile_raw_{name}", _raw_sql(name, kinds))
    def run(spark, folder):
        return _rounded_long(profile_raw(table(spark, folder, name)))


# Kinds by column: n numeric, c categorical, t temporal.
_raw("orders", "nncntc")
_raw("customer", "nccnc")
_raw("part", "ncccnn")
_raw("documents", "ncccn")
_raw("conversations", "nccc")
_raw("lineitem", "nnncnncccct")

# A point per order in well-known binary: of 20, one missing, one empty, one with a height, one with no finite place.
_POINTS = """SELECT o_orderkey, o_orderstatus,
  CASE o_orderkey % 20 WHEN 0 THEN 'null' WHEN 1 THEN 'empty' WHEN 2 THEN 'height' WHEN 3 THEN 'endless' ELSE 'plain' END AS form,
  CAST(2400000 + o_custkey % 1000 * 500 AS DOUBLE) AS x, CAST(1060000 + o_orderkey % 2000 * 125 AS DOUBLE) AS y FROM orders"""


def order_points(spark, folder) -> DataFrame:
    orders = table(spark, folder, "orders")
    m = F.col("o_orderkey") % 20
    x = F.when(m == 3, float("inf")).otherwise((2400000 + F.col("o_custkey") % 1000 * 500).cast("double"))
    plain = point_wkb(x, (1060000 + F.col("o_orderkey") % 2000 * 125).cast("double"))
    nothing = F.unhex(F.lit("0101000000" + 2 * "000000000000F87F"))
    height = F.concat(F.unhex(F.lit("01E9030000")), F.substring(plain, 6, 16), F.substring(plain, 14, 8))
    geom = F.when(m == 0, F.lit(None)).when(m == 1, nothing).when(m == 2, height).otherwise(plain)
    return orders.select("o_orderkey", "o_orderstatus", geom.alias("geom"))


def spatial_long_sql(srid: int | None) -> str:
    """Long profile rows of the points of `_POINTS`."""
    placed = "form IN ('height', 'plain')"
    inside = f"{placed} AND x BETWEEN 2480000 AND 2840000 AND y BETWEEN 1070000 AND 1300000"
    none = "CAST(NULL AS VARCHAR)"
    measures = {
        "n": "CAST(count(*) AS DOUBLE)",
        "srid_declared": f"max(CAST({srid or 'NULL'} AS DOUBLE))",
        "null_rate": "count(*) FILTER (WHERE form = 'null') / count(*)",
        "empty_rate": "count(*) FILTER (WHERE form = 'empty') / count(*)",
        "invalid_rate": "count(*) FILTER (WHERE form = 'endless') / count(*)",
        "has_z_rate": "count(*) FILTER (WHERE form = 'height') / count(*)",
        "out_of_envelope_rate": f"count(*) FILTER (WHERE form = 'endless' OR {placed} AND NOT ({inside})) / count(*)",
        "min_x": f"min(x) FILTER (WHERE {inside})", "max_x": f"max(x) FILTER (WHERE {inside})",
        "min_y": f"min(y) FILTER (WHERE {inside})", "max_y": f"max(y) FILTER (WHERE {inside})",
        "max_length": "max(CAST(0 AS DOUBLE))", "max_area": "max(CAST(0 AS DOUBLE))",
    }
    rows = [(m, none, sql, none) for m, sql in measures.items()]
    rows.append(("geometry_types", "'POINT'", "CAST(count(*) FILTER (WHERE form <> 'null') AS DOUBLE)", none))
    return _cells(rows, "geom", "spatial", f"({_POINTS})")


@query(
    "profile_raw_points",
    "SELECT *, true AS type_inferred FROM ("
    + _union([long_sql(f"({_POINTS})", "o_orderkey", "numeric"), long_sql(f"({_POINTS})", "o_orderstatus", "categorical"), spatial_long_sql(None)]) + ")",
)
def profile_raw_points(spark, folder):
    """A binary column of points is found to be geometry by its values, and profiled as such."""
    return _rounded_long(profile_raw(order_points(spark, folder)))


@query("profile_declared_spatial", _union([long_sql("orders", "o_orderstatus", "categorical"), spatial_long_sql(2056)]))
def profile_declared_spatial(spark, folder):
    entry = """{"dataset": "placed", "columns": {"o_orderstatus": {"type": "categorical"}, "geom": {"type": "spatial", "srid": 2056}}}"""
    return _rounded_long(profile_declared(order_points(spark, folder), catalog_from_entries(spark, [entry]), "placed"))


_ENTRY = """{"dataset": "orders", "columns": {
  "o_orderstatus": {"type": "categorical"}, "o_orderpriority": {}, "o_totalprice": {"type": "numeric"},
  "o_orderdate": {"type": "temporal"}}}"""


@query(
    "profile_declared",
    _union(
        long_sql("orders", c, k)
        for c, k in (
            ("o_orderstatus", "categorical"), ("o_orderpriority", "categorical"),
            ("o_totalprice", "numeric"), ("o_orderdate", "temporal"),
        )
    ),
)
def declared(spark, folder):
    catalog = catalog_from_entries(spark, [_ENTRY])
    return _rounded_long(profile_declared(table(spark, folder, "orders"), catalog, "orders"))
