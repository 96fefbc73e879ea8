"""Whole-table profiles: declared by the catalog or inferred from the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.wkb import decode_wkb, geometry, point_geometry
from plumbline.operators.frequency import (
    KEY_LENGTH,
    cardinality_entropy,
    top_values,
    value_frequencies,
)
from plumbline.operators.infer import inferred, is_spatial
from plumbline.operators.numeric import numeric_profile
from plumbline.operators.spatial import spatial_profile
from plumbline.operators.temporal import (
    bounds_and_gaps,
    month_counts,
    seasonality,
    volume_by_year,
)
from plumbline.sources.catalog import Catalog
from plumbline.sources.geoparquet import geometry_columns
from plumbline.sources.tables import guarded_path, safe_name, scan

KINDS = ("categorical", "numeric", "temporal", "spatial")


def _long(df: DataFrame, kind: str, numbers: Sequence[str], texts: Sequence[str] = ()) -> DataFrame:
    rows = [
        F.struct(
            F.lit(m).alias("metric"),
            F.lit(None).cast("string").alias("item"),
            F.col(m).cast("double").alias("value"),
            F.lit(None).cast("string").alias("text"),
        )
        for m in numbers
    ] + [
        F.struct(
            F.lit(m).alias("metric"),
            F.lit(None).cast("string").alias("item"),
            F.lit(None).cast("double").alias("value"),
            F.col(m).cast("string").alias("text"),
        )
        for m in texts
    ]
    return df.select("column", F.lit(kind).alias("kind"), F.inline(F.array(*rows)))


def _items(df: DataFrame, kind: str, metric: str, item: Column, value: Column) -> DataFrame:
    return df.select(
        "column",
        F.lit(kind).alias("kind"),
        F.lit(metric).alias("metric"),
        item.cast("string").alias("item"),
        value.cast("double").alias("value"),
        F.lit(None).cast("string").alias("text"),
    )


def profile_columns(
    df: DataFrame,
    kinds: dict[str, str],
    wide_columns: Sequence[str] = (),
    srids: dict[str, int | None] | None = None,
) -> DataFrame:
    """(column, kind, metric, item, value, text) for the given {column: kind}.

    Columns of one kind share their passes: categorical columns one frequency table, numeric
    columns one aggregation plus outliers and quantiles, temporal columns one month table.
    """
    by_kind = {k: [c for c, kind in kinds.items() if kind == k] for k in KINDS}
    parts: list[DataFrame] = []
    if by_kind["categorical"]:
        wide = [c for c in by_kind["categorical"] if c in wide_columns]
        freq = value_frequencies(df, by_kind["categorical"], wide)
        parts.append(
            _long(cardinality_entropy(freq), "categorical", ["n", "cardinality", "uniqueness", "entropy"])
        )
        top = top_values(freq, source=df, wide_columns=wide)
        parts.append(_items(top, "categorical", "top_k", F.col("value"), F.col("share")))
    if by_kind["numeric"]:
        profile = numeric_profile(df, by_kind["numeric"])
        parts.append(_long(profile, "numeric", [c for c in profile.columns if c != "column"]))
    if by_kind["temporal"]:
        months = month_counts(df, by_kind["temporal"])
        parts.append(
            _long(bounds_and_gaps(months), "temporal", ["n", "null_rate", "gap_months"], ["min", "max"])
        )
        parts.append(_items(seasonality(months), "temporal", "seasonality_by_month", F.col("month"), F.col("freq")))
        parts.append(_items(volume_by_year(months), "temporal", "volume_by_year", F.col("year"), F.col("freq")))
    for c in by_kind["spatial"]:
        shape = point_geometry(F.col(c)) if is_spatial(df.schema[c].dataType) else geometry(F.col("_decoded"))
        decoded = df.select(c) if is_spatial(df.schema[c].dataType) else df.select(decode_wkb(c).alias("_decoded"))
        profile = spatial_profile(decoded.select(shape.alias("_g")), "_g", c, (srids or {}).get(c))
        parts.append(
            _long(
                profile,
                "spatial",
                [m for m in profile.columns if m not in ("column", "geometry_types")],
            )
        )
        parts.append(
            profile.select("column", F.explode("geometry_types").alias("g", "k")).transform(
                lambda d: _items(d, "spatial", "geometry_types", F.col("g"), F.col("k"))
            )
        )
    if not parts:
        raise ValueError("no columns to profile")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def profile_raw(df: DataFrame, columns: Sequence[str] | None = None, spatial: Mapping[str, int | None] | None = None) -> DataFrame:
    """Profile of an undeclared table; kinds are candidates, marked by `type_inferred`.

    `spatial` names the geometry columns that are known beforehand, with their srid.
    """
    df = df.select(*columns) if columns else df
    known = {c: srid for c, srid in (spatial or {}).items() if c in df.columns}
    kinds, lengths = inferred(df, known)
    wide = [c for c, longest in lengths.items() if longest > KEY_LENGTH]
    return profile_columns(df, kinds, wide, known).withColumn("type_inferred", F.lit(True))


def profile_raw_file(spark: SparkSession, root: str, path: str) -> DataFrame:
    """Raw profile of a Parquet dataset below `root`, geometry by its footer, marked with its name as untrusted content.

    A path outside of `root`, of another format or without a dataset is an error.
    """
    full = guarded_path(spark, root, path)
    profile = profile_raw(scan(spark, full), spatial=geometry_columns(spark, full))
    return profile.select(F.lit(safe_name(full)).alias("dataset"), F.lit(True).alias("untrusted"), "*")


def profile_declared(
    df: DataFrame, catalog: Catalog, dataset: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Profile of declared columns; undeclared columns and unknown kinds are errors."""
    specs = catalog.column_specs(dataset)
    chosen = list(columns or specs)
    for c in chosen:
        if c not in specs:
            raise ValueError(f"column not in the catalog entry: {c!r}")
        if specs[c]["type"] not in KINDS:
            raise ValueError(f"kind not covered: {specs[c]['type']!r} (covered: {', '.join(KINDS)})")
    kinds = {c: specs[c]["type"] for c in chosen}
    texts = [
        f.name
        for f in df.select(*[c for c in chosen if kinds[c] == "categorical"]).schema.fields
        if f.dataType.typeName() == "string"
    ]
    wide = []
    if texts:
        longest = df.agg(*[F.max(F.length(c)).alias(c) for c in texts]).first()
        wide = [c for c in texts if (longest[c] or 0) > KEY_LENGTH]
    return profile_columns(df, kinds, wide, {c: specs[c]["srid"] for c in chosen})
