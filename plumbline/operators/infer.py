"""Candidate kind of every column from its Spark type and, for numbers, its distinct count."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.wkb import looks_like_wkb
from plumbline.sources.local import inline_rows

CATEGORICAL_MAX = 25
# HyperLogLog with this error has 512 registers; up to 25 values fill at most 25 of them, and its
# small-range estimate 512 * ln(512 / (512 - 25)) is then below 26. A larger estimate proves that
# the column has more than 25 values, so only columns below the margin need an exact count.
_SKETCH_ERROR = 0.05
_SKETCH_MARGIN = 40
_POINT = {"x", "y"}


def is_spatial(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and _POINT <= set(kind.fieldNames())


def _type_kind(kind: T.DataType) -> str:
    if is_spatial(kind):
        return "spatial"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    if isinstance(kind, T.NumericType):
        return "numeric"
    return "categorical"


def inferred(df: DataFrame, spatial: Collection[str] = ()) -> tuple[dict[str, str], dict[str, int]]:
    """({column: kind}, {string column: longest value}), from two small-result jobs.

    Columns named in `spatial` are geometry, as their file's footer says. A binary column that no footer names is geometry
    if it has values and all of them begin like well-known binary.
    """
    kinds = {f.name: "spatial" if f.name in spatial else _type_kind(f.dataType) for f in df.schema.fields}
    binaries = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BinaryType) and f.name not in spatial]
    numbers = [c for c, k in kinds.items() if k == "numeric"]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    measures = [F.approx_count_distinct(c, _SKETCH_ERROR).alias(c) for c in numbers]
    measures += [F.max(F.length(c)).alias(c) for c in texts]
    measures += [F.bool_and(looks_like_wkb(F.col(c))).alias(c) for c in binaries]
    if not measures:
        return kinds, {}
    seen = df.agg(*measures).first()
    kinds |= {c: "spatial" for c in binaries if seen[c]}
    few = [c for c in numbers if seen[c] <= _SKETCH_MARGIN]
    if few:
        exact = df.agg(*[F.size(F.collect_set(c)).alias(c) for c in few]).first()
        for c in few:
            if exact[c] <= CATEGORICAL_MAX:
                kinds[c] = "categorical"
    return kinds, {c: seen[c] or 0 for c in texts}


def infer_kind(df: DataFrame, column: str) -> str:
    if column not in df.columns:
        raise ValueError(f"no such column: {column!r}")
    return inferred(df.select(column))[0][column]


def infer_kinds(df: DataFrame) -> DataFrame:
    """(ordinal, column, kind)."""
    kinds, _ = inferred(df)
    return inline_rows(
        df.sparkSession,
        "ordinal int, column string, kind string",
        [(i, c, kinds[c]) for i, c in enumerate(df.columns)],
    )
