"""Literal rows as a local relation, which the optimizer can size and broadcast by itself."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def inline_rows(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    struct = T.StructType.fromDDL(schema)
    fields = to_arrow_schema(struct)
    columns = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=fields), struct)
