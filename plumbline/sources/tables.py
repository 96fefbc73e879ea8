"""Parquet tables behind checked names and paths."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.local import inline_rows

_NAME = re.compile(r"[A-Za-z0-9_]+")


def checked_name(name: str) -> str:
    """`name` if it is made of ASCII letters, digits and underscores, else ValueError."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"invalid name: {name!r}")
    return name


def safe_name(path: str) -> str:
    """File stem with every other character replaced by an underscore."""
    stem = posixpath.splitext(posixpath.basename(path))[0]
    return re.sub(r"[^0-9A-Za-z_]", "_", stem)


def safe_name_column(path: Column) -> Column:
    """`safe_name` over a column of paths."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(stem, r"[^0-9A-Za-z_]", "_")


def scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def bounded_view(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Register the Parquet data as a temporary view under a checked name.

    A view over files accepts no INSERT, UPDATE or DELETE, so its users can only read.
    """
    df = scan(spark, path)
    df.createOrReplaceTempView(checked_name(name))
    return df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists on its own file system (local, HDFS, object store)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def guarded_path(spark: SparkSession, root: str, path: str) -> str:
    """Full path of an existing `.parquet` dataset that lies under `root`, else ValueError."""
    root = posixpath.normpath(root)
    full = posixpath.normpath(posixpath.join(root, path))
    if posixpath.commonpath([root, full]) != root or full == root:
        raise ValueError(f"outside the data folder: {path!r}")
    if not full.endswith(".parquet"):
        raise ValueError(f"not a .parquet dataset: {path!r}")
    if not path_exists(spark, full):
        raise ValueError(f"no such dataset: {path!r}")
    return full


def write_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> DataFrame:
    """Write and read back, so that later steps see exactly what was stored."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return scan(df.sparkSession, path)


def project(df: DataFrame, columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Keep, rename and cast: {new name: (source column, type)}."""
    return df.select([F.col(src).cast(kind).alias(new) for new, (src, kind) in columns.items()])


def schema_of(df: DataFrame) -> DataFrame:
    """(ordinal, column, type) of a DataFrame, from its schema alone."""
    return inline_rows(
        df.sparkSession,
        "ordinal int, column string, type string",
        [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)],
    )
