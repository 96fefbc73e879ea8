"""Geometry columns that a GeoParquet file's footer declares."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _first_file(fs, path):
    """A data file of a dataset: the path itself, or the first one below it in order of names."""
    if not fs.getFileStatus(path).isDirectory():
        return path
    for status in sorted(fs.listStatus(path), key=lambda s: s.getPath().getName()):
        name = status.getPath().getName()
        if name[0] in "_.":
            continue
        if status.isDirectory():
            found = _first_file(fs, status.getPath())
            if found is not None:
                return found
        elif name.endswith(".parquet"):
            return status.getPath()
    return None


def geometry_columns(spark: SparkSession, path: str) -> dict[str, int | None]:
    """{column: EPSG code or None} of the columns the footer's `geo` entry declares as well-known binary.

    One footer is read, whatever the size of the dataset: the entry is the same in all its files. A dataset without
    the entry or without files declares none. Columns of other encodings are left to their types.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    file = _first_file(place.getFileSystem(conf), place)
    if file is None:
        return {}
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(file, conf))
    try:
        entry = reader.getFooter().getFileMetaData().getKeyValueMetaData().get("geo")
    finally:
        reader.close()
    declared = json.loads(entry).get("columns", {}) if entry else {}
    return {name: _epsg(spec.get("crs")) for name, spec in declared.items() if spec.get("encoding") == "WKB"}


def _epsg(crs: dict | None) -> int | None:
    told = (crs or {}).get("id") or {}
    return int(told["code"]) if told.get("authority") == "EPSG" and str(told.get("code", "")).isdigit() else None
