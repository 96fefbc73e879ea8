"""The column catalog as tables.

A catalog file holds one JSON entry per line. Reading it gives three DataFrames: one row per
dataset, per declared column and per declared exposure. Lookups collect the rows of one dataset
only: a table's columns, never its data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.local import inline_rows
from plumbline.sources.tables import checked_name

# Field names of a catalog entry.
ENTRY_SCHEMA = """
    dataset string, titre string, source string, data string, note string,
    grid struct<east: string, north: string, cell_size: double, coord_ref: string>,
    columns map<string, struct<type: string, sens: string, piege: string, srid: int,
                               unite: string, geometry_type_attendu: string>>,
    exposures map<string, struct<kind: string, table: string, fiche: string, key: string,
                                 weight: string, uniform: boolean, note: string>>
"""


@dataclass(frozen=True)
class Catalog:
    """Catalog tables; build with `read_catalog` or `catalog_from_entries`."""

    datasets: DataFrame
    columns: DataFrame
    exposures: DataFrame

    def list_datasets(self) -> DataFrame:
        return self.datasets.select("dataset").distinct()

    def describe(self, dataset: str) -> DataFrame:
        """Declared columns of one dataset in declared order."""
        return self.columns.filter(F.col("dataset") == dataset).orderBy("ordinal")

    def entry(self, name: str) -> Row:
        """Dataset row of a referenced entry; the name is checked before use."""
        row = self.datasets.filter(F.col("dataset") == checked_name(name)).first()
        if row is None:
            raise ValueError(f"no catalog entry: {name!r}")
        return row

    def column_specs(self, dataset: str) -> dict[str, Row]:
        return {r["column"]: r for r in self.describe(dataset).collect()}

    def exposure(self, dataset: str, column: str) -> Row | None:
        return self.exposures.filter(
            (F.col("dataset") == dataset) & (F.col("column") == column)
        ).first()

    def resolved_grids(self) -> DataFrame:
        """Every spatial exposure with the grid of the entry it names."""
        grids = self.datasets.select(
            F.col("dataset").alias("entry"), "data", "east", "north", "cell_size", "coord_ref"
        )
        return self.exposures.filter(F.col("kind") == "spatial_grid").join(grids, "entry", "left")

    def point_columns(self) -> DataFrame:
        """First column of each dataset declared spatial with expected geometry `point`."""
        points = self.columns.filter(
            (F.col("type") == "spatial") & (F.col("expected_geometry") == "point")
        )
        return points.groupBy("dataset").agg(
            F.min_by("column", "ordinal").alias("column"), F.min_by("srid", "ordinal").alias("srid")
        )

    def point_column(self, dataset: str) -> Row:
        row = self.point_columns().filter(F.col("dataset") == dataset).first()
        if row is None:
            raise ValueError(f"no point column declared for {dataset!r}")
        return row


def _tables(entries: DataFrame) -> Catalog:
    datasets = entries.select(
        "dataset", F.col("titre").alias("title"), "source", "data", "note", "grid.*"
    )
    columns = entries.select("dataset", F.posexplode("columns").alias("ordinal", "column", "spec")).select(
        "dataset",
        "ordinal",
        "column",
        F.coalesce("spec.type", F.lit("categorical")).alias("type"),
        F.col("spec.srid").alias("srid"),
        F.col("spec.geometry_type_attendu").alias("expected_geometry"),
        F.col("spec.sens").alias("meaning"),
        F.col("spec.piege").alias("trap"),
        F.col("spec.unite").alias("unit"),
    )
    exposures = entries.select("dataset", F.explode("exposures").alias("column", "spec")).select(
        "dataset",
        "column",
        F.col("spec.kind").alias("kind"),
        F.col("spec.table").alias("path"),
        F.col("spec.fiche").alias("entry"),
        F.col("spec.key").alias("key"),
        F.col("spec.weight").alias("weight"),
        F.coalesce("spec.uniform", F.lit(False)).alias("uniform"),
    )
    return Catalog(datasets, columns, exposures)


def read_catalog(spark: SparkSession, path: str) -> Catalog:
    """Catalog from a JSON-lines file or a folder of them."""
    return _tables(spark.read.schema(ENTRY_SCHEMA).json(path))


def catalog_from_entries(spark: SparkSession, entries: list[str]) -> Catalog:
    """Catalog from JSON texts, one per entry."""
    raw = inline_rows(spark, "entry string", [(e,) for e in entries])
    return _tables(raw.select(F.from_json("entry", ENTRY_SCHEMA).alias("e")).select("e.*"))
