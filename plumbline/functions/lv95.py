"""LV95 (EPSG:2056) to WGS84 by the published swisstopo approximation (about 1 m)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LV95 = 2056


def to_wgs84(east: Column, north: Column, srid: int = LV95) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees; other reference systems are an error."""
    if srid != LV95:
        raise ValueError(f"no reprojection for srid {srid!r} (covered: {LV95})")
    y = (east - 2600000.0) / 1000000.0
    x = (north - 1200000.0) / 1000000.0
    # Coefficients of the published approximation.
    lng = (
        F.lit(2.6779094)
        + y * 4.728982
        + y * x * 0.791484
        + y * x * x * 0.1306
        - y * y * y * 0.0436
    )
    lat = (
        F.lit(16.9023892)
        + x * 3.238272
        - y * y * 0.270978
        - x * x * 0.002528
        - y * y * x * 0.0447
        - x * x * x * 0.0140
    )
    return lng * 100.0 / 36.0, lat * 100.0 / 36.0
