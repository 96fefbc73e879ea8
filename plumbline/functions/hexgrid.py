"""Planar hexagonal cells as Column arithmetic.

Cells are pointy-top hexagons in the metres of the point's own projection, one grid per resolution.
An id packs (resolution, q, r) into a BIGINT, so grouping and joining move 8 bytes per cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published mean edge lengths of the H3 resolutions 0..15, in metres.
EDGE_METRES = (
    1281256.011, 483056.8391, 182512.9565, 68979.22179, 26071.75968, 9854.090990, 3724.532667,
    1406.475763, 531.414010, 200.786148, 75.863783, 28.663897, 10.830188, 4.092010, 1.546100,
    0.584169,
)
ORIGIN = (2485000.0, 1075000.0)
SQRT3 = math.sqrt(3.0)
_OFFSET = 1 << 27
_SPAN = 1 << 28


def edge_of(resolution: int) -> float:
    if isinstance(resolution, bool) or not 0 <= resolution < len(EDGE_METRES):
        raise ValueError(f"resolution outside 0..15: {resolution!r}")
    return EDGE_METRES[resolution]


def cell_of(
    x: Column,
    y: Column,
    resolution: Column,
    edge: Column,
    origin: tuple[float, float] = ORIGIN,
) -> Column:
    """BIGINT id of the cell holding (x, y), NULL without coordinates.

    Centres form two rectangular lattices, one shifted by half a step both ways. In steps of the
    first one (u along x, v along y) its nearest centre is also the nearest of all exactly when
    |u - round(u)| + 3 |v - round(v)| <= 1; else the shifted lattice's centre around the point is.
    `edge` is the edge length of `resolution`; both may be literals or columns.
    """
    u = (x - origin[0]) / (edge * SQRT3)
    v = (y - origin[1]) / (edge * 3.0)
    i, j = F.floor(u + 0.5), F.floor(v + 0.5)
    a, b = F.floor(u), F.floor(v)

    def packed(q: Column, r: Column) -> Column:
        return (q + _OFFSET) * F.lit(_SPAN) + (r + _OFFSET)

    near = F.abs(u - i) + F.abs(v - j) * 3.0 <= 1.0
    place = F.when(near, packed(i - j, j * 2)).otherwise(packed(a - b, b * 2 + 1))
    return F.shiftleft(resolution.cast("bigint"), 56) + place


def axial(cell: Column) -> tuple[Column, Column]:
    r = F.pmod(cell, F.lit(_SPAN)) - _OFFSET
    q = F.pmod(F.shiftright(cell, 28), F.lit(_SPAN)) - _OFFSET
    return q, r


def shifted(cell: Column, dq: Column, dr: Column) -> Column:
    """Id of the cell `dq`, `dr` axial steps away; the packed id is linear in both."""
    return cell + dq.cast("bigint") * F.lit(_SPAN) + dr


def cell_centre(
    cell: Column, edge: Column, origin: tuple[float, float] = ORIGIN
) -> tuple[Column, Column]:
    """(x, y) of the cell's centre; `edge` is the edge length of its resolution."""
    q, r = axial(cell)
    x = F.lit(SQRT3) * (q + r / 2.0) * edge + origin[0]
    y = F.lit(1.5) * r * edge + origin[1]
    return x, y

