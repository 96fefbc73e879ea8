"""Well-known-binary geometry: Arrow batches in and out, measures as Column expressions.

The Python part turns bytes into coordinates and judges rings; types, extents, lengths and areas are
computed from those coordinates inside Spark.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.rings import rings_valid

# OGC geometry type names by code.
TYPE_NAMES = {
    1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT",
    5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION",
}
_XY = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_PARTS = pa.list_(pa.struct([("role", pa.string()), ("member", pa.int32()), ("xy", pa.list_(_XY))]))
_POINT_TYPE = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_PART_TYPE = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("member", T.IntegerType()),
        T.StructField("xy", T.ArrayType(_POINT_TYPE)),
    ]
)
_DECODED = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("has_z", T.BooleanType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("parts", T.ArrayType(_PART_TYPE)),
    ]
)


def _read(data: bytes, at: int = 0, member: int = 0):
    """(type code, has_z, parts, next offset) of the geometry at an offset.

    Parts of one polygon or multipolygon carry one member number, that of their first part within the value.
    """
    order = "<" if data[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    if code & 0x20000000:
        at += 4
    kind, group = (code & 0x0FFFFFFF) % 1000, (code & 0x0FFFFFFF) // 1000
    has_z = bool(code & 0x80000000) or group in (1, 3)
    width = 2 + has_z + (bool(code & 0x40000000) or group in (2, 3))

    def run(count: int, start: int):
        xs = np.frombuffer(data, order + "f8", count * width, start).reshape(count, width)
        return [{"x": float(p[0]), "y": float(p[1])} for p in xs], start + 8 * count * width

    if kind == 1:
        xy, at = run(1, at)
        return kind, has_z, [{"role": "point", "member": member, "xy": [p for p in xy if p["x"] == p["x"]]}], at
    (count,) = struct.unpack_from(order + "I", data, at)
    at += 4
    if kind == 2:
        xy, at = run(count, at)
        return kind, has_z, [{"role": "line", "member": member, "xy": xy}], at
    parts = []
    for i in range(count):
        if kind == 3:
            (n,) = struct.unpack_from(order + "I", data, at)
            xy, at = run(n, at + 4)
            parts.append({"role": "hole" if i else "ring", "member": member, "xy": xy})
        else:
            _, _, inner, at = _read(data, at, member if kind == 6 else member + len(parts))
            parts += inner
    return kind, has_z, parts, at


def _plain_points(wkb: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which values are little-endian two-dimensional points, and their coordinates, read from Arrow's own buffers."""
    wide = pa.types.is_large_binary(wkb.type)
    _, offsets, data = wkb.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[wkb.offset : wkb.offset + len(wkb) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    present = np.asarray(pc.is_valid(wkb).to_numpy(zero_copy_only=False), bool)
    plain = np.flatnonzero(present & (np.diff(ends) == 21))
    told = raw[ends[plain, None] + np.arange(21)]
    own = (told[:, :5] == np.frombuffer(b"\x01\x01\x00\x00\x00", np.uint8)).all(1)
    return plain[own], np.ascontiguousarray(told[own, 5:]).view("<f8").reshape(-1, 2)


# Fixed by the format: a little-endian two-dimensional polygon of one ring begins so, then come the number of corners and these.
_ONE_RING = np.frombuffer(struct.pack("<BII", 1, 3, 1), np.uint8)


def _plain_rings(wkb: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Which values are little-endian two-dimensional polygons of one ring, and their parts, read from Arrow's own buffers."""
    wide = pa.types.is_large_binary(wkb.type)
    _, offsets, data = wkb.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[wkb.offset : wkb.offset + len(wkb) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    present = np.asarray(pc.is_valid(wkb).to_numpy(zero_copy_only=False), bool)
    sizes = np.diff(ends)
    rows = np.flatnonzero(present & (sizes >= 13) & ((sizes - 13) % 16 == 0))
    head = raw[ends[rows, None] + np.arange(13)]
    corners = np.ascontiguousarray(head[:, 9:]).view("<u4").reshape(-1).astype(np.int64)
    plain = (head[:, :9] == _ONE_RING).all(1) & (corners == (sizes[rows] - 13) // 16)
    rows, corners = rows[plain], corners[plain]
    cuts = np.concatenate([[0], np.cumsum(corners)])
    at = np.repeat(ends[rows] + 13 - 16 * cuts[:-1], corners) + 16 * np.arange(cuts[-1])
    xy = np.ascontiguousarray(raw[at[:, None] + np.arange(16)]).view("<f8").reshape(-1, 2)
    runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy())], ["x", "y"]))
    n = len(rows)
    ring = pa.StructArray.from_arrays([pa.array(np.full(n, "ring", object), pa.string()), pa.array(np.zeros(n, np.int32)), runs], ["role", "member", "xy"])
    return rows, pa.ListArray.from_arrays(pa.array(np.arange(n + 1), pa.int32()), ring).cast(_PARTS)


@F.arrow_udf(_DECODED)
def decode_wkb(wkb: pa.Array) -> pa.Array:
    """BINARY -> struct(type, has_z, x, y, parts); x and y for points, parts for all others.

    Plain points and polygons of one ring are decoded as arrays, all other values of the batch one by one.
    """
    if isinstance(wkb, pa.ChunkedArray):
        wkb = wkb.combine_chunks()
    n = len(wkb)
    plain, xy = _plain_points(wkb)
    here, z = np.zeros(n, bool), np.zeros(n, bool)
    at = np.full((n, 2), np.nan)
    here[plain], at[plain] = True, xy
    names = np.full(n, "POINT", object)
    ringed, rings = _plain_rings(wkb)
    here[ringed], names[ringed] = True, "POLYGON"
    parts: list = [None] * n
    missing = ~np.asarray(pc.is_valid(wkb).to_numpy(zero_copy_only=False), bool)
    for k in np.flatnonzero(~here & ~missing).tolist():
        kind, z[k], read, _ = _read(wkb[k].as_py())
        names[k] = TYPE_NAMES[kind]
        if kind != 1:
            parts[k] = read
        elif read[0]["xy"]:
            at[k] = read[0]["xy"][0]["x"], read[0]["xy"][0]["y"]
    absent = np.isnan(at[:, 0])
    shaped = pa.array(parts, _PARTS)
    if len(ringed):
        place = np.arange(n)
        place[ringed] = n + np.arange(len(ringed))
        shaped = pa.concat_arrays([shaped, rings]).take(pa.array(place))
    columns = [
        pa.array(names, pa.string()), pa.array(z), pa.array(at[:, 0], mask=absent), pa.array(at[:, 1], mask=absent), shaped,
    ]
    return pa.StructArray.from_arrays(columns, ["type", "has_z", "x", "y", "parts"], mask=pa.array(missing))


# Fixed by the format, as hexadecimal text: byte order, then a code of 1 to 7 with an offset of thousands or flags for Z, M and srid.
_LITTLE = "01((0[1-7]00|E[9A-F]03|D[1-7]07|B[9A-F]0B)0000|0[1-7]0000(20|40|60|80|A0|C0|E0))"
_BIG = "00(0000(000[1-7]|03E[9A-F]|07D[1-7]|0BB[9A-F])|(20|40|60|80|A0|C0|E0)00000[1-7])"


def looks_like_wkb(binary: Column) -> Column:
    """Whether a value begins like well-known binary and is long enough for a point or a count; NULL for NULL."""
    head = F.hex(F.substring(binary, 1, 5))
    point = head.rlike("^(01(0100|E903|D107|B90B)|0101|00.{6}01|000000(03E9|07D1|0BB9))")
    return head.rlike(f"^({_LITTLE}|{_BIG})$") & (F.octet_length(binary) >= F.when(point, 21).otherwise(9))


@F.arrow_udf(T.BinaryType())
def point_wkb(x: pa.Array, y: pa.Array) -> pa.Array:
    """(x, y) -> little-endian WKB point, NULL where a coordinate is NULL."""
    return pa.array(
        [
            None if a is None or b is None else struct.pack("<BIdd", 1, 1, a, b)
            for a, b in zip(x.to_pylist(), y.to_pylist())
        ],
        pa.binary(),
    )


@F.arrow_udf(T.BinaryType())
def polyline_wkb(xy: pa.Array, closed: pa.Array) -> pa.Array:
    """array<struct<x,y>> -> WKB: a one-ring polygon where `closed`, else a line string."""
    out = []
    for run, ring in zip(xy.to_pylist(), closed.to_pylist()):
        body = struct.pack("<I", len(run)) + b"".join(struct.pack("<dd", p["x"], p["y"]) for p in run)
        head = struct.pack("<BII", 1, 3, 1) if ring else struct.pack("<BI", 1, 2)
        out.append(head + body)
    return pa.array(out, pa.binary())


@F.arrow_udf(T.BinaryType())
def polygons_wkb(polygons: pa.Array) -> pa.Array:
    """array<polygon>, a polygon being array<ring>, a ring array<struct<x,y>> -> WKB: a polygon if there is one, else a multipolygon."""
    if isinstance(polygons, pa.ChunkedArray):
        polygons = polygons.combine_chunks()
    shapes = polygons.values
    rings = shapes.values
    corners = rings.values
    if shapes.null_count or rings.null_count or corners.null_count or any(corners.field(c).null_count for c in ("x", "y")):
        raise ValueError("a polygon, ring or coordinate is NULL")
    xy = np.column_stack([corners.field(c).to_numpy() for c in ("x", "y")]).astype("<f8")
    starts, cuts, ends = polygons.offsets.to_pylist(), shapes.offsets.to_pylist(), rings.offsets.to_pylist()
    out = []
    for row, present in enumerate(polygons.is_valid().to_pylist()):
        if not present:
            out.append(None)
            continue
        coded = []
        for k in range(starts[row], starts[row + 1]):
            own = range(cuts[k], cuts[k + 1])
            body = b"".join(struct.pack("<I", ends[r + 1] - ends[r]) + xy[ends[r] : ends[r + 1]].tobytes() for r in own)
            coded.append(struct.pack("<BII", 1, 3, len(own)) + body)
        out.append(coded[0] if len(coded) == 1 else struct.pack("<BII", 1, 6, len(coded)) + b"".join(coded))
    return pa.array(out, pa.binary())


def _segments(xy: Column) -> Column:
    pairs = F.arrays_zip(
        F.slice(xy, 1, F.greatest(F.size(xy) - 1, F.lit(0))).alias("a"),
        F.slice(xy, 2, F.greatest(F.size(xy) - 1, F.lit(0))).alias("b"),
    )
    return F.when(F.size(xy) >= 2, pairs).otherwise(F.slice(pairs, 1, 0))


def _total(items: Column, term) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, i: acc + term(i))


def _run_length(part: Column) -> Column:
    return _total(
        _segments(part["xy"]),
        lambda s: F.sqrt(
            (s["b"]["x"] - s["a"]["x"]) * (s["b"]["x"] - s["a"]["x"])
            + (s["b"]["y"] - s["a"]["y"]) * (s["b"]["y"] - s["a"]["y"])
        ),
    )


def _ring_area(part: Column) -> Column:
    # Relative to the first corner: national coordinates are large and would cancel badly.
    o = F.element_at(part["xy"], 1)
    twice = _total(
        _segments(part["xy"]),
        lambda s: (s["a"]["x"] - o["x"]) * (s["b"]["y"] - o["y"])
        - (s["b"]["x"] - o["x"]) * (s["a"]["y"] - o["y"]),
    )
    return F.abs(twice) / 2


def _run_valid(part: Column) -> Column:
    """Lines have two different corners and points and lines finite coordinates; rings are judged together."""
    xy = part["xy"]
    finite = F.forall(xy, lambda p: F.abs(p["x"]) + F.abs(p["y"]) < F.lit(float("inf")))
    distinct = F.size(F.array_distinct(xy)) >= 2
    return part["role"].isin("ring", "hole") | (F.size(xy) == 0) | (finite & ((part["role"] != "line") | distinct))


def geometry(decoded: Column) -> Column:
    """struct(type, is_empty, is_valid, has_z, xmin, xmax, ymin, ymax, length, area).

    Validity is that of `rings.member_valid` for polygons; lines need two different corners, all coordinates are finite.
    """
    parts = decoded["parts"]
    shaped = parts.isNotNull()
    xs = F.transform(F.flatten(F.transform(parts, lambda p: p["xy"])), lambda p: p["x"])
    ys = F.transform(F.flatten(F.transform(parts, lambda p: p["xy"])), lambda p: p["y"])
    lines = F.filter(parts, lambda p: p["role"] == "line")
    rings = F.filter(parts, lambda p: p["role"].isin("ring", "hole"))
    area = _total(
        rings, lambda p: _ring_area(p) * F.when(p["role"] == "hole", -1.0).otherwise(1.0)
    )
    return F.when(
        decoded.isNotNull(),
        F.struct(
            decoded["type"].alias("type"),
            F.when(shaped, F.size(xs) == 0).otherwise(decoded["x"].isNull()).alias("is_empty"),
            F.when(shaped, rings_valid(parts) & F.forall(parts, _run_valid))
            .otherwise(F.coalesce(F.abs(decoded["x"]) + F.abs(decoded["y"]) < F.lit(float("inf")), F.lit(True)))
            .alias("is_valid"),
            decoded["has_z"].alias("has_z"),
            F.when(shaped, F.array_min(xs)).otherwise(decoded["x"]).alias("xmin"),
            F.when(shaped, F.array_max(xs)).otherwise(decoded["x"]).alias("xmax"),
            F.when(shaped, F.array_min(ys)).otherwise(decoded["y"]).alias("ymin"),
            F.when(shaped, F.array_max(ys)).otherwise(decoded["y"]).alias("ymax"),
            F.when(shaped, _total(lines, _run_length)).otherwise(F.lit(0.0)).alias("length"),
            F.when(shaped, area).otherwise(F.lit(0.0)).alias("area"),
        ),
    )


def point_geometry(point: Column) -> Column:
    """The same struct for a point struct(x, y), without any decoding."""
    x, y = point["x"], point["y"]
    return F.when(
        point.isNotNull(),
        F.struct(
            F.lit("POINT").alias("type"),
            (x.isNull() | F.isnan(x)).alias("is_empty"),
            F.coalesce(F.abs(x) + F.abs(y) < F.lit(float("inf")), F.lit(True)).alias("is_valid"),
            F.lit(False).alias("has_z"),
            x.alias("xmin"), x.alias("xmax"), y.alias("ymin"), y.alias("ymax"),
            F.lit(0.0).alias("length"), F.lit(0.0).alias("area"),
        ),
    )
