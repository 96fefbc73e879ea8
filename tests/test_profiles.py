"""Profile semantics: NULLs, ties, empty input, inference, quantiles."""

from __future__ import annotations

import datetime
import json
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions.wkb import decode_wkb, geometry, point_geometry
from plumbline.operators import frequency, infer, numeric, quantiles, spatial, temporal
from plumbline.plans.profile import profile_declared, profile_raw, profile_raw_file
from plumbline.sources.catalog import catalog_from_entries
from plumbline.sources.geoparquet import geometry_columns
from plumbline.sources.local import inline_rows


def rows_by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_null_is_a_group_but_no_distinct_value(spark):
    df = inline_rows(spark, "a string", [("x",), ("x",), (None,), (None,)])
    r = frequency.categorical_profile(df, ["a"]).first()
    assert (r["n"], r["cardinality"], r["uniqueness"], r["entropy"]) == (4, 1, 0.25, 1.0)
    top = frequency.top_values(frequency.value_frequencies(df, ["a"])).orderBy("rank").collect()
    assert [(t["value"], t["share"]) for t in top] == [("x", 0.5), (None, 0.5)]


def test_top_values_stop_at_k_and_break_ties_by_value(spark):
    df = spark.range(40).select((F.col("id") % 20).cast("string").alias("a"))
    top = frequency.top_values(frequency.value_frequencies(df, ["a"])).orderBy("rank").collect()
    assert [t["value"] for t in top] == sorted(str(i) for i in range(20))[:15]


def test_long_texts_are_found_again_behind_their_hash(spark):
    long = "y" * 500
    df = inline_rows(spark, "a string", [(long,)] * 3 + [("short",), ("z" * 200,)])
    freq = frequency.value_frequencies(df, ["a"], ["a"])
    assert max(len(r["key"]) for r in freq.collect()) == 64
    top = rows_by(frequency.top_values(freq, source=df, wide_columns=["a"]), "value")
    assert top[long]["freq"] == 3 and top["short"]["freq"] == 1


def test_empty_table_has_no_rates(spark):
    df = inline_rows(spark, "a string, x double, g struct<x: double, y: double>", [])
    assert frequency.categorical_profile(df, ["a"]).count() == 0
    r = numeric.numeric_profile(df, ["x"]).first()
    assert r["n"] == 0 and r["null_rate"] is None and r["mean"] is None and r["median"] is None
    s = spatial.spatial_profile(df.select(point_geometry(F.col("g")).alias("p")), "p", "g").first()
    assert s["n"] == 0 and s["null_rate"] is None and s["out_of_envelope_rate"] is None


def test_all_null_numeric_column(spark):
    df = inline_rows(spark, "x double, y double", [(None, 1.0), (None, 1.0)])
    r = rows_by(numeric.numeric_profile(df, ["x", "y"]), "column")
    assert r["x"]["null_rate"] == 1.0 and r["x"]["mean"] is None and r["x"]["std"] == 0.0
    assert r["y"]["skewness"] == 0.0 and r["y"]["n_outliers_3sigma"] == 0
    slots = rows_by(quantiles.exact_quantiles(df, ["x", "y"], map_rows=0), "column", "prob")
    assert slots[("x", 0.5)]["quantile"] is None and slots[("y", 0.5)]["quantile"] == 1.0


def test_outliers_are_counted_beyond_three_deviations(spark):
    df = inline_rows(spark, "x double", [(float(i % 3),) for i in range(50)] + [(1000.0,)])
    assert numeric.numeric_profile(df, ["x"]).first()["n_outliers_3sigma"] == 1


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.one_of(
            st.none(), st.integers(-3, 3).map(float),
            st.floats(-1e9, 1e9, allow_nan=False), st.floats(0, 1e-6, allow_nan=False),
        ),
        min_size=1, max_size=60,
    )
)
def test_slot_quantiles_are_exact(spark, values):
    df = inline_rows(spark, "x double", [(v,) for v in values]).repartition(3)
    known = [v for v in values if v is not None]
    got = rows_by(quantiles.exact_quantiles(df, ["x"], map_rows=0), "prob")
    for p in quantiles.PROFILE_PROBS:
        want = float(np.quantile(known, p)) if known else None
        if want is None:
            assert got[p]["quantile"] is None
        else:
            assert got[p]["quantile"] == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_slot_quantiles_with_one_hot_value(spark):
    values = np.concatenate([np.full(40000, 7.0), np.random.default_rng(1).lognormal(0, 4, 60000)])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = rows_by(quantiles.exact_quantiles(df, ["x"], map_rows=0), "prob")
    for p in quantiles.PROFILE_PROBS:
        assert got[p]["quantile"] == pytest.approx(float(np.quantile(values, p)), rel=1e-12)


def test_missing_months_and_single_month(spark):
    days = [(datetime.date(2011, 1, 5),), (datetime.date(2011, 4, 30),), (None,), (datetime.date(2011, 4, 1),)]
    months = temporal.month_counts(inline_rows(spark, "d date", days), ["d"])
    r = temporal.bounds_and_gaps(months).first()
    assert (r["gap_months"], r["min"], r["max"], r["null_rate"]) == (2, "2011-01-05", "2011-04-30", 0.25)
    assert sorted(str(m["month"]) for m in temporal.missing_months(months).collect()) == ["2011-02-01", "2011-03-01"]
    profile = temporal.temporal_profile(inline_rows(spark, "d date", days), ["d"]).first()
    assert profile["seasonality_by_month"] == {1: 1, 4: 2} and profile["volume_by_year"] == {2011: 3}


def test_all_null_dates(spark):
    r = temporal.bounds_and_gaps(temporal.month_counts(inline_rows(spark, "d date", [(None,)]), ["d"])).first()
    assert r["gap_months"] == 0 and r["min"] is None and r["null_rate"] == 1.0


def sample(spark):
    rows = [
        (1000 - 7 * i, i % 5, "odd" if i % 2 else "even", datetime.date(1999, 3, 1) + datetime.timedelta(9 * i)) for i in range(60)
    ]
    return inline_rows(spark, "height int, grade int, parity string, seen_on date", rows)


def test_inferred_kinds(spark):
    kinds = [r["kind"] for r in infer.infer_kinds(sample(spark)).orderBy("ordinal").collect()]
    assert kinds == ["numeric", "categorical", "categorical", "temporal"]
    with pytest.raises(ValueError):
        infer.infer_kind(sample(spark), "absent")


@pytest.mark.parametrize("distinct,kind", [(25, "categorical"), (26, "numeric"), (45, "numeric"), (500, "numeric")])
def test_number_of_values_decides(spark, distinct, kind):
    df = spark.range(2000).select((F.col("id") % distinct).cast("int").alias("v"))
    assert infer.infer_kind(df, "v") == kind


def test_raw_profile_marks_inference_and_covers_every_column(spark):
    out = profile_raw(sample(spark))
    assert {r["column"] for r in out.collect()} == {"height", "grade", "parity", "seen_on"}
    assert all(r["type_inferred"] for r in out.collect())


ENTRY = """{"dataset": "d", "columns": {"parity": {}, "height": {"type": "numeric"}, "odd": {"type": "graph"},
  "g": {"type": "spatial", "srid": 2056, "geometry_type_attendu": "point"}}}"""


def test_declared_profile_checks_its_columns(spark):
    catalog = catalog_from_entries(spark, [ENTRY])
    got = profile_declared(sample(spark), catalog, "d", ["parity", "height"])
    assert {(r["column"], r["kind"]) for r in got.collect()} == {("parity", "categorical"), ("height", "numeric")}
    with pytest.raises(ValueError, match="not in the catalog"):
        profile_declared(sample(spark), catalog, "d", ["grade"])
    with pytest.raises(ValueError, match="not covered"):
        profile_declared(sample(spark), catalog, "d", ["odd"])


def test_spatial_profile_of_planted_points(spark):
    points = [(2600000.0, 1200000.0), (0.0, 0.0), (1200000.0, 2600000.0), (2840000.0, 1300000.0), None]
    df = inline_rows(
        spark, "g struct<x: double, y: double>",
        [(None if p is None else {"x": p[0], "y": p[1]},) for p in points],
    )
    s = spatial.spatial_profile(df.select(point_geometry(F.col("g")).alias("p")), "p", "g", 2056).first()
    assert s["out_of_envelope_rate"] == 0.4 and s["null_rate"] == 0.2
    assert (s["min_x"], s["max_x"], s["max_y"]) == (2600000.0, 2840000.0, 1300000.0)
    assert s["geometry_types"] == {"POINT": 4} and s["srid_declared"] == 2056


# Well-known binary by hand: little-endian unless stated.
import struct  # noqa: E402


def wkb(code, *body, order="<"):
    return struct.pack(order + "BI", 1 if order == "<" else 0, code) + b"".join(body)


def xy(*pairs, order="<"):
    return struct.pack(order + "I", len(pairs)) + b"".join(struct.pack(order + "dd", *p) for p in pairs)


CASES = {
    "point": (wkb(1, struct.pack("<dd", 3, 4)), ("POINT", False, True, False, 3.0, 4.0, 0.0, 0.0)),
    "big endian": (wkb(1, struct.pack(">dd", 3, 4), order=">"), ("POINT", False, True, False, 3.0, 4.0, 0.0, 0.0)),
    "point z": (wkb(1001, struct.pack("<ddd", 3, 4, 5)), ("POINT", False, True, True, 3.0, 4.0, 0.0, 0.0)),
    "flagged z": (wkb(0x80000001, struct.pack("<ddd", 3, 4, 5)), ("POINT", False, True, True, 3.0, 4.0, 0.0, 0.0)),
    "empty point": (wkb(1, struct.pack("<dd", math.nan, math.nan)), ("POINT", True, True, False, None, None, 0.0, 0.0)),
    "line": (wkb(2, xy((0, 0), (3, 4), (3, 10))), ("LINESTRING", False, True, False, 0.0, 0.0, 11.0, 0.0)),
    "dot line": (wkb(2, xy((1, 1), (1, 1))), ("LINESTRING", False, False, False, 1.0, 1.0, 0.0, 0.0)),
    "square": (wkb(3, struct.pack("<I", 1), xy((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))), ("POLYGON", False, True, False, 0.0, 0.0, 0.0, 4.0)),
    "holed": (
        wkb(3, struct.pack("<I", 2), xy((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), xy((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))),
        ("POLYGON", False, True, False, 0.0, 0.0, 0.0, 15.0),
    ),
    "bow tie": (wkb(3, struct.pack("<I", 1), xy((0, 0), (2, 2), (2, 0), (0, 2), (0, 0))), ("POLYGON", False, False, False, 0.0, 0.0, 0.0, 0.0)),
    "multi": (
        wkb(5, struct.pack("<I", 2), wkb(2, xy((0, 0), (1, 0))), wkb(2, xy((5, 5), (5, 7)))),
        ("MULTILINESTRING", False, True, False, 0.0, 0.0, 3.0, 0.0),
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_well_known_binary(spark, name):
    blob, want = CASES[name]
    df = inline_rows(spark, "w binary", [(bytearray(blob),), (None,)])
    out = df.select(decode_wkb("w").alias("d")).select(geometry(F.col("d")).alias("g")).select("g.*")
    got = [tuple(r) for r in out.collect() if r["type"] is not None]
    assert len(got) == 1
    kind, empty, valid, has_z, xmin, _, ymin, _, length, area = got[0]
    assert (kind, empty, valid, has_z, xmin, ymin, length, area) == want


def test_worker_code_needs_no_installed_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    code = cloudpickle.dumps(decode_wkb.func)
    read = "import pickle, sys; f = pickle.loads(sys.stdin.buffer.read()); import pyarrow as pa; print(f(pa.array([bytes.fromhex(sys.argv[1])])))"
    out = subprocess.run(
        [sys.executable, "-c", read, CASES["line"][0].hex()], input=code, cwd=tmp_path, capture_output=True, timeout=60
    )
    assert out.returncode == 0 and b"LINESTRING" in out.stdout, out.stderr


def test_mixed_batches_decode_value_by_value(spark):
    values = [(k, CASES[name][0] if name else None) for k, name in enumerate(["point", None, "big endian", "point z", "empty point", "square", "point", None, "line"])]
    rows = spark.createDataFrame(values, "k int, w binary").coalesce(1)
    got = rows.select("k", decode_wkb("w").alias("d")).select("k", geometry(F.col("d")).alias("g")).orderBy("k").collect()
    for (_, blob), row in zip(values, got):
        want = next((case[1] for case in CASES.values() if case[0] == blob), None)
        g = row["g"]
        assert (g is None) if want is None else (g["type"], g["is_empty"], g["is_valid"], g["has_z"], g["xmin"], g["ymin"], g["length"], g["area"]) == want


def test_binary_columns_are_geometry_only_if_all_values_are(spark):
    shapes = [c[0] for c in CASES.values()]
    rows = [(k, s, s if k else b"plain bytes", None, b"\x01\x01") for k, s in enumerate(shapes)] + [(99, None, None, None, None)]
    df = spark.createDataFrame(rows, "k int, geom binary, mixed binary, nothing binary, cut binary")
    kinds = {r["column"]: r["kind"] for r in infer.infer_kinds(df).collect()}
    assert {c: kinds[c] for c in ("geom", "mixed", "nothing", "cut")} == {"geom": "spatial", "mixed": "categorical", "nothing": "categorical", "cut": "categorical"}
    profile = profile_raw(df.select("geom")).where("metric = 'null_rate'").collect()
    assert [(r["kind"], r["value"]) for r in profile] == [("spatial", 1 / len(rows))]


def test_raw_profile_of_a_file_takes_geometry_from_its_footer(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    crs = {"id": {"authority": "EPSG", "code": 2056}}
    geo = {"version": "1.1.0", "primary_column": "geom", "columns": {"geom": {"encoding": "WKB", "geometry_types": ["Point"], "crs": crs}, "old": {"encoding": "point"}}}
    data = pa.table({"name": ["a", "b", None], "geom": [CASES["point"][0], None, None], "none": pa.array([None, None, None], pa.binary())})
    folder = tmp_path / "data" / "my towns.parquet"
    folder.mkdir(parents=True)
    pq.write_table(data.replace_schema_metadata({"geo": json.dumps(geo)}), folder / "part-0.parquet")
    pq.write_table(data, tmp_path / "data" / "plain.parquet")
    root = str(tmp_path / "data")
    assert geometry_columns(spark, f"{root}/my towns.parquet") == {"geom": 2056}
    assert geometry_columns(spark, f"{root}/plain.parquet") == {}
    out = profile_raw_file(spark, root, "my towns.parquet").collect()
    assert {(r["dataset"], r["untrusted"], r["type_inferred"]) for r in out} == {("my_towns", True, True)}
    assert {r["column"]: r["kind"] for r in out} == {"name": "categorical", "geom": "spatial", "none": "categorical"}
    assert [r["value"] for r in out if r["metric"] == "srid_declared"] == [2056.0]
    for wrong in ("../outside.parquet", "plain.csv", "absent.parquet"):
        with pytest.raises(ValueError):
            profile_raw_file(spark, root, wrong)
