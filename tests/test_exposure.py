"""Null-model tests: goldens, errors, random properties."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import exposure_tests as x
from plumbline.plans.concentration import concentration_test, declared_concentration_test
from plumbline.sources.catalog import catalog_from_entries
from plumbline.sources.exposure import exposure_table
from plumbline.sources.local import inline_rows

# Resident population by canton code.
POPULATION = {
    "ZH": 1579000, "BE": 1051000, "VD": 826000, "AG": 706000, "SG": 521000, "GE": 514000, "LU": 424000,
    "VS": 356000, "TI": 351000, "FR": 334000, "BL": 292000, "TG": 288000, "SO": 281000, "GR": 202000,
    "BS": 196000, "NE": 176000, "SZ": 167000, "ZG": 131000, "SH": 84000, "JU": 74000, "AR": 55800,
    "NW": 44500, "GL": 41000, "OW": 38600, "UR": 37300, "AI": 16400,
}


def test_published_expectations(spark):
    rest = 267761 - 37891 - 49397
    others = [u for u in POPULATION if u not in ("BE", "ZH")]
    counts = {u: rest // len(others) for u in others}
    counts[others[0]] += rest - sum(counts.values())
    counts |= {"BE": 37891, "ZH": 49397}
    exposed = inline_rows(
        spark, "unit string, observed bigint, weight double",
        [(u, n, float(POPULATION[u])) for u, n in counts.items()],
    )
    got = {r["unit"]: r for r in x.with_expected(exposed).collect()}
    assert round(got["BE"]["expected"], 2) == 32027.95 and round(got["BE"]["z"], 2) == 32.76
    assert round(got["ZH"]["expected"], 2) == 48118.11 and round(got["ZH"]["z"], 2) == 5.83


def events(spark, counts):
    rows = [(u,) for u, n in counts.items() for _ in range(n)]
    return inline_rows(spark, "unit string", rows).repartition(4)


def weights(spark, w):
    return inline_rows(spark, "key string, weight double", list(w.items()) if isinstance(w, dict) else w)


def report(df):
    return {r["subject"]: r for r in df.collect()}


def test_true_and_false_hotspot(spark):
    df = events(spark, {"A": 300, "B": 200, "C": 60})
    got = report(concentration_test(df, "unit", weights(spark, {"A": 300.0, "B": 50.0, "C": 60.0}), "w.parquet"))
    most, raw = got["most_concentrated"], got["highest_raw_count"]
    assert most["unit"] == "B" and most["pseudo_p"] == 0.001 and most["std_excess"] > 0
    assert raw["unit"] == "A" and raw["pseudo_p"] > 0.9 and raw["std_excess"] < 0
    assert most["exposure_model"] == "declared:w.parquet" and most["n_permutations"] == 999
    assert (most["n_total"], most["n_units"], most["seed"]) == (560, 3, 42)


def test_proportional_counts_show_nothing(spark):
    df = events(spark, {"A": 300, "B": 100})
    got = report(concentration_test(df, "unit", weights(spark, {"A": 3.0, "B": 1.0})))
    assert got["most_concentrated"]["pseudo_p"] > 0.5


def test_same_seed_same_report_on_other_partitions(spark):
    df = events(spark, {"A": 30, "B": 22, "C": 11})
    w = weights(spark, {"A": 1.0, "B": 1.0, "C": 1.0})
    one = concentration_test(df, "unit", w, replicates=199).collect()
    two = concentration_test(df.repartition(13), "unit", w.repartition(5), replicates=199).collect()
    assert one == two


def test_abstention_and_uniform(spark):
    df = events(spark, {"A": 3, "B": 2})
    row = concentration_test(df, "unit").first()
    assert row["exposure_model"] == "abstention" and row["reason"] and row["pseudo_p"] is None
    assert (row["n_units"], row["n_total"]) == (2, 5)
    got = report(concentration_test(df, "unit", uniform=True))
    assert got["most_concentrated"]["exposure_model"] == "uniform:declared"
    assert got["most_concentrated"]["expected"] == 2.5


@pytest.mark.parametrize(
    "w,message",
    [
        ([("A", 1.0)], "without declared exposure"),
        ([("A", 1.0), ("B", 0.0)], "zero or negative"),
        ([("A", 1.0), ("B", -1.0)], "zero or negative"),
        ([("A", 1.0), ("B", 1.0), ("B", 2.0)], "repeated"),
    ],
)
def test_bad_exposure_is_an_error(spark, w, message):
    with pytest.raises(ValueError, match=message):
        concentration_test(events(spark, {"A": 3, "B": 2}), "unit", weights(spark, w))


def test_no_rows_and_unknown_column_are_errors(spark):
    empty = inline_rows(spark, "unit string", [])
    for options in ({}, {"uniform": True}, {"exposure": weights(spark, {"A": 1.0})}):
        with pytest.raises(ValueError, match="no rows"):
            concentration_test(empty, "unit", **options)
    with pytest.raises(ValueError, match="no such column"):
        concentration_test(empty, "other")


def test_null_unit_meets_null_key_and_sorts_last(spark):
    df = inline_rows(spark, "unit string", [("b",), ("a",), (None,)])
    w = weights(spark, [("a", 1.0), ("b", 1.0), (None, 1.0)])
    got = report(concentration_test(df, "unit", w, replicates=9))
    assert got["most_concentrated"]["unit"] == "a" and got["most_concentrated"]["n_units"] == 3


def test_weights_are_normalised_over_present_units(spark):
    df = events(spark, {"A": 10, "B": 10})
    w = weights(spark, {"A": 1.0, "B": 1.0, "absent": 1000.0})
    assert report(concentration_test(df, "unit", w))["most_concentrated"]["expected"] == 10.0


def test_replicates_are_clamped():
    assert [x.clamp_replicates(n) for n in (-5, 0, 1, 500, 10**6)] == [1, 1, 1, 500, 9999]


def units_table(spark, k, n_total, group=0):
    rng = np.random.default_rng(3)
    w = rng.uniform(0.5, 2.0, k)
    e = n_total * w / w.sum()
    return inline_rows(
        spark, "group bigint, unit string, weight double, expected double, n_total bigint, fixed boolean",
        [(group, f"u{i:05d}", float(w[i]), float(e[i]), n_total, i == 7) for i in range(k)],
    )


def test_the_law_is_multinomial(spark, monkeypatch):
    units = units_table(spark, 400, 20000).unionByName(units_table(spark, 50, 3000, 1))
    drawn = x.null_statistics(units, 400, 1).toPandas()
    assert len(drawn) == 800
    rng = np.random.default_rng(9)
    for g, part in units.toPandas().groupby("group"):
        p, e = (part.weight / part.weight.sum()).to_numpy(), part.expected.to_numpy()
        z = (rng.multinomial(int(part.n_total.iloc[0]), p, size=400) - e) / np.sqrt(e)
        own = drawn[drawn.group == g]
        assert sorted(own.replicate) == list(range(400))
        for got, want in ((own.max_z, z.max(1)), (own.fixed_z, z[:, 7])):
            assert abs(got.mean() - want.mean()) < 5 * want.std() * (2 / 400) ** 0.5
            assert abs(got.std() / want.std() - 1) < 0.25
    keys = ["group", "replicate"]
    monkeypatch.setattr(x, "_CELLS", 1)
    again = x.null_statistics(units.repartition(7), 400, 1, n_units=450).toPandas()
    assert np.array_equal(drawn.sort_values(keys).to_numpy(), again.sort_values(keys).to_numpy())


def test_totals_are_kept(spark):
    """With one unit nothing can move; with equal ones no unit may gain what no other loses."""
    one = x.null_statistics(units_table(spark, 1, 77), 50, 3).toPandas()
    assert (one.max_z == 0).all() and len(one) == 50
    tree = x._Tree(5, 0, 1000, np.ones(x.LEAVES), 20)
    assert (sum(tree.totals(x.LEAVES + b) for b in range(x.LEAVES)) == 1000).all()


def test_pseudo_p_bounds(spark):
    nulls = inline_rows(spark, "group bigint, max_z double", [(0, float(i)) for i in range(99)])
    for t, want in ((1000.0, 0.01), (-1.0, 1.0), (98.0, 0.02)):
        observed = inline_rows(spark, "group bigint, t double", [(0, t)])
        assert x.pseudo_p_values(nulls, observed, "max_z", "p").first()["p"] == pytest.approx(want)
    with pytest.raises(ValueError):
        x.null_statistics(units_table(spark, 3, 10).limit(0), 9)


def test_declared_exposure(spark, tmp_path):
    weights(spark, {"A": 1.0, "B": 2.0}).write.parquet(str(tmp_path / "w.parquet"))
    entry = """{"dataset": "d", "columns": {"unit": {}, "free": {}, "flat": {}}, "exposures": {
      "unit": {"table": "w.parquet", "key": "key", "weight": "weight"}, "flat": {"uniform": true}}}"""
    catalog = catalog_from_entries(spark, [entry])
    df = events(spark, {"A": 3, "B": 2}).select("unit", F.col("unit").alias("free"), F.col("unit").alias("flat"))
    run = lambda c: declared_concentration_test(df, catalog, "d", c, str(tmp_path)).first()
    assert run("unit")["exposure_model"] == "declared:w.parquet"
    assert run("free")["exposure_model"] == "abstention"
    assert run("flat")["exposure_model"] == "uniform:declared"
    with pytest.raises(ValueError):
        run("other")


def test_exposure_scan_reads_two_columns(spark, tmp_path):
    path = str(tmp_path / "e.parquet")
    spark.range(5).selectExpr("id AS k", "id * 2 AS w", "'x' AS other").write.parquet(path)
    plan = exposure_table(spark.read.parquet(path), "k", "w")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<k:bigint,w:bigint>" in plan
