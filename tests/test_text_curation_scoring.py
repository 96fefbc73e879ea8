"""Extraction, curation, scoring and preparation on small golden cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import shorten, spaced_json, spaced_json_length
from plumbline.operators import curation as c
from plumbline.operators import extraction as x
from plumbline.operators import prepare, scoring
from plumbline.operators.session_metrics import attribution_totals, output_attribution, session_outline
from plumbline.sources.local import inline_rows


def texts(spark, *values):
    return inline_rows(spark, "id int, text string", list(enumerate(values)))


# --- extraction ------------------------------------------------------------------------------------


def test_observations_of_clean_and_wrapped_arrays(spark):
    df = texts(
        spark, '[{"claim": "rivers rise", "statut": "fait"}]',
        'My list:\n```\n[{"claim": "rain falls", "statut": "hypothèse", "note": null},\n\n{"claim": "snow stays", "statut": "refusé", "nature": "cold"}]\n``` end',
    )
    got = [(r["id"], r["position"], r["claim"], r["statut"], r["nature"]) for r in x.observations(df, "text").collect()]
    assert sorted(got) == [(0, 0, "rivers rise", "fait", None), (1, 0, "rain falls", "hypothèse", None), (1, 1, "snow stays", "refusé", "cold")]


@pytest.mark.parametrize(
    "text,reason",
    [
        ("no list here", "no_array"), ("[1, 2]", "no_array"), ('[{"claim": }]', "bad_json"),
        ('[{"claim": "dusk", "statut": "maybe"}]', "bad_observation"), ('[{"statut": "fait"}]', "bad_observation"),
        ('[{"claim": 5, "statut": "fait"}]', "bad_observation"),
        ('[{"claim": "a", "statut": "fait", "note": 3}]', "bad_observation"),
        ('[{"claim": "dawn", "statut": "fait"}, {"claim": "noon", "statut": 0}]', "bad_observation"),
    ],
)
def test_rejected_texts(spark, text, reason):
    assert x.rejected_texts(texts(spark, text), "text").first()["reason"] == reason
    assert x.observations(texts(spark, text), "text").count() == 0


# A turn is prose, illustrations in fences of their own, and one payload fence. Every payload stands at every
# place; what must come out follows from the rule, not from a list of cases.
DELTAS = (None, {"owner": "north"}, {}, "see above", [1])
ASKED = (None, [{"n": 7, "why": "?"}], [], {"n": 7})
FLAGS = (True, False, 0, "soon", None)
BROKEN = ("[3, 4]", '{"open": 1', "plain: words", '{"a": 1} and more')
AROUND = (("Alpha beta.\n", ""), ("", "\nGamma delta.\n"), ("Alpha.\n", "\nDelta.\n"), ("Look:\n```ini\nk = v\n```\nThen.\n", ""))


def turn_cases():
    """(text, message, delta, completes, questions)."""
    payloads = [
        {"fiche_delta": DELTAS[i % 5], "questions": ASKED[i % 4], "proposes_completion": FLAGS[i % 5 - i % 3]} for i in range(20)
    ]
    payloads += [{}, {"unknown": 1}, {"message": "told inside", "proposes_completion": True}]
    for number, payload in enumerate(payloads):
        for before, after in AROUND:
            text = f"{before}```json\n{json.dumps(payload)}\n```{after}"
            outside = before.replace("```ini\nk = v\n```", "")
            message = f"{outside}\n{after}".strip()
            delta, questions = payload.get("fiche_delta"), payload.get("questions")
            row = (
                message, delta if isinstance(delta, dict) and delta else None, bool(payload.get("proposes_completion")),
                questions if isinstance(questions, list) and questions else None,
            )
            yield (text, *row)
            if "ini" not in before and number % 4 == 0 and not after:
                yield (text.replace("\n", "\r\n"), *row)
    yield '```json\n{"message": "told inside"}\n```', "told inside", None, False, None
    for body in BROKEN:
        text = f"Alpha.\n```json\n{body}\n```"
        yield text, text, None, False, None
    yield " nothing but prose ", "nothing but prose", None, False, None
    early, late = json.dumps({"proposes_completion": True}), json.dumps({"proposes_completion": False})
    yield f"```json\n{early}\n```\nthen\n```json\n{late}\n```", "then", None, False, None


def test_turns(spark):
    cases = list(turn_cases())
    df = inline_rows(spark, "case int, text string", [(i, c[0]) for i, c in enumerate(cases)])
    for r in x.parsed_turns(df, "text").collect():
        read = [json.loads(r[k]) if r[k] else None for k in ("fiche_delta", "questions")]
        assert (r["message"], read[0], r["proposes_completion"], read[1]) == cases[r["case"]][1:], cases[r["case"]]


def test_spaced_json_as_python_writes_it(spark):
    values = [{"a": "x, y: \"z\" \\", "b": [1, 2.5, None, True]}, [], {"é": {"k": "l\nm"}}]
    df = inline_rows(spark, "j string", [(json.dumps(v, ensure_ascii=False, separators=(",", ":")),) for v in values])
    got = df.select(spaced_json(F.col("j")).alias("s"), spaced_json_length(F.col("j")).alias("n")).collect()
    want = [json.dumps(v, ensure_ascii=False) for v in values]
    assert [(r["s"], r["n"]) for r in got] == [(w, len(w)) for w in want]


@pytest.mark.parametrize("size", [3_000, 60_000, 1_000_000])
def test_spaced_json_of_very_long_strings(spark, size):
    values = ["x" * size, '"\\\n' * (size // 10), {"a": "y:," * (size // 3), "b": [1, "z" * size]}]
    texts = [json.dumps(v, separators=(",", ":")) for v in values]
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    got = df.select(spaced_json(F.col("j")).alias("s"), spaced_json_length(F.col("j")).alias("n")).collect()
    for value, row in zip(values, got):
        assert row["s"] == json.dumps(value)
        assert row["n"] == len(row["s"])


def test_attribution_and_outline_of_very_long_texts(spark):
    long = "w" * 1_000_000
    turn = "Said.\n```json\n" + json.dumps({"message": "m", "questions": [{"number": 1, "text": long}]}) + "\n```\n"
    nodes = spark.createDataFrame(
        [
            ("s#1", "s", 1, "s#0", "agent_turn", json.dumps({"text": turn}), "{}"),
            ("s#2", "s", 2, "s#0", "tool_call", json.dumps({"name": "look", "input": {"q": long}}), "{}"),
        ],
        "id string, session_id string, seq bigint, parent_id string, kind string, content string, meta string",
    )
    attributed = output_attribution(nodes)
    (row,) = attributed.collect()
    assert row["questions"] == len(json.dumps([{"number": 1, "text": long}]))
    assert attribution_totals(attributed).first()["questions"] == row["questions"]
    sessions = spark.createDataFrame([("s", "open", None, None)], "session_id string, status string, question string, model string")
    lines = {r["line_no"]: r["line"] for r in session_outline(sessions, nodes).collect()}
    assert lines[1].startswith('  ├─ 🔧 look({"q": "www') and lines[1].endswith("…)")



def test_shorten(spark):
    df = texts(spark, "a" * 101, "a" * 100, " b\n\t c ")
    got = [r[0] for r in df.orderBy("id").select(shorten(F.col("text"))).collect()]
    assert got == ["a" * 99 + "…", "a" * 100, "b c"]


# --- curation --------------------------------------------------------------------------------------


def merged(spark, *deltas):
    rows = [("d", i, json.dumps(v) if not isinstance(v, str) else v) for i, v in enumerate(deltas)]
    df = inline_rows(spark, "dataset string, seq bigint, delta string", rows)
    return c.merge_deltas(df.repartition(2))


def as_entry(df):
    out = {"columns": {}}
    for r in df.collect():
        target = out["columns"] if r["scope"] == "column" else out
        target[r["name"]] = json.loads(r["value"])
    return out


def test_merge_keeps_earlier_columns_and_takes_last_values(spark):
    got = as_entry(
        merged(
            spark, {"titre": "old", "columns": {"a": {"type": "numeric"}, "b": {"type": "x"}}},
            {"columns": {"b": {"type": "categorical"}}}, {}, {"columns": ["a", "b"], "titre": "new"}, "[1]", "no json",
        )
    )
    assert got == {"titre": "new", "columns": {"a": {"type": "numeric"}, "b": {"type": "categorical"}}}


def test_inventory_is_sorted(spark):
    r = c.inventory(merged(spark, {"columns": {"zeta": {}, "alpha": {}, "mu": {}}, "titre": "t"})).first()
    assert (r["n_columns"], r["columns"]) == (3, "alpha, mu, zeta")
    assert c.inventory(merged(spark, {"titre": "t"})).first()["n_columns"] == 0


def asked(spark, *batches):
    rows = [("s", i, j, json.dumps(q)) for i, qs in enumerate(batches) for j, q in enumerate(qs)]
    return c.merge_questions(inline_rows(spark, "session_id string, seq bigint, pos int, question string", rows))


def test_questions_merge_by_number_and_keep_their_place(spark):
    out = asked(spark, [{"n": 1, "e": "old"}, {"n": 2}, "text", 42], [{"c": "free"}, {"n": 1, "e": "new"}], [{"n": None}, {"n": "1"}])
    got = [(r["position"], r["n"], json.loads(r["question"])) for r in out.orderBy("position").collect()]
    assert [q for _, _, q in got] == [{"n": 1, "e": "new"}, {"n": 2}, {"c": "free"}, {"n": None}, {"n": "1"}]
    assert [p for p, _, _ in got] == [1, 2, 3, 4, 5]
    assert [n for _, n, _ in got] == ["1", "2", None, None, "1"]


def test_numbers_and_texts_are_told_apart(spark):
    out = asked(spark, [{"n": 2}, {"n": 2.0, "again": 1}, {"n": "2"}, {"n": 2.5}])
    assert [(r["n"], r["n_kind"]) for r in out.orderBy("position").collect()] == [("2", "number"), ("2", "text"), ("2.5", "number")]


def test_answers_and_completeness(spark):
    full = {"n": 1, "constat": "c", "enjeu": "e", "options": {"a": "x"}}
    q = asked(spark, [full, {"n": 2, "constat": ""}, {"constat": "c"}])
    answers = inline_rows(spark, "session_id string, n string, reponse string", [("s", "1", "1a"), ("s", "9", "none asked")])
    got = [tuple(r)[3:] for r in c.question_completeness(c.attach_answers(q, answers)).orderBy("position").collect()]
    assert got == [("", True, True), ("constat,enjeu,options", False, False), ("enjeu,options", False, False)]


def test_hash_ignores_write_order_and_writes_are_idempotent(spark, tmp_path):
    one = merged(spark, {"titre": "t", "columns": {"a": {"y": 1, "x": 2}}})
    two = merged(spark, {"columns": {"a": {"x": 2, "y": 1}}}, {"titre": "t"})
    assert c.entry_hash(one).first()["hash"] == c.entry_hash(two).first()["hash"]
    path = str(tmp_path / "v")
    assert c.write_versions(one, path).first()["version"] == 1
    assert c.write_versions(two, path).count() == 0
    other = merged(spark, {"titre": "u"})
    assert c.write_versions(other, path).first()["version"] == 2
    assert c.write_versions(one, path).first()["version"] == 3  # back to older content is a change
    assert spark.read.parquet(f"{path}/versions").count() == 3


def test_coverage_wants_whole_words(spark):
    entry = merged(spark, {"titre": "wind_north then Sea-level, and area (km2)", "columns": {"Tide_low": {"sens": "as HighTide"}}})
    names = ["wind", "wind_north", "Tide", "HighTide", "Sea", "area (km2)", "area (ha)"]
    df = inline_rows(spark, "dataset string, name string", [("d", n) for n in names])
    assert sorted(r["name"] for r in c.uncovered_names(entry, df).collect()) == ["Tide", "area (ha)", "wind"]
    r = c.coverage(entry, df).first()
    assert (r["n_names"], r["n_covered"]) == (7, 4)


def test_conformity(spark):
    entry = merged(spark, {"dataset": "d", "extra": 1, "columns": {"a": {"sens": "s", "type": "t", "pieges": []}, "ghost": "text"}})
    r = c.conformity(entry, inline_rows(spark, "dataset string, name string", [("d", "a"), ("d", "b")])).first()
    assert r["missing_keys"] == "grain,perimetre,pieges_transversaux,points_non_tranches,referentiels,titre"
    assert (r["extra_keys"], r["ghost_columns"], r["fields"], r["fields_conform"]) == ("extra", "ghost", "pieges,sens,type", True)
    assert (r["n_columns"], r["n_not_objects"]) == (2, 1)


# --- scoring ---------------------------------------------------------------------------------------

OBS = [
    (0, "BE est un excès réel", "fait"), (0, "ABE excès", "fait"), (1, "BE n'est pas un excès", "fait"),
    (1, "BE: point chaud", "hypothèse"), (2, "ZH excès, pseudo-p = 1", "fait"), (2, "le VOLUME baisse : routes plus sûres", "fait"),
    (3, "trou dans la série", "fait"), (4, "Trou", "refusé"),
]


def test_scores(spark):
    obs = inline_rows(spark, "run int, claim string, statut string", OBS)
    runs = scoring.runs_matching(obs, {"gap": scoring.has_keyword(["trou"], ["fait"]), "BE": scoring.asserted_excess("BE")})
    assert {r["check"]: r["n"] for r in runs.collect()} == {"gap": 1, "BE": 1}
    bad = scoring.observations_matching(
        obs, {"safer": scoring.mentions_both(scoring.SAFETY_TERMS, scoring.TREND_TERMS), "ZH": scoring.asserted_excess("ZH")}
    )
    assert {r["check"]: r["n"] for r in bad.collect()} == {"safer": 1, "ZH": 0}
    limits = inline_rows(spark, "check string, at_least bigint, at_most bigint", [("gap", 4, None), ("BE", 1, None), ("none", None, 0)])
    assert {r["check"]: r["passed"] for r in scoring.threshold_gate(runs, limits).collect()} == {"gap": False, "BE": True, "none": True}


def test_truth_manifest(spark):
    measured = inline_rows(spark, "metric string, value double", [("n", 4314.0), ("rate", 0.0025), ("share", 0.5)])
    manifest = inline_rows(
        spark, "metric string, expected double, tolerance double, mode string",
        [("n", 4314.0, 0.0, "equal"), ("rate", 0.002, 0.001, "near"), ("share", 0.482, 0.0, "min"), ("gone", 1.0, 0.0, "equal")],
    )
    got = {r["metric"]: r["holds"] for r in scoring.check_truth(measured, manifest).collect()}
    assert got == {"n": True, "rate": True, "share": True, "gone": False}


# --- preparation -----------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 17, 999, 1000, 5000])
def test_sample_has_its_size_and_does_not_depend_on_partitions(spark, n):
    df = spark.range(1000).withColumnRenamed("id", "k")
    one = sorted(r["k"] for r in prepare.fixed_size_sample(df, "k", n).collect())
    two = sorted(r["k"] for r in prepare.fixed_size_sample(df.repartition(9), "k", n).collect())
    assert one == two and len(one) == min(n, 1000)


def test_planting_rates(spark):
    df = spark.range(20000)
    r = df.select(prepare.planted_sentinel(F.col("id"), 1, 0.05).alias("v")).agg(
        F.avg((F.col("v") == 999).cast("double")), F.count_if(F.col("v").isin(*prepare.ORDINARY_VALUES, 999))
    ).first()
    assert abs(r[0] - 0.05) < 0.01 and r[1] == 20000


def test_derived_exposure_divides_the_second_largest(spark):
    df = inline_rows(spark, "u string", [("a",)] * 9 + [("b",)] * 8 + [("c",)] * 3)
    got = {r["unit"]: (r["exposure"], r["role"]) for r in prepare.derive_exposure(df, "u").collect()}
    assert got == {"a": (9, "false_hotspot"), "b": (2, "true_hotspot"), "c": (3, "ordinary")}
    tiny = inline_rows(spark, "u string", [("a",)] * 3 + [("b",)])
    assert {r["unit"]: r["exposure"] for r in prepare.derive_exposure(tiny, "u").collect()} == {"a": 3, "b": 1}
