"""Spans against plain expressions; contexts find what has no base form, and leave other texts alone."""

from __future__ import annotations

import hashlib
import random
import re

from hypothesis import given, settings, strategies as st

from plumbline.llm.personal_data import KINDS, base_spans, find_personal_data, luhn


def slow(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@settings(deadline=None, max_examples=500)
@given(st.text("ab@.@..1234567890-- ()++%_é", max_size=80))
def test_base_spans(text):
    assert base_spans(text) == slow(text)


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_bootstrapping(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choices(["ka", "lo", "mi", "terdan", "usven", "or"], k=n))
    docs = []
    for i in range(60):
        docs.append(f"{filler(9)} phone: +1 (555) {200 + i}-{1000 + 7 * i} {filler(5)} reach me {filler(1)}{i}@mail.example.com {filler(3)}")
    planted = [
        (f"{filler(6)} phone: 555-201-4477 {filler(4)}", "555-201-4477", "phone"),
        (f"{filler(6)} reach me jo.doe [at] mail [dot] example {filler(4)}", "jo.doe [at] mail [dot] example", "email"),
    ]
    clean = [f"{filler(8)} order 555-201-4477 {filler(4)}", f"{filler(8)} phone {filler(2)}", f"{filler(4)} reach me {filler(3)}"]
    rows = [(i, t, "x") for i, t in enumerate([*docs, *(p[0] for p in planted), *clean])]
    rows += [(None, "a@b.cc", "x"), (900, None, "x"), (901, "", "x"), (902, "ka " * 300000 + "10.1.2.3", "x"), (902, "9" * 200000, "x")]
    got = find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string, spans string").repartition(3)).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, _ in rows}
    for r in got:
        if r.doc_id == 902:
            continue
        base = slow(text[r.doc_id] or "")
        joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(filter(None, joined.split(","))) <= set(spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in spans) for k in KINDS]
        assert r.n_added == len(spans) - len(base)
        if r.doc_id is not None and r.doc_id < 62 and r.doc_id >= 60:
            string, kind = planted[r.doc_id - 60][1:]
            at = text[r.doc_id].index(string)
            assert f"{kind}:{at}:{at + len(string)}" in spans
        else:
            assert r.n_added == 0
    assert {(r.n_ip, r.spans) for r in got if r.doc_id == 902} == {(1, "ip:900000:900008"), (0, "")}
    assert find_personal_data(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
