"""Fill-in-middle against a plain version, with pieces of any size."""

from __future__ import annotations

import hashlib
import re

import pytest

from plumbline.llm import fill_in_middle as fim

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text, rate=50, spm=80):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    told = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(told[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    plain = not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate
    form = "plain" if plain else "spm" if h[3] % 100 < spm else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, n, form, None if plain else len(p), None if plain else len(m), digest(out), digest(text)


def documents(spark):
    texts = [
        None, "", " ", "\n\t ", "one", " one", "one ", "a <P> b", "x<S", "<S y>", "é ü ß 日本 語", "w " * 5000, "z" * 300_000, "\x85no blank here\x1c",
    ]
    rows = [(k, texts[k % len(texts)], 1) for k in range(140)] + [(None, t, 2) for t in texts] + [(7, "again and again", 3)] * 25 + [(7, "the same id", 4)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, n int").repartition(4)


@pytest.mark.parametrize("units, size", [(4096, 1 << 16), (3, 7)])
def test_same_as_plain_version(spark, monkeypatch, units, size):
    monkeypatch.setattr(fim, "PIECE_UNITS", units)
    monkeypatch.setattr(fim, "PIECE_BYTES", size if units > 3 else 4096)
    rows, docs = documents(spark)
    found = sorted(map(str, (tuple(r) for r in fim.fill_in_middle(docs).collect())))
    assert found == sorted(str(plain_version(i, t)) for i, t, _ in rows)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_other_rates(spark):
    rows, docs = documents(spark)
    found = sorted(map(str, (tuple(r) for r in fim.fill_in_middle(docs, rate=100, spm=0).collect())))
    assert found == sorted(str(plain_version(i, t, 100, 0)) for i, t, _ in rows)


def test_pieces_follow_one_another(spark, monkeypatch):
    monkeypatch.setattr(fim, "PIECE_UNITS", 2)
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k))) for k in range(40)], "doc_id bigint, text string")
    pieces = fim.assembled(fim.pieces_of(docs)).collect()
    outputs: dict = {}
    for p in pieces:
        have, doc = outputs.setdefault(bytes(p["row"]), (b"", None))
        outputs[bytes(p["row"])] = have + bytes(p["piece"]), p["doc_id"] if p["position"] == 0 else doc
    digests = {doc: hashlib.sha256(text).hexdigest() for text, doc in outputs.values()}
    assert digests == {k: plain_version(k, t)[5] for k, t in docs.collect()}
