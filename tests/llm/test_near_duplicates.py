"""Near duplicates against all pairs, with groups of copies, common passages and common shingles."""

from __future__ import annotations

import random
import re
from itertools import combinations

import pytest

from plumbline import session
from plumbline.llm import near_duplicates as nd
from plumbline.llm.components import merge_components

SCHEMA = "doc_id bigint, text string, component_id string, n string"


def brute(rows):
    low = {i: i + 32 for i in range(65, 91)}
    sets = []
    for _, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(low))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    node = {i: i for i, _ in rows if i is not None}

    def root(x):
        while node[x] != x:
            x = node[x]
        return x

    for (a, x), (b, y) in combinations([(i, s) for (i, _), s in zip(rows, sets) if i is not None and s], 2):
        if 100 * len(x & y) >= 80 * len(x | y):
            p, q = sorted((root(a), root(b)))
            node[q] = p
    return sorted(((i, len(s), root(i) if i is not None else None) for (i, _), s in zip(rows, sets)), key=str)


def corpus(seed, groups, per_group, alone):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    passage = rng.choices(words, k=60)
    rows = []
    for g in range(groups):
        base = rng.choices(words, k=rng.choice([5, 12, 60, 150]))
        for _ in range(per_group):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], [rng.choice(words)], [copy[k].upper(), rng.choice(words)]])
            rows.append(copy)
    for _ in range(alone):
        own = rng.choices(words, k=rng.randrange(1, 120))
        rows.append(own + passage if rng.random() < 0.5 else own)
    rng.shuffle(rows)
    return [(i * 7 % (len(rows) * 7), " ".join(r)) for i, r in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x") for i, t in rows], SCHEMA).repartition(5)


ODD = [(None, "no id but words enough to count"), (9001, None), (9002, ""), (9003, " \x0b\n"), (9004, "Few Words"), (9005, "few words"),
       (9006, "no id but words enough to count"), (9007, "É e"), (9008, "é e"), (9009, "word " * 3000), (9010, "word " * 20)]


def test_same_as_all_pairs(spark):
    rows = corpus(1, 25, 6, 120) + ODD + [(9006, "no id but words enough to count"), (9011, "another text with the id"), (9011, "Few words")]
    got = nd.near_duplicates(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_common_shingles(spark, monkeypatch):
    # Small bounds, so that groups of a hundred already are many, and blocks and fragments are several.
    monkeypatch.setattr(nd, "COMMON", 4)
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 2000)
    monkeypatch.setattr(nd, "FRAGMENT_SHINGLES", 3000)
    monkeypatch.setattr(nd, "LEADER_ROUNDS", 1)
    rows = corpus(2, 3, 60, 80)
    got = nd.near_duplicates(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty(spark):
    assert nd.near_duplicates(frame(spark, [(1, "x")]).limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    node = {x: x for e in edges for x in e}

    def root(x):
        while node[x] != x:
            x = node[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        node[q] = p
    labels = spark.createDataFrame([], "node bigint, component bigint")
    for part in (edges[:120], edges[120:]):
        labels = merge_components(labels, spark.createDataFrame(part, "a bigint, b bigint"))
    got = {r.node: r.component for r in labels.collect()}
    assert {x: got.get(x, x) for x in node} == {x: root(x) for x in node}


def test_tables_of_labels_are_few_files(spark):
    """However many partitions a shuffle has, labels are written by three tasks per core at most, and none is lost."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        edges = spark.range(1, 3001).selectExpr("id AS a", "(id - 1) div 3 * 3 + 1 AS b")
        found = merge_components(spark.createDataFrame([], "node bigint, component bigint"), edges)
        assert len(found.inputFiles()) <= 3 * spark.sparkContext.defaultParallelism
        assert sorted(map(tuple, found.collect())) == [(i, i - (i - 1) % 3) for i in range(1, 3001) if i % 3 != 1]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_all_tables_are_few_files(spark, monkeypatch):
    """However many partitions a shuffle has, no table of the search is more files than an eighth of them or three per core."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, files = {k: spark.conf.get(k) for k in held}, []
    plain = session.settle

    def counted(df):
        out = plain(df)
        files.append(len(out.inputFiles()))
        return out

    for module in (session, nd):
        monkeypatch.setattr(module, "settle", counted)
    docs = spark.range(400).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 30), k -> concat(id div 2, 'w', k))) AS text").repartition(64)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        groups = nd.near_duplicates(docs).select("doc_id", "component_id").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, groups)) == [(i, i // 2 * 2) for i in range(400)]
    # The first table, the signatures, has the files of its input.
    assert max(files[1:]) <= max(8, 3 * spark.sparkContext.defaultParallelism)
