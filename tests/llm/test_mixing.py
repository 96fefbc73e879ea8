"""Source mixing against targets filled by hand and quotients counted one by one."""

from __future__ import annotations

import random
import re
from collections import Counter

from plumbline.llm.mixing import mix_rows, mix_sources, row_hash, sainte_lague


def filled(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    names = sorted((s for s in sizes if s is not None), key=str) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, rest = sum(sizes.values()), {}, set(names)
    while rest:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = [s for s in rest if share[s] > most * sizes[s]]
        if not above:
            return target | share
        for s in above:
            target[s] = float(most * sizes[s])
            rest.discard(s)
    return target


def test_targets_and_bounds(spark):
    rng = random.Random(4)
    rows = []
    for i in range(700):
        source = rng.choices(["a", "b", "ä", "Z", None, "tiny"], [30, 8, 8, 4, 3, 1])[0]
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), source, 1))
    rows += [(None, "null id twice", "a", 1), (None, "null id twice", "a", 1), (1000, None, "b", 1), (1001, "\x0b\x0c \n", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    got = mix_sources(docs, shard_docs=64).collect()
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    text = {r[0]: r[1] for r in rows}
    source = {r[0]: r[2] for r in rows}
    for _, t, s, _ in rows:
        sizes[s] += len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    want = filled(sizes)
    for r in got:
        assert r.size == len(re.findall("[^\x20\x09-\x0d]+", text[r.doc_id] or ""))
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(16, 0.01 * want[s]), (s, taken[s], want[s])
    again = mix_sources(docs.repartition(5), shard_docs=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_equal_ids_are_dealt_to_many_shards(spark):
    rows = [(None, "one text", "a")] * 400 + [(None, f"text {i}", "a") for i in range(400)] + [(7, f"text {i}", "a") for i in range(400)]
    rows += [(10 + i, "more words than the others have", "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = mix_rows(docs, row_hash("doc_id", "source", "text"), shard_docs=50)
    assert "shard" in mixed.columns and mixed.count() == len(rows)
    assert max(r["count"] for r in mixed.groupBy("shard").count().collect()) <= 100
    assert mixed.select("key", "nth").distinct().count() == len(rows)


def test_quotients(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for g in range(12):
        votes = [rng.choice([0.0, 1.0, rng.random() * 100, 33.0]) for _ in range(rng.randrange(1, 9))]
        seats = rng.randrange(0, 60) if sum(votes) else 0
        held = [0] * len(votes)
        for _ in range(seats):
            k = max((i for i in range(len(votes)) if votes[i] > 0), key=lambda i: (votes[i] / (2 * held[i] + 1), -i))
            held[k] += 1
        for i, v in enumerate(votes):
            rows.append((g, i, v, seats))
            want[g, i] = held[i]
    table = spark.createDataFrame(rows, "g int, c int, vote double, seats bigint")
    got = {(r.g, r.c): r.won for r in sainte_lague(table, ["g"], "c", "vote", "seats", "won").collect()}
    assert got == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mix_sources(docs).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id bigint, text string, source string")
    assert sorted((r.doc_id, r.size, r.taken, r.target) for r in mix_sources(blank).collect()) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]
