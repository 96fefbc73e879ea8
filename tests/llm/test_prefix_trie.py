"""The prefix trie against a plain version, with shards of any size."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import prefix_trie as trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain_version(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r or '')}:{r or ''}{x or ''}".encode()).digest(), r or "", x or ""))
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = [t[3:] for t in sorted(own.get(head, []))[:h] + sorted(own[c])[h:]]
    members, children = defaultdict(list), defaultdict(int)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(convs) - 1) * len(WORD.findall(node[-1][1])) if node else 0
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(rebuilt[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        yield min(convs), len(node), parent, len(convs), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()


def found(spark, rows, shard_turns):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", depth int").repartition(3)
    return sorted(map(str, (tuple(r) for r in trie.conversation_trie(df, shard_turns).collect())))


@pytest.mark.parametrize("shard_turns, chunk, ids", [(1 << 15, 1 << 14, 1 << 16), (5, 3, 8)])
def test_same_as_plain_version(spark, monkeypatch, shard_turns, chunk, ids):
    monkeypatch.setattr(trie, "IDS_BYTES", ids)
    monkeypatch.setattr(trie, "CHUNK_TURNS", chunk)
    rng = random.Random(3)
    rows = [(None, 0, "a", "b")] * 3
    for c in range(-30, 120):
        if c % 7 == 3:
            continue
        # A third of all conversations begin alike or are alike; turns repeat, are null, and are equal.
        for t in range(rng.choice([0, 1, 2, 3, 6, 9])):
            text = "the same" if c % 3 == 0 and t < 4 else rng.choice(["x y", "z", None, "", " q  r ", "é"])
            rows.append((c, rng.choice([t, t, None, 1]), rng.choice(["user", "a", None]), text))
    assert found(spark, rows, shard_turns) == sorted(map(str, plain_version(rows)))


def test_empty_and_turnless(spark):
    assert found(spark, [], 5) == []
    # Conversation 5 drops its only turn and finds no other.
    assert zlib.crc32(b"5") % 4 > 0
    rows = [(5, 0, "user", "alone")]
    assert found(spark, rows, 5) == sorted(map(str, plain_version(rows)))


def test_a_long_conversation(spark):
    rows = [(20, t, "user", f"turn {t % 7}") for t in range(400)] + [(21, t, "user", f"turn {t % 5}") for t in range(250)]
    assert found(spark, rows, 1 << 6) == sorted(map(str, plain_version(rows)))


@pytest.mark.parametrize("n, numbers, longest", [(300, 5, 6), (2000, 2000, 4), (5000, 9000, 3), (0, 1, 1)])
def test_double_arrays_tell_all_sequences_apart(n, numbers, longest):
    rng = random.Random(n)
    told = sorted({tuple(min(numbers, 1 + int(rng.expovariate(3 / numbers))) for _ in range(rng.randint(0, longest))) for _ in range(n)})
    sequences = [np.array(s, np.int64) for s in told]
    array = trie.DoubleArray(sequences)
    ends = {}
    for rows, states, _ in array.steps(sequences):
        ends |= dict(zip(rows.tolist(), states.tolist()))
    assert len(set(ends.values())) == len(sequences)
    for k, state in ends.items():
        path = []
        while state:
            above = int(array.check[state])
            path.append(state - int(array.base[above]))
            state = above
        assert tuple(reversed(path)) == told[k]
