"""Copies of test items against an alignment of every pair, cell by cell."""

from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings, strategies as st

from plumbline.llm.decontamination import Items, Lookup, align, candidates, contaminated
from plumbline.llm.shingles import PlainWords

WORDS = [f"word{i}" for i in range(900)] + ["the", "of", "and"] * 40


def slow(item, text):
    above, best = [0] * (len(text) + 1), 0
    for a in item:
        row = [0]
        for j, b in enumerate(text):
            row.append(max(0, above[j] + (2 if a == b else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(1, 4), min_size=1, max_size=20))
def test_alignment(item, text):
    score, end = align(np.array(item, np.uint64), np.array(text, np.uint64))
    assert score == slow(item, text) and 0 <= end <= len(text)


def plain(text):
    return [w for w in (x.strip(".,;:!?\"'`()[]{}<>*_-") for x in (text or "").lower().split()) if w]


def test_same_as_all_pairs(spark):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(14, 50)))) for i in range(30)]
    docs = []
    for i in range(300):
        words = rng.choices(WORDS, k=rng.randrange(0, 250))
        if i % 3 == 0:
            copy = items[i % 30][1].split()
            if i % 2:
                for k in range(rng.randrange(3), len(copy), 6):
                    copy[k] = rng.choice(WORDS)
            if i % 5 == 0:
                copy = [w.capitalize() + "," for w in copy]
            at = rng.randrange(len(words) + 1)
            words[at:at] = copy
        docs.append((i, " ".join(words), 1))
    docs += [(None, items[3][1], 1), (900, None, 1), (901, "", 1), (902, "word1 " * 100000 + items[4][1], 1), (903, items[5][1], 1), (903, items[5][1], 1)]
    odd = [(100, None, 2), (101, "", 2), (102, "two words", 2), (None, items[6][1], 2), (7, items[7][1], 2)]
    found = contaminated(
        spark.createDataFrame(docs, "doc_id bigint, text string, item_id int").repartition(4),
        spark.createDataFrame([(i, t, 2) for i, t in items] + odd, "item_id bigint, text string, doc_id int"),
    ).collect()
    want = []
    for d, text, _ in docs:
        own = plain(text)
        for i, item in items + [(None, items[6][1]), (7, items[7][1])]:
            asked = plain(item)
            if d == 902 and i != 4:
                continue
            part = own[-200:] if d == 902 else own
            if own and (score := slow(asked, part)) >= len(asked):
                want.append((d, i, score))
    assert sorted(((r.doc_id, r.item_id, r.score) for r in found), key=str) == sorted(want, key=str)
    planted = {i for i in range(0, 300, 3)}
    assert planted <= {r.doc_id for r in found if r.doc_id is not None}


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert contaminated(docs, none).count() == 0
    assert contaminated(docs.limit(0), spark.createDataFrame([(1, "a b c d")], "item_id bigint, text string")).count() == 0


def spoiled(rng, words):
    """Edits every one to three words: other words, inserted ones, words left out; some stay above half of the score."""
    out, step = [], rng.randrange(2, 4)
    for i, w in enumerate(words):
        kind = rng.choice(["other", "more", "none"]) if i % step == step - 1 else ""
        out += {"other": ["else"], "more": [w, "more"], "none": []}.get(kind, [w])
    return out


@settings(deadline=None, max_examples=300)
@given(st.integers(0, 1 << 30), st.integers(3, 9))
def test_no_alignment_without_candidate(seed, kinds):
    rng = random.Random(seed)
    items = [[f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(3, 14))] for _ in range(4)]
    texts = []
    for _ in range(5):
        copy = spoiled(rng, rng.choice(items))
        texts.append([f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(4))] + copy + ["x"] * rng.randrange(60) + copy[:3])
    held = Items([(k, " ".join(w).encode()) for k, w in enumerate(items)], 3, 0.5)
    held.keep_rare(np.array([rng.choice([0, 1, 90]) for _ in held.distinct]))
    words = PlainWords()
    own = [words.of(" ".join(t).encode()) for t in texts]
    told, ends = np.concatenate(own), np.cumsum([len(w) for w in own])
    best = {(t, k): max(align(held.words[k], told[a:b])[0] for a, b in s) for t, k, s in candidates(held, Lookup(held.distinct), told, ends)}
    for t, text in enumerate(own):
        for k, item in enumerate(held.words):
            if (score := slow(item, text)) >= len(item):
                assert best[t, k] == score


def test_edits_everywhere_and_common_half(spark):
    rng = random.Random(5)
    template = [f"t{i}" for i in range(12)]
    items = [[f"i{k}x{j}" for j in range(20)] for k in range(4)] + [template + [f"own{k}x{j}" for j in range(13)] for k in range(4)]
    docs = [
        [w if i % 3 != 2 else "else" for i, w in enumerate(items[0])],
        [x for i, w in enumerate(items[0]) for x in ([w, "more"] if i % 2 else [w])],
        [x for w in items[1] for x in (w, "more")][:-1],
        template + [w if i % 3 != 2 else "else" for i, w in enumerate(items[5][12:])],
        template + [w if i % 2 else "else" for i, w in enumerate(items[6][12:])],
        *(spoiled(rng, rng.choice(items)) for _ in range(60)),
        *(["before"] * (i % 5) + template + [f"d{i}x{j}" for j in range(9)] for i in range(300)),
    ]
    found = contaminated(
        spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id bigint, text string"),
        spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string"),
    ).collect()
    want = {(d, k): score for d, text in enumerate(docs) for k, item in enumerate(items) if (score := slow(item, text)) >= len(item)}
    assert {(0, 0), (1, 0), (2, 1), (3, 5), (4, 6)} <= set(want)
    assert {(r.doc_id, r.item_id): r.score for r in found} == want and len(found) == len(want)


def test_items_of_one_and_two_words_match_word_for_word(spark):
    docs = spark.createDataFrame(
        [(1, "A Blue, whale sings."), (2, "whale blue and more blue"), (3, "the blue sky"), (None, "blue whale"), (5, None), (6, "zymurgy")], "doc_id bigint, text string"
    )
    items = spark.createDataFrame([(1, "blue whale"), (2, "Zymurgy!"), (3, ""), (4, None), (5, "...")], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id, r.similarity, r.end_word) for r in contaminated(docs, items).collect()}
    assert found == {(1, 1, 1.0, 3), (None, 1, 1.0, 2), (6, 2, 1.0, 1)}
