"""The language model: base scores and counts against plain ones, spelling as a distribution, scores that tell texts apart."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from plumbline.llm import context_mixing as cm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low) + ["\n"]


def documents():
    rng = random.Random(5)
    known = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 8))) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(known, k=rng.randint(1, 120)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "É Ü straße"), (1004, "L" * 5000), (1005, "L" * 5000 + " " + "m" * 65), (None, "no id"), (7, "same id"), (7, "same id")]
    held = [i for i in range(2000, 2300) if zlib.crc32(str(i).encode()) % 7 == 2]
    noise = [(i, "".join(rng.choices("qxzwvyu ", k=300))) for i in held[:20]]
    return rows + noise + [(i, " ".join(rng.choices(known[:3], k=300))) for i in held[20:30]]


def test_base_scores_and_counts(spark, monkeypatch):
    monkeypatch.setattr(cm, "BLOCK_BYTES", 1 << 14)
    monkeypatch.setattr(cm, "PAYLOAD_BYTES", 1 << 12)
    rows = documents()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n int").repartition(3)
    got = cm.score_documents(docs).collect()
    learned = Counter()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, text in rows:
        if not out(i):
            learned.update(tokens_of(text))
    n, v = sum(learned.values()), len(learned)
    want = []
    for i, text in rows:
        told = tokens_of(text)
        base = sum(math.log10((learned[t] + 1) / (n + v + 1)) for t in told)
        want.append((str(i), out(i), len(told), sum(learned[t] > 0 for t in told), n, round(base, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    # Held-out texts of known words are likelier, by byte, than noise; few words that come again are likelier than by their counts.
    bits = lambda rows: sum(r.bits_per_byte for r in rows) / len(rows)
    plain = [r for r in got if r.held_out and r.doc_id < 400]
    noise = [r for r in got if (r.doc_id or 0) >= 2000 and r.n_known < 30]
    again = [r for r in got if (r.doc_id or 0) >= 2000 and r.n_known >= 30]
    assert len(noise) == 20 and len(again) == 10 and bits(plain) < 0.7 * bits(noise)
    assert all(r.score > 0.4 * r.base_score for r in again)
    # Scores rest on the training texts and the document alone, not on how rows are dealt out.
    again = {str((r.doc_id, r.n_tokens)): r.score for r in cm.score_documents(docs.repartition(5)).collect()}
    assert all(abs(again[str((r.doc_id, r.n_tokens))] - r.score) < 1e-6 * abs(r.score) for r in got)


def test_empty_table_and_nothing_to_learn(spark):
    schema = "doc_id bigint, text string"
    assert cm.score_documents(spark.createDataFrame([], schema)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = cm.score_documents(spark.createDataFrame([(held, "some words")], schema)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    assert row.score < 0 and math.isfinite(row.score)


def test_byte_code_is_a_prefix_code():
    code = cm.ByteCode([k * k for k in range(256)])
    ways = {tuple(code.bits[a : a + n].tolist()) for a, n in zip(code.starts.tolist(), code.lengths.tolist())}
    assert len(ways) == 256 and sum(2.0 ** -len(w) for w in ways) == 1
    assert not any(w[:k] in ways for w in ways for k in range(1, len(w)))


def test_first_words_are_scored_as_by_hand():
    """A text's first block, bit by bit: mixed predictions, then the shares of spelling and dictionary."""
    keys, counts = [b"ab", b"abc", b"\n"], [5, 2, 3]
    code = cm.ByteCode([10 if chr(k) in "abc \n" else 0 for k in range(256)])
    speller = cm.Speller(code)
    rng = np.random.default_rng(1)
    tables = [rng.integers(-40, 40, 1 << log2).astype(np.int8) for _, log2 in cm.ORDERS]
    words = cm.Dictionary(keys, counts, speller, tables, 10, 3)
    *_, (score,), _ = cm.score_texts(words, [b"ab abc"])

    def predicted(before: bytes, node: int) -> float:
        total = 0.0
        for (order, log2), table in zip(cm.ORDERS, tables):
            context = 0
            for k in range(order):
                context = context << 8 | (before[-1 - k] if k < len(before) else 0)
            slot = context << 8 | node
            if 8 * (order + 1) > log2:
                slot = (slot * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - log2)
            total += cm.FIRST_WEIGHT * int(table[slot]) / cm.STRETCH
        return 1 / (1 + math.exp(-total))

    want = 0.0
    for at, key in enumerate([b"ab", b"abc", b"\n"]):
        told = cm.spelled(key)
        p = 1.0
        for k, byte in enumerate(told):
            for j in range(code.starts[byte], code.starts[byte] + code.lengths[byte]):
                one = predicted(told[:k], int(code.nodes[j]))
                p *= one if code.bits[j] else 1 - one
        spelling, dictionary, _ = cm.SHARES
        want += math.log10(spelling * p + dictionary * counts[keys.index(key)] / 10)
    assert abs(score - want) < 1e-4


def test_a_dictionary_spells_each_word_few_times_and_keeps_a_bits_predictions_together(monkeypatch):
    keys, calls, plain = [b"w%d" % k for k in range(50)] + [cm.END], [], cm.spelled
    monkeypatch.setattr(cm, "spelled", lambda key: (calls.append(key), plain(key))[1])
    code = cm.ByteCode([1] * 256)
    tables = [np.zeros(1 << log2, np.int8) for _, log2 in cm.ORDERS]
    words = cm.Dictionary(keys, [1] * len(keys), cm.Speller(code), tables, len(keys), len(keys))
    assert len(calls) <= 2 * len(keys)
    assert words.told.shape == (int(words.bits.sum()), len(tables))


def test_texts_are_packed_as_the_numbers_of_their_blocks_words(spark, monkeypatch):
    """Words are cut out and looked up once, when a block is gathered: its rows alone give back all words of its texts."""
    monkeypatch.setattr(cm, "BLOCK_BYTES", 1 << 14)
    monkeypatch.setattr(cm, "PAYLOAD_BYTES", 1 << 12)
    docs = spark.createDataFrame(documents(), "doc_id bigint, text string").repartition(3)
    blocks: dict[int, dict] = {}
    rows = cm.blocks_of(docs).collect()
    for r in rows:
        if r.payload is None:
            assert blocks.setdefault(r.block, {}).setdefault(r.number, (bytes(r.word), r.n)) == (r.word, r.n)
    assert len(blocks) > 3 and all(sorted(words) == list(range(len(words))) for words in blocks.values())
    told, learned = [], Counter()
    for r in rows:
        if r.payload is not None:
            for doc_id, units in zip(*cm.unpack_units(bytes(r.payload))):
                words = [blocks[r.block][k][0] for k in units.tolist()]
                told.append((str(doc_id), words))
                learned.update({(r.block, w): 0 for w in words} if cm.held_out(doc_id) else Counter((r.block, w) for w in words))
    assert all(learned[block, word] == n for block, words in blocks.items() for word, n in words.values())
    want = [(str(i), [u for t in tokens_of(text) for u in cm.units_of(t.encode())]) for i, text in documents()]
    assert sorted(told) == sorted(want)
