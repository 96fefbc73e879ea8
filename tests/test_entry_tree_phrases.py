"""Hash trees of entries and the phrase index against plain versions."""

from __future__ import annotations

import hashlib
import random
import re

from plumbline.operators import curation as c
from plumbline.operators.entry_tree import changed_keys, entry_tree, updated_tree
from plumbline.operators.phrases import found_names
from plumbline.session import settle

_ENTRY = "dataset string, scope string, name string, value string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(content):
    """Every node by name, from {(dataset, scope, name): value}."""
    nodes = {}
    for (dataset, scope, name), value in content.items():
        nodes[dataset, 3, sha(f"{scope}/{name}")] = sha(f"{scope}/{name}={value}"), len(name) + len(value)
    for level, digits in ((2, 4), (1, 2), (0, 0)):
        under = {}
        for (dataset, at, node), told in nodes.items():
            if at == level + 1:
                under.setdefault((dataset, level, node[:digits]), []).append((node, *told))
        for key, children in under.items():
            nodes[key] = sha("".join(n + d for n, d, _ in sorted(children))), sum(size for *_, size in children)
    return nodes


def as_nodes(tree):
    rows = tree.collect()
    out = {(r["dataset"], r["level"], r["node"]): (r["digest"], r["n_chars"]) for r in rows}
    assert len(out) == len(rows)
    return out


def frame(spark, content):
    return spark.createDataFrame([(*k, v) for k, v in content.items()], _ENTRY)


def some_content(draw, n):
    return {
        (draw.choice("abc"), draw.choice(["root", "column"]), f"k{draw.randint(0, 3 * n)}"): "é" * draw.randint(0, 3) + str(draw.random())
        for _ in range(n)
    }


def test_tree_and_updates_equal_the_plain_tree(spark):
    draw = random.Random(3)
    content = some_content(draw, 700)
    tree = settle(entry_tree(frame(spark, content)))
    assert as_nodes(tree) == plain_tree(content)
    assert as_nodes(entry_tree(frame(spark, content).repartition(7))) == plain_tree(content)
    hashes = {r["dataset"]: (r["hash"], r["n_chars"]) for r in c.entry_hash(frame(spark, content)).collect()}
    assert hashes == {d: told for (d, level, _), told in plain_tree(content).items() if level == 0}
    # Old keys with other values, new keys, a new dataset, keys that go, one that was never there.
    gone = draw.sample(sorted(content), 40)
    changes = {k: "new" for k in draw.sample(sorted(content), 30)} | some_content(draw, 30) | {("d", "root", "first"): ""}
    changes |= {k: None for k in gone} | {("a", "root", "never there"): None}
    after = {k: v for k, v in (content | changes).items() if v is not None}
    new = settle(updated_tree(tree, frame(spark, changes)))
    assert as_nodes(new) == plain_tree(after)
    got = {(r["dataset"], r["node"]): r["change"] for r in changed_keys(tree, new).collect()}
    want = {}
    for k in content.keys() | after.keys():
        if content.get(k) != after.get(k):
            want[k[0], sha(f"{k[1]}/{k[2]}")] = "added" if k not in content else "removed" if k not in after else "changed"
    assert got == want and {"added", "removed", "changed"} == set(got.values())


def test_a_changed_key_touches_one_node_per_level(spark):
    content = {("a", "root", f"k{i}"): str(i) for i in range(2000)}
    before, after = plain_tree(content), as_nodes(updated_tree(settle(entry_tree(frame(spark, content))), frame(spark, {("a", "root", "k7"): "x"})))
    assert sorted(level for (_, level, _), told in after.items() if before.get(("a", level, _)) != told) == [0, 1, 2, 3]


def test_empty_trees(spark):
    empty = spark.createDataFrame([], _ENTRY)
    one = {("a", "root", "k"): "v"}
    assert as_nodes(entry_tree(empty)) == {} and c.entry_hash(empty).collect() == []
    assert as_nodes(updated_tree(entry_tree(empty), frame(spark, one))) == plain_tree(one)
    assert as_nodes(updated_tree(entry_tree(frame(spark, one)), frame(spark, {("a", "root", "k"): None}))) == {}
    assert changed_keys(entry_tree(empty), entry_tree(empty)).collect() == []


def plainly_found(name, text):
    word = "[0-9A-Za-z_]"
    return bool(name) and re.search(f"(?<!{word}){re.escape(name)}(?!{word})", text) is not None


def test_phrases_like_a_search_of_every_text(spark):
    draw = random.Random(8)
    letters = ["a", "b", "a1", "_", " ", " ", "-", "%", "é", "(", ")", "\\", "$", ".", "\n", "💧"]

    def run(longest):
        return "".join(draw.choice(letters) for _ in range(draw.randint(0, longest)))

    texts = [(draw.choice("xy"), run(60)) for _ in range(150)] + [("x", None), (None, "a b"), ("x", "")]
    texts += texts[:20]
    names = []
    for _ in range(900):
        dataset, text = draw.choice(texts)
        start = draw.randint(0, 40)
        cut = (text or "")[start : start + draw.randint(0, 9)]
        names.append((dataset, draw.choice([cut, cut, run(4), cut + run(1)])))
    names += [("x", None), ("x", ""), ("z", "a"), *names[:30]]
    held: dict = {}
    for dataset, text in texts:
        if dataset is not None and text is not None:
            held.setdefault(dataset, []).append(text)
    want = {(d, n) for d, n in names if n and d in held and any(plainly_found(n, t) for t in held[d])}
    schema = "dataset string, {} string"
    rows = found_names(spark.createDataFrame(names, schema.format("name")), spark.createDataFrame(texts, schema.format("text"))).collect()
    got = {tuple(r) for r in rows}
    assert got == want and len(rows) == len(got)
    kinds = {len(re.findall("[0-9A-Za-z_]+", n)) for _, n in want}
    assert kinds >= {0, 1, 2, 3} and len({(d, n) for d, n in names if n} - want) > 100


def test_phrases_in_long_texts_and_empty_tables(spark):
    texts = spark.createDataFrame([("x", "lot " * 100_000 + "unit price (CHF)/m2" + " lot" * 1000)], "dataset string, text string")
    names = spark.createDataFrame([("x", n) for n in ("unit price (CHF)/m2", "price (CHF", "price  (CHF)", "lot lot lot unit", "nit price", ")/")], "dataset string, name string")
    assert {r["name"] for r in found_names(names, texts).collect()} == {"unit price (CHF)/m2", "price (CHF", "lot lot lot unit"}
    assert found_names(names.limit(0), texts).collect() == [] and found_names(names, texts.limit(0)).collect() == []


def test_no_pattern_runs_over_pairs(spark):
    texts = spark.createDataFrame([("x", "a-b")], "dataset string, text string")
    names = spark.createDataFrame([("x", "a-b")], "dataset string, name string")
    plan = found_names(names, texts)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "RLIKE" not in plan


def test_names_and_words_are_not_broadcast(spark, tmp_path):
    """Sizes estimated from files are far below those of the words in them, so no join may rest on them."""
    merged = spark.createDataFrame([("x", "column", "a", '"b c-d"')], "dataset string, scope string, name string, value string")
    names = spark.createDataFrame([("x", n) for n in ("a", "c-d", "e", "-")], "dataset string, name string")
    for name, df in (("merged", merged), ("names", names)):
        df.write.parquet(f"{tmp_path}/{name}")
    merged, names = spark.read.parquet(f"{tmp_path}/merged"), spark.read.parquet(f"{tmp_path}/names")
    uncovered = c.uncovered_names(merged, names)
    covered = c.coverage(merged, names)
    for df in (uncovered, covered):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in uncovered.collect()} == {("x", "e"), ("x", "-")}
    assert [tuple(r) for r in covered.collect()] == [("x", 4, 2)]
