"""Content of catalog entries as hash trees over ranges of hashed keys.

A key belongs to the range that the first hexadecimal digits of its SHA-256 name: 65536 ranges, gathered in 256,
gathered in a root. A node's digest covers the labels and digests of its children in order, so it depends on the
content alone. A row holds the digests of one range (some 150 of ten million keys) or of 256 children, never
a whole dataset, and a changed key touches one node per level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import settle

# Hexadecimal digits that name a node, by level; the root has none, keys have all of theirs.
DIGITS = (0, 2, 4, 64)
KEYS = len(DIGITS) - 1
_NODE = ("dataset", "node")


def hashed_keys(merged: DataFrame) -> DataFrame:
    """(dataset, node, digest, n_chars): the lowest level, a row per key of (dataset, scope, name, value)."""
    key = F.concat_ws("/", "scope", "name")
    return merged.select(
        "dataset",
        F.sha2(key, 256).alias("node"),
        F.sha2(F.concat_ws("=", key, "value"), 256).alias("digest"),
        (F.length("value") + F.length("name")).cast("long").alias("n_chars"),
    )


def _above(nodes: DataFrame, digits: int) -> DataFrame:
    """Nodes of the level with so many digits from their children."""
    children = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: F.concat(c["node"], c["digest"]))
    return nodes.groupBy("dataset", F.substring("node", 1, digits).alias("node")).agg(
        F.sha2(F.array_join(children, ""), 256).alias("digest"), F.sum("n_chars").alias("n_chars")
    )


def roots(merged: DataFrame) -> DataFrame:
    """(dataset, node, digest, n_chars) of the roots; datasets without keys have none."""
    nodes = hashed_keys(merged)
    for digits in reversed(DIGITS[:-1]):
        nodes = _above(nodes, digits)
    return nodes


def entry_tree(merged: DataFrame) -> DataFrame:
    """(dataset, level, node, digest, n_chars): all nodes, roots at level 0, keys at level 3."""
    nodes = settle(hashed_keys(merged))
    levels = [_at(nodes, KEYS)]
    for level in range(KEYS - 1, -1, -1):
        nodes = settle(_above(nodes, DIGITS[level]))
        levels.append(_at(nodes, level))
    return _all(levels)


def updated_tree(tree: DataFrame, changes: DataFrame) -> DataFrame:
    """The tree after (dataset, scope, name, value) rows were written; a NULL value removes its key.

    Only nodes above a written key are hashed again. Each key is written once; a key that is removed without being
    there changes nothing, and a dataset whose last key goes has no nodes left.
    """
    written = settle(hashed_keys(changes.filter(F.col("value").isNotNull())))
    gone = hashed_keys(changes.withColumn("value", F.coalesce("value", F.lit("")))).select(*_NODE)
    nodes = tree.filter(F.col("level") == KEYS).drop("level").join(gone, [*_NODE], "left_anti").unionByName(written)
    nodes = settle(nodes)
    levels, touched = [_at(nodes, KEYS)], gone
    for level in range(KEYS - 1, -1, -1):
        touched = settle(touched.select("dataset", _start(level)).distinct())
        under = nodes.withColumn("_above", _start(level)).join(touched.withColumnRenamed("node", "_above"), ["dataset", "_above"], "left_semi")
        kept = tree.filter(F.col("level") == level).drop("level").join(touched, [*_NODE], "left_anti")
        nodes = settle(kept.unionByName(_above(under.drop("_above"), DIGITS[level])))
        levels.append(_at(nodes, level))
    return _all(levels)


def changed_keys(old: DataFrame, new: DataFrame) -> DataFrame:
    """(dataset, node, change) of keys that differ between two trees: added, removed or changed.

    Goes down from the roots and compares only what lies below nodes that differ.
    """
    below = None
    for level in range(KEYS + 1):
        sides = []
        for tree, name in ((old, "_old"), (new, "_new")):
            side = tree.filter(F.col("level") == level).select("dataset", "node", F.col("digest").alias(name))
            if below is not None:
                side = side.withColumn("_above", _start(level - 1)).join(below, ["dataset", "_above"], "left_semi").drop("_above")
            sides.append(side)
        differ = sides[0].join(sides[1], [*_NODE], "full").filter(~F.col("_old").eqNullSafe(F.col("_new")))
        below = settle(differ.select("dataset", F.col("node").alias("_above"))) if level < KEYS else None
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return differ.select("dataset", "node", change.alias("change"))


def _start(level: int) -> Column:
    return F.substring("node", 1, DIGITS[level]).alias("node")


def _at(nodes: DataFrame, level: int) -> DataFrame:
    return nodes.select("dataset", F.lit(level).alias("level"), "node", "digest", "n_chars")


def _all(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out
