"""Connected components by contraction: every round, components join their smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.session import settle_narrow

ROUNDS = 60


def merge_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """New labels (node, component) after adding edges (a, b); a component is named by its smallest node.

    Nodes that no edge has ever touched need no label: a missing label is the node itself. Each round maps the
    edges to components, lets every component follow its smallest neighbour, and shortens the paths. All steps are
    joins and partial minima, settled in the shared folder; nothing is collected but counts.
    """
    named = edges.select("a", "b").where("a <> b")

    def relabel(pairs: DataFrame, current: DataFrame, side: str) -> DataFrame:
        own = current.select(F.col("node").alias(side), F.col("component").alias("_new"))
        other = "b" if side == "a" else "a"
        return pairs.join(own, side, "left").select(F.coalesce("_new", side).alias(side), other)

    def contracted(pairs: DataFrame, current: DataFrame) -> DataFrame:
        moved = relabel(relabel(pairs, current, "a"), current, "b").where("a <> b")
        return settle_narrow(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    links = contracted(named, labels)
    for _ in range(ROUNDS):
        if links.isEmpty():
            return labels
        both = links.union(links.select("b", "a"))
        parents = settle_narrow(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("parent")).select(F.col("a").alias("node"), F.col("parent")))
        while True:
            above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_above"))
            # Roots are their own parents, so every parent is a node.
            jumped = settle_narrow(parents.join(above, "parent").select("node", F.col("parent").alias("_was"), F.col("_above").alias("parent")))
            moved = jumped.where("_was <> parent").isEmpty()
            parents = jumped.select("node", "parent")
            if moved:
                break
        followed = labels.join(parents.select(F.col("node").alias("component"), "parent"), "component", "left")
        old = followed.select("node", F.coalesce("parent", "component").alias("component"))
        fresh = parents.where("node <> parent").select("node", F.col("parent").alias("component"))
        labels = settle_narrow(old.unionByName(fresh.join(labels, "node", "left_anti")))
        links = contracted(links, parents.select("node", F.col("parent").alias("component")))
    raise RuntimeError(f"components not settled after {ROUNDS} rounds")
