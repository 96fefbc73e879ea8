"""Counts against exposure: expected values, standardised excess and random redistributions.

Every function works on a table of units with a `group` column (one test per group: a single one
for a categorical unit, one per resolution for cells), so all groups run in the same job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.stats import pseudo_p, std_excess
from plumbline.session import settle

# Default and largest number of replicates, significance level.
DEFAULT_REPLICATES = 999
MAX_REPLICATES = 9999
SIGNIFICANCE = 0.05

#: Blocks of the null model's tree, a power of two; and counts a task draws at once.
LEAVES = 1 << 10
_CELLS = 1 << 21
#: Units whose cumulative weights `hashed_redraws` takes.
REDRAWN_UNITS = 1 << 17


def clamp_replicates(n: int) -> int:
    return max(1, min(int(n), MAX_REPLICATES))


def unit_counts(df: DataFrame, unit: str) -> DataFrame:
    """(unit, observed); NULL is a unit."""
    return df.groupBy(F.col(unit).cast("string").alias("unit")).agg(
        F.count(F.lit(1)).alias("observed")
    )


def join_exposure(counts: DataFrame, exposure: DataFrame) -> DataFrame:
    """(unit, observed, weight); weight is NULL where no exposure is declared.

    Null-safe equality lets a NULL unit meet a NULL key. Both sides are aggregates; the
    join strategy is left to adaptive execution, which knows their sizes.
    """
    return (
        counts.alias("c")
        .join(exposure.alias("e"), F.expr("c.unit <=> e.key"), "left")
        .select("c.unit", "c.observed", "e.weight")
    )


def distinct_exposure(exposure: DataFrame) -> DataFrame:
    """(key, weight, copies): one row per key; more than one copy is an ambiguous declaration."""
    return exposure.groupBy("key").agg(
        F.max("weight").alias("weight"), F.count(F.lit(1)).alias("copies")
    )


def uniform_exposure(counts: DataFrame) -> DataFrame:
    return counts.withColumn("weight", F.lit(1.0))


def missing_exposure(counts: DataFrame, exposure: DataFrame) -> DataFrame:
    """Units without a declared weight."""
    return counts.alias("c").join(exposure.alias("e"), F.expr("c.unit <=> e.key"), "left_anti")


def bad_weights(exposed: DataFrame) -> DataFrame:
    """Units whose declared weight is zero or negative."""
    return exposed.filter(F.col("weight") <= 0)


def with_expected(exposed: DataFrame, group: str | None = None) -> DataFrame:
    """Add expected = N * w / sum(w) over the units present, and z = (O - E) / sqrt(E).

    The units are settled first, since they are read twice. The totals of an ungrouped table are two numbers
    and become part of the plan; those of groups are one row per group and are joined.
    """
    exposed = settle(exposed)
    sums = [F.sum("observed").alias("n_total"), F.sum("weight").alias("_w")]
    if group:
        out = exposed.join(exposed.groupBy(group).agg(*sums), group)
    else:
        totals = exposed.agg(*sums).first()
        n_total = F.lit(totals["n_total"]).cast(exposed.agg(sums[0]).schema[0].dataType)
        out = exposed.withColumn("n_total", n_total).withColumn("_w", F.lit(totals["_w"]).cast("double"))
    out = out.withColumn("expected", F.col("n_total") * (F.col("weight") / F.col("_w")))
    return out.withColumn(
        "z", std_excess(F.col("observed").cast("double"), F.col("expected"))
    ).drop("_w")


def argmax_units(tested: DataFrame, group: str | None = None) -> DataFrame:
    """(subject, unit, observed, expected, z): largest excess and largest count.

    Ties go to the first unit in ascending order, NULL last. Both are partial aggregations.
    """
    nulls_last = F.struct(F.col("unit").isNull().alias("a"), F.col("unit").alias("b"))
    row = F.struct("unit", "observed", "expected", "z")
    groups = [group] if group else []
    best = tested.groupBy(*groups).agg(
        F.min(F.struct((-F.col("z")).alias("s"), nulls_last.alias("u"), row.alias("row"))).alias("m"),
        F.min(
            F.struct((-F.col("observed")).cast("double").alias("s"), nulls_last.alias("u"), row.alias("row"))
        ).alias("r"),
    )
    return best.select(
        *groups,
        F.inline(
            F.array(
                F.struct(F.lit("most_concentrated").alias("subject"), F.col("m.row").alias("row")),
                F.struct(F.lit("highest_raw_count").alias("subject"), F.col("r.row").alias("row")),
            )
        ),
    ).select(*groups, "subject", "row.*")


def _excess(counts: np.ndarray, expected: np.ndarray) -> np.ndarray:
    safe = np.where(expected > 0, expected, 1.0)
    return np.where(expected > 0, (counts - expected) / np.sqrt(safe), 0.0)


def _draws(seed: int, *key: int) -> np.random.Generator:
    return np.random.default_rng([seed, *key])


class _Tree:
    """Totals of a group's blocks in all replicates, by halving: the same whichever block is asked for.

    Node 1 is the root and holds the whole total; nodes 2k and 2k+1 share what node k has, by a binomial draw over
    all replicates with a generator of its own. Leaf LEAVES + b is block b. Halves without weight get nothing.
    """

    def __init__(self, seed: int, group: int, total: int, weights: np.ndarray, replicates: int):
        self.seed, self.group, self.replicates, self.total = seed, group, replicates, total
        self.weights = np.zeros(2 * LEAVES)
        self.weights[LEAVES:] = weights
        for node in range(LEAVES - 1, 0, -1):
            self.weights[node] = self.weights[2 * node] + self.weights[2 * node + 1]
        # The last node split on each level with its halves' totals: blocks asked for in order split a node once.
        self.split: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}

    def totals(self, node: int) -> np.ndarray:
        if node == 1:
            return np.full(self.replicates, self.total, np.int64)
        above, level = node // 2, node.bit_length()
        if self.split.get(level, (0,))[0] != above:
            n, left = self.totals(above), self.weights[2 * above] / self.weights[above]
            taken = n if left == 1 else np.zeros_like(n) if left == 0 else _draws(self.seed, self.group, above).binomial(n, left)
            self.split[level] = above, taken, n - taken
        return self.split[level][1 + node % 2]


def null_statistics(
    units: DataFrame, replicates: int = DEFAULT_REPLICATES, seed: int = 42, n_units: int | None = None
) -> DataFrame:
    """(group, replicate, max_z, fixed_z) for multinomial redistributions of every group's total.

    `units` has group, unit, weight, expected, n_total and `fixed` (true for the one unit whose own
    excess is followed). One scheme for every number of units: units are hashed to LEAVES blocks, totals of blocks
    come from a binary tree of binomial draws, and counts inside a block are multinomial given its total, which
    together is the multinomial law. Draws are seeded by group and tree node, so neither the partitions nor the
    number of units decide them. Collected and broadcast are the blocks' weights, LEAVES per group at most.
    """
    if (units.isEmpty() if n_units is None else n_units == 0):
        raise ValueError("no units: the null distribution is undefined")
    marked = units.withColumn("block", F.pmod(F.xxhash64(F.col("unit").cast("string")), F.lit(LEAVES)).cast("int"))
    sums = marked.groupBy("group", "block").agg(F.sum("weight").alias("w"), F.max("n_total").alias("n_total"))
    trees = {}
    for g, part in sums.toPandas().groupby("group"):
        weights = np.zeros(LEAVES)
        # The order of a sum must not decide a draw.
        weights[part["block"].to_numpy()] = [float(f"{w:.12g}") for w in part["w"]]
        trees[int(g)] = int(part["n_total"].iloc[0]), weights
    shared = units.sparkSession.sparkContext.broadcast(trees)

    def block_excess(tree: _Tree, g: int, block: int, cells: pd.DataFrame) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest excess in the block, and that of the followed unit if it is here, per replicate."""
        n = tree.totals(LEAVES + int(block))
        p = cells["weight"].to_numpy(dtype=float)
        expected = cells["expected"].to_numpy(dtype=float)
        fixed = np.flatnonzero(cells["fixed"].to_numpy(dtype=bool))
        draw, step = _draws(seed, g, LEAVES + block), max(1, _CELLS // len(p))
        most, own = np.empty(replicates), np.empty(replicates)
        for k in range(0, replicates, step):
            part = n[k : k + step]
            z = _excess(draw.multinomial(part, p / p.sum()) if len(p) > 1 else part[:, None], expected)
            most[k : k + step] = z.max(1)
            own[k : k + step] = z[:, fixed[0]] if len(fixed) else 0
        return most, own if len(fixed) else None

    def redraw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees_here: dict[int, _Tree] = {}
        most: dict[int, np.ndarray] = {}
        own: dict[int, np.ndarray] = {}

        def add(cells: pd.DataFrame) -> None:
            for (g, block), part in cells.groupby(["group", "block"], sort=False):
                tree = trees_here.setdefault(g, _Tree(seed, g, *shared.value[g], replicates))
                top, followed = block_excess(tree, g, block, part)
                most[g] = top if g not in most else np.maximum(most[g], top)
                if followed is not None:
                    own[g] = followed

        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = (batch["group"] == batch["group"].iloc[-1]) & (batch["block"] == batch["block"].iloc[-1])
            # Rows come block by block; the last block of a batch may go on in the next one.
            held.append(batch[~last] if not last.all() else batch)
            if not last.all():
                add(pd.concat(held))
                held = [batch[last]]
        if held:
            add(pd.concat(held))
        for g, top in most.items():
            yield pd.DataFrame({"group": g, "replicate": np.arange(replicates), "max_z": top, "fixed_z": own.get(g)})

    cells = marked.select("group", "block", F.col("unit").cast("string").alias("unit"), "weight", "expected", "fixed")
    # A task takes adjacent blocks, so that it draws the upper nodes once. The number of tasks is given: rows are few
    # bytes and much work, and adaptive execution would join them by bytes. Within a block units stand in order, so
    # the draw does not depend on their arrival.
    spark = units.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    cells = cells.repartitionByRange(2 * tasks, "group", "block")
    cells = cells.sortWithinPartitions("group", "block", F.col("unit").asc_nulls_last())
    drawn = cells.mapInPandas(redraw, "group bigint, replicate bigint, max_z double, fixed_z double")
    return drawn.groupBy("group", "replicate").agg(F.max("max_z").alias("max_z"), F.max("fixed_z").alias("fixed_z"))


def pseudo_p_values(nulls: DataFrame, observed: DataFrame, stat: str, name: str) -> DataFrame:
    """(group, name): pseudo-p of each group's observed statistic `t`."""
    return (
        nulls.join(observed.select("group", "t"), "group")
        .groupBy("group")
        .agg(pseudo_p(F.col(stat), F.col("t")).alias(name))
    )


def hashed_redraws(
    events: DataFrame, key: str, exposure: DataFrame, replicates: int, seed: int = 42
) -> DataFrame:
    """(replicate, unit, n): every event picks a unit anew with probability w / sum(w).

    The pick compares md5(seed|replicate|key) with cumulative weights, so any SQL engine can
    repeat it. The work is events * replicates hashes: use it to check a test against SQL, and
    `null_statistics` for the test itself. `exposure` holds at most REDRAWN_UNITS units.
    """
    if exposure.count() > REDRAWN_UNITS:
        raise ValueError("too many units for per-event redraws; use null_statistics")
    upto = Window.orderBy(F.col("key").asc_nulls_last())
    everyone = Window.partitionBy()
    spans = exposure.select(
        "key",
        (F.sum("weight").over(upto) - F.col("weight")).alias("lo"),
        F.sum("weight").over(upto).alias("hi"),
        F.sum("weight").over(everyone).alias("total"),
    )
    # A draw meets the few units whose span touches its slice of [0, 1), by equality of the slice.
    slices = 1024
    first = F.floor(F.col("lo") / F.col("total") * slices) - 1
    last = F.floor(F.col("hi") / F.col("total") * slices) + 1
    sliced = spans.select(
        F.col("key").alias("unit"), "lo", "hi", "total", F.explode(F.sequence(first, last)).alias("slice")
    )
    text = F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(key).cast("string"))
    uniform = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    draws = (
        events.select(key, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
        .select("replicate", uniform.alias("u"))
        .withColumn("slice", F.floor(F.col("u") * slices))
    )
    at = F.col("u") * F.col("total")
    picked = draws.join(sliced, "slice").filter((at >= F.col("lo")) & (at < F.col("hi")))
    return picked.groupBy("replicate", "unit").agg(F.count(F.lit(1)).alias("n"))
