"""Exact interpolated quantiles without holding a column's values in one task.

Small inputs (row count checked) use Spark's `percentile`, which keeps a value -> count map. Larger
ones are narrowed in two passes:

1. approximate percentiles give cut points around every wanted quantile; each gap between cuts is
   divided into equal slots and rows are counted per slot (a few thousand counters per column);
2. cumulative slot counts name, for every wanted rank, the one slot that holds it. Only rows of
   those slots are grouped by value and ranked.

The slot number never decreases with the value, so the result is exact whatever the quality of the
approximate cuts; good cuts only make the ranked remainder small.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.local import inline_rows

PROFILE_PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)
MAP_ROWS = 1 << 17
_SLOTS = 1024
_ACCURACY = 5000
_MARGIN = 0.001


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float] = PROFILE_PROBS,
    map_rows: int = MAP_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """(column, prob, quantile) for every numeric column; NULL where a column has no values."""
    columns, probs = list(columns), list(probs)
    n = df.count() if rows is None else rows
    if n <= map_rows:
        return _by_map(df, columns, probs)
    bounds = df.agg(
        *[cut_points(F.col(c).cast("double"), probs).alias(f"b{i}") for i, c in enumerate(columns)]
    ).first()
    return quantiles_by_slots(df, columns, probs, bounds)


def _by_map(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    wide = df.agg(
        *[
            F.percentile(F.col(c).cast("double"), F.array(*[F.lit(p) for p in probs])).alias(f"q{i}")
            for i, c in enumerate(columns)
        ]
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(p).alias("prob"),
            F.element_at(f"q{i}", j + 1).alias("quantile"),
        )
        for i, c in enumerate(columns)
        for j, p in enumerate(probs)
    ]
    return wide.select(F.inline(F.array(*rows)))


def cut_points(value: Column, probs: Sequence[float] = PROFILE_PROBS) -> Column:
    """Aggregate: struct(n, lo, hi, cuts) that the narrowing path starts from."""
    around = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-_MARGIN, _MARGIN)})
    return F.struct(
        F.count(value).alias("n"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
        F.percentile_approx(value, around, _ACCURACY).alias("cuts"),
    )


def _slot(edges: list[float]) -> str:
    """SQL for gap * _SLOTS + slot inside the gap of `v`; both parts never decrease with v."""
    cases = []
    for gap in reversed(range(len(edges) - 1)):
        left, width = edges[gap], edges[gap + 1] - edges[gap]
        left_sql, width_sql = (f"CAST('{x!r}' AS DOUBLE)" for x in (left, width))
        inside = "0"
        if width > 0 and math.isfinite(width):
            inside = f"LEAST(FLOOR((v - {left_sql}) / {width_sql} * {_SLOTS}), {_SLOTS - 1})"
        cases.append(f"WHEN v >= {left_sql} THEN {gap * _SLOTS} + {inside}")
    return f"CAST(CASE {' '.join(cases)} ELSE 0 END AS INT)"


def quantiles_by_slots(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], bounds: Sequence
) -> DataFrame:
    """The narrowing path; `bounds` are the collected `cut_points` of the columns, in order."""
    columns, probs = list(columns), list(probs)
    spark = df.sparkSession
    value = [F.col(c).cast("double") for c in columns]
    edges: dict[int, list[float]] = {}
    ranks: list[tuple[int, float, int, float]] = []
    for i in range(len(columns)):
        b = bounds[i]
        if b.n == 0:
            continue
        edges[i] = sorted({b.lo, b.hi, *b.cuts})
        if len(edges[i]) == 1:
            edges[i] = [b.lo, b.lo]
        for p in probs:
            position = p * (b.n - 1)
            low = math.floor(position)
            ranks.append((i, p, low, position - low))
    empty = [(c, p) for i, c in enumerate(columns) if i not in edges for p in probs]

    # One narrow scan per column, which reads the same bytes of a columnar file as one wide scan and
    # keeps the generated code of each small.
    def long(keep: dict[int, list[int]] | None = None) -> DataFrame:
        rows = None
        for i, e in edges.items():
            part = df.select(F.lit(i).alias("c"), value[i].alias("v")).filter(F.col("v").isNotNull())
            part = part.withColumn("slot", F.expr(_slot(e)))
            if keep is not None:
                part = part.filter(F.col("slot").isin(keep[i]))
            rows = part if rows is None else rows.unionByName(part)
        return rows

    out = inline_rows(
        spark, "column string, prob double, quantile double", [(c, p, None) for c, p in empty]
    )
    if not edges:
        return out

    # Slot counts are at most (cuts + 1) * _SLOTS rows per column, whatever the table size.
    counts: dict[int, list[tuple[int, int]]] = {}
    for row in long().groupBy("c", "slot").count().collect():
        counts.setdefault(row["c"], []).append((row["slot"], row["count"]))
    wanted: dict[tuple[int, int], set[int]] = {}
    plan = []
    for i, p, low, frac in ranks:
        first = _locate(counts[i], low)
        second = _locate(counts[i], low + 1) if frac > 0 else first
        plan.append((i, p, frac, *first, *second))
        for slot, offset in (first, second):
            wanted.setdefault((i, slot), set()).add(offset)

    slots = {i: [slot for c, slot in wanted if c == i] for i in edges}
    upto = Window.partitionBy("c", "slot").orderBy("v")
    ranked = (
        long(slots)
        .groupBy("c", "slot", "v")
        .count()
        .withColumn("last", F.sum("count").over(upto))
        .withColumn("first", F.col("last") - F.col("count"))
    )
    picks = inline_rows(
        spark,
        "c int, slot int, at bigint",
        [(c, slot, offset) for (c, slot), offsets in wanted.items() for offset in offsets],
    )
    found = ranked.join(F.broadcast(picks), ["c", "slot"]).filter(
        (F.col("at") >= F.col("first")) & (F.col("at") < F.col("last"))
    )
    targets = inline_rows(
        spark,
        "c int, column string, prob double, frac double, s1 int, o1 bigint, s2 int, o2 bigint",
        [(i, columns[i], p, frac, s1, o1, s2, o2) for i, p, frac, s1, o1, s2, o2 in plan],
    )
    one, two = found.alias("one"), found.alias("two")
    joined = (
        targets.alias("t")
        .join(one, F.expr("t.c = one.c and t.s1 = one.slot and t.o1 = one.at"))
        .join(two, F.expr("t.c = two.c and t.s2 = two.slot and t.o2 = two.at"))
        .select("t.column", "t.prob", F.expr("one.v + (two.v - one.v) * t.frac").alias("quantile"))
    )
    return joined.unionByName(out) if empty else joined


def _locate(slots: list[tuple[int, int]], rank: int) -> tuple[int, int]:
    """The slot holding the zero-based rank, and the rank inside that slot."""
    seen = 0
    for slot, n in sorted(slots):
        if rank < seen + n:
            return slot, rank - seen
        seen += n
    raise ValueError("rank beyond the counted rows")
