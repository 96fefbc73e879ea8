"""Exact top-k by inner product through a pivot-distance index.

Every vector gets one coordinate more, so that all have the same length M; a query gets 0 there. Then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, and the largest inner products are the smallest distances. Vectors are
keyed by their nearest pivot and their distance to it, sorted, and cut into annuli. By the triangle inequality
no vector of an annulus is nearer to the query than the query's distance to the pivot lies outside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.session import settle

PIVOTS = 64
ANNULUS_ROWS = 2048
QUERY_BLOCK_BYTES = 16 << 20
_LONG = 2**63 - 1
_EXACT = float(2**53)
_INDEX = (
    "pivot int, lo double, hi double, n int, ids binary, vectors binary,"
    " query_ids binary, query_vectors binary, query_bounds binary"
)


def scaled(vector: Column, scale: int) -> Column:
    """Each component as floor(scale * x), a whole number held as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("double"))


def usable(vector: Column) -> Column:
    """Not null, and neither null nor infinite nor NaN in any component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All inner products of whole-number rows, exact; beyond 64 bits they stop at the largest long."""
    reach = max(np.abs(left).max(initial=0), 1) * max(np.abs(right).max(initial=0), 1) * max(left.shape[1], 1)
    if reach < _EXACT:
        return (left @ right.T).astype(np.int64)
    whole = lambda rows: np.array([[int(v) for v in row] for row in rows], object).reshape(rows.shape)
    return np.clip(whole(left) @ whole(right).T, -_LONG, _LONG).astype(np.int64)


def _matrix(raw: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(-1, width)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of a row: highest score first, then the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _rows(column, width: int) -> np.ndarray:
    """A list column as a matrix; shorter vectors are filled with zeros."""
    lists = column.to_pylist()
    out = np.zeros((len(lists), width))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def build_index(keyed: DataFrame, width: int, pivots: np.ndarray, length2: float, k: int) -> DataFrame:
    """Annuli of vectors, one per row, settled: `keyed` has (vec_id, vector, is_query).

    Each row also holds the queries among its vectors with a lower bound of their k-th score: the k-th best
    within their own annulus.
    """

    def lifted(rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(length2 - (rows * rows).sum(1), 0))

    def assign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        up = lifted(pivots)
        for batch in batches:
            rows = _rows(batch.column("vector"), width)
            near = 2 * length2 - 2 * (rows @ pivots.T + np.outer(lifted(rows), up))
            pivot = near.argmin(1)
            distance = np.sqrt(np.maximum(near[np.arange(len(rows)), pivot], 0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("is_query"),
                    pa.array(pivot, pa.int32()),
                    pa.array(distance, pa.float64()),
                    pa.array([r.tobytes() for r in rows], pa.binary()),
                ],
                ["vec_id", "is_query", "pivot", "distance", "vector"],
            )

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = None
        held: list[tuple] = []

        def annulus():
            ids = np.array([h[0] for h in held], np.int64)
            asks = np.array([h[1] for h in held], bool)
            vectors = _matrix([h[4] for h in held], width)
            bounds = np.full(int(asks.sum()), -_LONG, np.int64)
            if len(bounds) and len(ids) > k:
                scores = inner_products(vectors[asks], vectors)
                scores[ids[asks][:, None] == ids[None, :]] = -_LONG
                bounds = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
            row = (
                held[0][2], held[0][3], held[-1][3], len(held), ids.tobytes(), vectors.tobytes(),
                ids[asks].tobytes(), vectors[asks].tobytes(), bounds.tobytes(),
            )
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)

        schema = pa.schema(
            [("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int32())]
            + [(c, pa.binary()) for c in ("ids", "vectors", "query_ids", "query_vectors", "query_bounds")]
        )
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "is_query", "pivot", "distance", "vector"))):
                if held and (held[0][2] != row[2] or len(held) == ANNULUS_ROWS):
                    yield annulus()
                    held.clear()
                held.append(row)
        if held:
            yield annulus()

    placed = keyed.mapInArrow(assign, "vec_id bigint, is_query boolean, pivot int, distance double, vector binary")
    order = ["pivot", "distance", F.xxhash64("vec_id")]
    return settle(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, _INDEX))


def search_block(index: DataFrame, queries: tuple, width: int, pivots: np.ndarray, length2: float, k: int) -> DataFrame:
    """One block of queries against all annuli: the best of each task, (query_id, query, vec_id, score).

    `queries` is (ids, vectors, lower bounds of the k-th score), of bounded size, so it is broadcast. A task
    takes its annuli in the order of their distance bounds and skips, for each query, those whose bound
    cannot reach its k-th score so far.
    """
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        query_ids, vectors, bounds = sent.value
        norms = (vectors * vectors).sum(1)
        far = np.sqrt(np.maximum(norms[:, None] + length2 - 2 * vectors @ pivots.T, 0))
        floors = bounds.copy()
        # Rounding in the distances must not cost a candidate.
        slack = 1e-9 * (norms + length2) + 1
        best_scores = [np.empty(0, np.int64)] * len(query_ids)
        best_ids = [np.empty(0, np.int64)] * len(query_ids)
        for batch in batches:
            pivot, lo, hi = (np.array(batch.column(c).to_pylist()) for c in ("pivot", "lo", "hi"))
            outside = np.maximum(0, np.maximum(far[:, pivot] - hi, lo - far[:, pivot]))
            reach = (norms[:, None] + length2 - outside * outside) / 2 + slack[:, None]
            for j in np.argsort(outside.sum(0), kind="stable"):
                open_ = np.flatnonzero(reach[:, j] >= floors)
                if not len(open_):
                    continue
                ids = np.frombuffer(batch.column("ids")[int(j)].as_py(), np.int64)
                rows = _matrix([batch.column("vectors")[int(j)].as_py()], width)
                scores = inner_products(vectors[open_], rows)
                for i, own in zip(open_, scores):
                    near = np.flatnonzero((own >= floors[i]) & (ids != query_ids[i]))
                    if len(near):
                        s = np.concatenate([best_scores[i], own[near]])
                        v = np.concatenate([best_ids[i], ids[near]])
                        kept = _best(s, v, k)
                        best_scores[i], best_ids[i] = s[kept], v[kept]
                        if len(kept) == k:
                            floors[i] = max(floors[i], s[kept][-1])
        counts = [len(s) for s in best_scores]
        if sum(counts):
            nth = np.repeat(np.arange(len(query_ids)), counts)
            arrays = [query_ids[nth], nth, np.concatenate(best_ids), np.concatenate(best_scores)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], ["query_id", "query", "vec_id", "score"])

    return index.select("pivot", "lo", "hi", "ids", "vectors").mapInArrow(search, "query_id bigint, query bigint, vec_id bigint, score bigint")


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, n_pivots: int = PIVOTS) -> DataFrame:
    """The k highest integer inner products of each query: (query_id, rank, vec_id, score).

    Queries are the rows for which `is_query` holds, candidates all rows with another `vec_id`. Components become
    floor(scale * x). Ties go to the smaller `vec_id`; repeated rows are candidates of their own, repeated
    queries count once per distinct vector. Rows with a null id, a null vector or a null or non-finite component
    take no part; shorter vectors count as filled with zeros. Scores beyond a long stop at its ends.
    With fewer than k candidates all are returned; an empty table gives no row. Only `vec_id` and `embedding`
    are read.

    Building the index and collecting the queries' blocks run jobs at once. Queries are taken in blocks of
    16 MB, each against all annuli; nothing else is broadcast but the pivots.
    """
    good = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    keyed = good.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        scaled(F.col("embedding"), scale).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
    )
    length2 = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    facts = keyed.agg(F.max(F.size("vector")).alias("width"), F.max(length2).alias("length2")).first()
    out = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not facts["width"]:
        return vectors.sparkSession.createDataFrame([], out)
    width, longest = facts["width"], facts["length2"]
    chosen = keyed.select("vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()
    pivots = np.zeros((len(chosen), width))
    for i, row in enumerate(chosen):
        pivots[i, : len(row["vector"])] = row["vector"]
    pivots = np.unique(pivots, axis=0)
    index = build_index(keyed, width, pivots, longest, k)

    asked = index.where(F.length("query_ids") > 0).select("query_ids", "query_vectors", "query_bounds")
    most = max(1, QUERY_BLOCK_BYTES // (8 * width))
    results: list[DataFrame] = []

    def search(rows: list[tuple]) -> None:
        ids, near, bounds = (np.concatenate(x) for x in zip(*rows))
        _, first = np.unique(np.column_stack([ids, near]), axis=0, return_index=True)
        block = (ids[first], near[first], bounds[first])
        found = search_block(index, block, width, pivots, longest, k)
        results.append(found.withColumn("block", F.lit(len(results))))

    held: list[tuple] = []
    for row in asked.toLocalIterator():
        ids = np.frombuffer(bytes(row["query_ids"]), np.int64)
        held.append((ids, _matrix([bytes(row["query_vectors"])], width), np.frombuffer(bytes(row["query_bounds"]), np.int64)))
        if sum(len(h[0]) for h in held) >= most:
            search(held)
            held = []
    if held:
        search(held)
    if not results:
        return vectors.sparkSession.createDataFrame([], out)
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    best = Window.partitionBy("query_id", "block", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
