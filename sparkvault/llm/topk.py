"""Exact top-k inner-product search by columnar branch and bound (operator 1).

Vectors lie in vertical layout: one array per dimension over a block of
candidates. A query takes the dimensions block by block, those where the
queries have most mass first, and adds up integer products. What the
remaining dimensions can still add is bounded by the product of the remaining
norms (Cauchy-Schwarz); candidates whose upper bound is below the k-th best
lower bound are dropped and the columns compacted. The survivors' sums are
exact.

Blocks of queries meet blocks of candidates in tasks of a bounded size; each
task returns k rows for each query, and a second, small pass takes the best k
of those.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a candidate block and of a query block.
CANDIDATES, QUERIES = 16_384, 8_192
#: Dimensions taken at once.
DIM_BLOCK = 8


def quantized(vectors: DataFrame, key: str, embedding: str, scale: int = 1024) -> DataFrame:
    """(id long, v array<long>): floor(scale * x) of every component x as double.

    Rows whose id or vector is null, or whose vector is empty or holds a null
    or non-finite component, are left out.
    """
    v = F.col("v")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
        .filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & whole)
        .select("id", F.transform(v, lambda x: F.floor(x * scale)).alias("v"))
    )


def search_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Each query's best k rows but itself: (query position, id, score), by falling score and rising id."""
    dims = queries.shape[1]
    order = np.argsort(-np.abs(queries).sum(axis=0), kind="stable")
    by_id = np.argsort(ids, kind="stable")
    ids = ids[by_id]
    columns = np.ascontiguousarray(rows[by_id].T[order])
    queries = queries[:, order]
    starts = list(range(0, dims, DIM_BLOCK)) + [dims]

    def rest(m: np.ndarray) -> np.ndarray:
        """Norms over the dimensions from each start on, rounded up."""
        squares = np.cumsum(m[..., ::-1].astype(np.float64) ** 2, axis=-1)[..., ::-1]
        return np.stack([np.sqrt(squares[..., s]) * (1 + 1e-9) if s < dims else np.zeros(m.shape[:-1]) for s in starts])

    rows_rest, queries_rest = rest(columns.T), rest(queries)
    at, found, scores = [], [], []
    for i, q in enumerate(queries):
        alive = np.flatnonzero(ids != query_ids[i])
        cols, partial = columns, np.zeros(len(alive), np.int64)
        compact = None  # columns of the survivors, from the next dimension on
        for b, (first, last) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            block = cols[first:last] if compact is None else compact[: last - first]
            sums = q[first:last] @ block
            partial = partial + (sums[alive] if compact is None else sums)
            if last == dims:
                break
            if compact is not None:
                compact = compact[last - first :]
            if len(alive) > k:
                slack = queries_rest[b + 1, i] * rows_rest[b + 1, alive]
                near = partial.astype(np.float64)
                floor = np.partition(near - slack, len(alive) - k)[len(alive) - k]
                # Sums above 2^53 are rounded here; what the rounding can hide stays in.
                keep = near + slack >= floor - 1 - 1e-12 * (np.abs(near) + slack + abs(floor))
                if keep.mean() < 0.75:
                    compact = (columns[last:, alive[keep]] if compact is None else compact[:, keep])
                    alive, partial = alive[keep], partial[keep]
        best = np.lexsort((alive, -partial))[:k]
        at.append(np.full(len(best), i))
        found.append(ids[alive[best]])
        scores.append(partial[best])
    return np.concatenate(at), np.concatenate(found), np.concatenate(scores)


def _search(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    empty = pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = table.column("v").combine_chunks()
        flat = v.flatten().to_numpy(zero_copy_only=False)
        return table.column("id").to_numpy(), flat.reshape(len(v), -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        query_ids, queries = matrix(left)
        ids, rows = matrix(right)
        if float(np.abs(queries).max()) * float(np.abs(rows).max()) * queries.shape[1] >= 2.0**62:
            queries, rows = queries.astype(object), rows.astype(object)
        at, found, scores = search_block(queries, query_ids, rows, ids, k)
        scores = [max(-(1 << 63), min((1 << 63) - 1, s)) for s in scores.tolist()]
        return pa.table({"query_id": query_ids[at], "vec_id": found, "score": pa.array(scores, pa.int64())})

    return run


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", embedding: str = "embedding", scale: int = 1024
) -> DataFrame:
    """(query_id, rank int from 1, vec_id, score): each query's k highest integer inner products.

    Candidates are all other rows of the query's dimension; ties go to the
    smaller id, fewer than k candidates give fewer rows. Rows that repeat an
    id are candidates each and no candidates of their own id. Components are
    64-bit integers, the nearest where 1024 times them is beyond; scores
    beyond 64 bits are returned as the nearest 64-bit number.
    """
    rows = quantized(vectors, key, embedding, scale)
    asked = quantized(vectors.filter(is_query), key, embedding, scale).dropDuplicates(["id"])
    n, n_asked = rows.count(), asked.count()
    row_blocks, query_blocks = math.ceil(n / CANDIDATES) or 1, math.ceil(n_asked / QUERIES) or 1
    each = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    dim = F.size("v").alias("dim")
    left = asked.select("id", "v", dim, F.pmod(F.xxhash64("id"), F.lit(query_blocks)).alias("qb"), each(row_blocks).alias("rb"))
    right = rows.select("id", "v", dim, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(row_blocks)).alias("rb"), each(query_blocks).alias("qb"))
    by = ("rb", "qb", "dim")
    near = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
