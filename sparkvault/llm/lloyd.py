"""Centroid clustering by dimension-sharded Lloyd iterations (operator 12).

The kept vectors are cut into column blocks: a block holds the same few
dimensions (a shard) of a few thousand vectors. A round has two passes over
the blocks. First, each column block gives its exact partial distances to the
shard's slice of the centroids; the partial distances of the same vectors are
added and the nearest centroid taken. Then each column block adds up its
components by those centroids, and a shard's sums and counts give its next
slice of the centroids. Only partial distances, assignments and the sums of
one slice are ever moved; no task sees whole vectors after the cut.

All arithmetic is on integers. Blocks with components beyond 2^24 compute on
Python's integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkvault.llm._common import materialize

#: Vectors of a block, and dimensions of a shard.
BLOCK_ROWS, SHARD_DIMS = 8_192, 16
#: Components up to which 64-bit integers hold the distances of any dimension count below 2^13.
SMALL = 1 << 24
#: What a distance or inertia beyond 64 bits is returned as.
MOST = (1 << 63) - 1

Centroids = list[list[int]]


def kept_vectors(vectors: DataFrame, key: str, embedding: str, scale: int, dims: int) -> DataFrame:
    """(id long, v array<long>): floor(scale * x) of the vectors of exactly ``dims`` components, none null or non-finite."""
    v = F.col("v")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    return rows.filter(v.isNotNull() & (F.size(v) == dims) & whole).select("id", F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> Centroids:
    """The ``k`` vectors of (id, v) with the smallest hexadecimal sha256 of ``seed:id``, in that order.

    Null ids come last, rows that repeat an id in the order of their components.
    """
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [r["v"] for r in vectors.orderBy(place.asc_nulls_last(), "v").limit(k).select("v").collect()]


def column_blocks(vectors: DataFrame, dims: int, shard_dims: int = SHARD_DIMS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block long, shard int, ids array<long>, data binary), written to the shared folder.

    ``data`` holds little-endian 64-bit components, vector after vector; ids
    stand in shard 0 alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, v = batch.column("id"), batch.column("v")
            whole = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for first in range(0, len(whole), block_rows):
                part = whole[first : first + block_rows]
                shards = range(0, dims, shard_dims)
                data = [np.ascontiguousarray(part[:, d : d + shard_dims], "<i8").tobytes() for d in shards]
                own = ids.slice(first, len(part)).to_pylist()
                yield pa.record_batch(
                    {
                        "block": pa.array([block] * len(data), pa.int64()),
                        "shard": pa.array(range(len(data)), pa.int32()),
                        "ids": pa.array([own] + [None] * (len(data) - 1), pa.list_(pa.int64())),
                        "data": pa.array(data, pa.binary()),
                    }
                )
                block += 1

    return materialize(vectors.mapInArrow(cut, "block long, shard int, ids array<long>, data binary"), "column_blocks")


def _numbers(data: bytes, width: int) -> np.ndarray:
    """Rows of ``width`` components, as 64-bit integers where these are enough and as Python's where not."""
    rows = np.frombuffer(data, "<i8").reshape(-1, width)
    return rows if not len(rows) or -SMALL <= rows.min() and rows.max() <= SMALL else rows.astype(object)


def _packed(matrix: np.ndarray) -> tuple[int, bytes | None, list[str] | None]:
    """Distances as (bytes a number, numbers, None), or as (0, None, decimal texts) where 64 bits may be too few."""
    if matrix.dtype == object:
        return 0, None, [str(x) for x in matrix.ravel().tolist()]
    item = 4 if matrix.max(initial=0) < 1 << 32 else 8
    return item, matrix.astype(f"<u{item}").tobytes(), None


def _unpacked(row: dict, k: int) -> np.ndarray:
    if row["item"]:
        return np.frombuffer(row["small"], f"<u{row['item']}").reshape(-1, k).astype(np.int64)
    return np.array([int(x) for x in row["large"]], object).reshape(-1, k)


#: Columns of the partial distances.
PARTS = "block long, ids array<long>, item int, small binary, large array<string>"


def _partial(centroids: Centroids, shard_dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each column block's squared distances to the shard's slice of the centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                of = slice(row["shard"] * shard_dims, (row["shard"] + 1) * shard_dims)
                mine = [c[of] for c in centroids]
                x = _numbers(row["data"], len(mine[0]))
                small = x.dtype != object and all(-SMALL <= y <= SMALL for c in mine for y in c)
                x, c = (x, np.array(mine, np.int64)) if small else (x.astype(object), np.array(mine, object))
                item, near, far = _packed(np.stack([((x - own) ** 2).sum(axis=1) for own in c], axis=1))
                yield pa.record_batch(
                    {
                        "block": pa.array([row["block"]], pa.int64()),
                        "ids": pa.array([row["ids"]], pa.list_(pa.int64())),
                        "item": pa.array([item], pa.int32()),
                        "small": pa.array([near], pa.binary()),
                        "large": pa.array([far], pa.list_(pa.string())),
                    }
                )

    return run


def _nearest(k: int) -> Callable[[pa.Table], pa.Table]:
    """Adds a block's partial distances; the nearest centroid and the distance of each vector."""

    def run(table: pa.Table) -> pa.Table:
        total, ids = 0, None
        for row in table.to_pylist():
            total = total + _unpacked(row, k)
            ids = row["ids"] if row["ids"] is not None else ids
        cluster = total.argmin(axis=1)  # the first of equals, and so the smaller number
        distance = total[np.arange(len(total)), cluster]
        return pa.table(
            {
                "block": table.column("block").slice(0, 1),
                "ids": pa.array([ids], pa.list_(pa.int64())),
                "cluster": pa.array([cluster.tolist()], pa.list_(pa.int32())),
                "distance": pa.array([[min(int(d), MOST) for d in distance]], pa.list_(pa.int64())),
            }
        )

    return run


def assign(blocks: DataFrame, centroids: Centroids, shard_dims: int = SHARD_DIMS) -> DataFrame:
    """(block, ids, cluster, distance): the arrays of each block's vectors."""
    parts = blocks.mapInArrow(_partial(centroids, shard_dims), PARTS)
    return parts.groupBy("block").applyInArrow(_nearest(len(centroids)), "block long, ids array<long>, cluster array<int>, distance array<long>")


def _sums(k: int, dims: int, shard_dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each column block's count and sums of components by centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                width = min(shard_dims, dims - row["shard"] * shard_dims)
                x, cluster = _numbers(row["data"], width), np.array(row["cluster"], np.int64)
                sums = np.zeros((k, width), x.dtype)
                np.add.at(sums, cluster, x)
                counts = np.bincount(cluster, minlength=k)
                there = np.flatnonzero(counts)
                yield pa.record_batch(
                    {
                        "shard": pa.array([row["shard"]] * len(there), pa.int32()),
                        "cluster": pa.array(there, pa.int32()),
                        "n": pa.array(counts[there], pa.int64()),
                        "sums": pa.array([[Decimal(int(s)) for s in sums[c]] for c in there], pa.list_(pa.decimal128(38, 0))),
                    }
                )

    return run


def update(blocks: DataFrame, assigned: DataFrame, centroids: Centroids, shard_dims: int = SHARD_DIMS) -> Centroids:
    """The centroids, each shard's slice replaced by the floor of its vectors' mean; those without vectors stay.

    What reaches the driver is a number for each centroid and dimension.
    """
    dims = len(centroids[0])
    joined = blocks.select("block", "shard", "data").join(assigned.select("block", "cluster"), "block")
    sums = joined.mapInArrow(_sums(len(centroids), dims, shard_dims), "shard int, cluster int, n long, sums array<decimal(38,0)>")
    by_dim = sums.select("shard", "cluster", "n", F.posexplode("sums").alias("dim", "part"))
    slices = by_dim.groupBy("shard", "cluster", "dim").agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
    out = [list(c) for c in centroids]
    for r in slices.collect():
        out[r["cluster"]][r["shard"] * shard_dims + r["dim"]] = int(r["total"]) // r["n"]
    return out


def lloyd(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1,
    key: str = "vec_id", embedding: str = "embedding", shard_dims: int = SHARD_DIMS, block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, Centroids]:
    """(vec_id, cluster int, distance long) of every kept vector after ``rounds`` updates, and the final centroids.

    Kept are vectors of exactly ``dims`` components, none null or non-finite;
    a component x counts as floor(scale * x). Ties go to the smaller centroid.
    Rows that repeat an id, or have none, count each. Fewer vectors than ``k``
    give as many centroids; no vector gives no row. Other columns play no part.
    Distances beyond 64 bits are returned as the largest 64-bit number.
    """
    kept = kept_vectors(vectors, key, embedding, scale, dims)
    centroids = first_centroids(kept, k, seed)
    blocks = column_blocks(kept, dims, shard_dims, block_rows)
    for _ in range(rounds if centroids else 0):
        centroids = update(blocks, assign(blocks, centroids, shard_dims), centroids, shard_dims)
    last = assign(blocks, centroids, shard_dims) if centroids else blocks.select("block", "ids", F.array().cast("array<int>").alias("cluster"), F.array().cast("array<long>").alias("distance"))
    rows = last.select(F.explode(F.arrays_zip("ids", "cluster", "distance")).alias("r"))
    return rows.select(F.col("r.ids").alias(key), F.col("r.cluster").alias("cluster"), F.col("r.distance").alias("distance")), centroids


def clusters(vectors: DataFrame, **options) -> DataFrame:
    """:func:`lloyd` with cluster_inertia, inertia (distances summed over the cluster and over all) and centroid_sha256.

    The sums by cluster, at most k rows, are broadcast.
    """
    found, centroids = lloyd(vectors, **options)
    found = materialize(found, "clustered")
    spark = vectors.sparkSession
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    shown = spark.createDataFrame([(i, digest(c)) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    limited = lambda c: F.least(c, F.lit(MOST).cast("decimal(38,0)")).cast("long")
    own = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).cast("decimal(38,0)").alias("own"))
    sums = own.withColumn("all", F.sum("own").over(Window.partitionBy()).cast("decimal(38,0)"))
    sums = sums.select("cluster", limited(F.col("own")).alias("cluster_inertia"), limited(F.col("all")).alias("inertia"))
    return found.join(F.broadcast(sums), "cluster").join(F.broadcast(shown), "cluster").select(*found.columns, "cluster_inertia", "inertia", "centroid_sha256")
