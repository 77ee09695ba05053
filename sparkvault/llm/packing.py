"""Best-fit packing with bound-certified repacking (operator 2).

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt into
groups of a bounded size, each packed by best-fit decreasing; dual feasible
functions give a lower bound for each group's bin count, and a group that
meets it is certified. Bins with room left in groups that are not known to be
best go to new, fewer groups, which are packed again; a new packing counts
only where it needs fewer bins than it took in. The rounds end when the bound
of the whole table is met, when a round saves nothing, or after ``ROUNDS``
rounds, the exchanges that a caller grants at most.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvault.llm import bpe
from sparkvault.llm._common import materialize

#: Most pieces a packing group is meant to hold.
GROUP_PIECES = 50_000
#: Most rounds of packing and exchange, a parameter of :func:`pack`; rounds that save nothing end it before.
ROUNDS = 12


def pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, piece int, start long, length long, ids_crc32 long) of every document.

    A document is its ids and ``end_id``; only longer ones than ``capacity``
    are cut. Null and empty texts make one piece of one token. Rows with equal
    keys are documents of their own.
    """
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([end_id], "<u4")

    def assemble(block: bpe.Block) -> pa.Table:
        rows, piece, start, length, crc = [], [], [], [], []
        for row in range(len(block)):
            ids = np.concatenate([block.ids_of(row), end])
            for i, first in enumerate(range(0, len(ids), capacity)):
                part = ids[first : first + capacity]
                rows.append(row)
                piece.append(i)
                start.append(first)
                length.append(len(part))
                crc.append(zlib.crc32(part))
        return pa.table(
            {
                "key": block.keys.take(pa.array(rows, pa.int64())),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            }
        )

    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long"
    return bpe.encoded_blocks(docs, tokenizer_path, assemble, schema, key, text).withColumnRenamed("key", key)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every length.

    The longest come first, each into the fullest bin with room. A bit mask
    tells the amounts of room at hand, so that a placement costs the same for
    any number of open bins.
    """
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    at_hand, n_bins = 0, 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = at_hand >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                at_hand ^= 1 << r
        else:
            r, b = capacity, n_bins
            n_bins += 1
        bins[i], offsets[i] = b, capacity - r
        if left := r - n:
            if not room[left]:
                at_hand |= 1 << left
            room[left].append(b)
    return bins, offsets


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing of ``counts`` pieces of ``lengths`` goes below.

    The best of two families of dual feasible functions: cutting off at e
    (pieces over capacity - e fill a bin, those under e vanish) and rounding
    down at k (multiples of 1/(k+1) stay, others go to floor((k+1)x)/k).
    """
    n, x = counts.astype(np.int64), lengths.astype(np.int64)
    if not n.sum():
        return 0
    best = -(-int((n * x).sum()) // capacity)
    for e in range(1, capacity // 2 + 1):
        weight = np.where(x > capacity - e, capacity, np.where(x >= e, x, 0))
        best = max(best, -(-int((n * weight).sum()) // capacity))
    for k in range(1, 41):
        scaled = (k + 1) * x
        weight = np.where(scaled % capacity == 0, k * x, (scaled // capacity) * capacity)
        best = max(best, -(-int((n * weight).sum()) // (k * capacity)))
    return best


def _bounded(lengths: np.ndarray, capacity: int) -> int:
    counts = np.bincount(lengths, minlength=capacity + 1)
    there = np.flatnonzero(counts)
    return lower_bound(there, counts[there], capacity)


def _pack_group(capacity: int, round_no: int, columns: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Pack one group; keep the bins it came with unless fewer do.

    Marks the bins to hand on: all with room left, or the emptiest alone where
    the bound certifies the group's count.
    """

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy().astype(np.int64)
        group = table.column("group")[0].as_py()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        old, old_bins = np.unique(table.column("sequence_id").to_numpy(), return_inverse=True)
        sequence = (np.int64(round_no) << 56) | (np.int64(group) << 24) | bins
        if round_no and len(old) <= bins.max() + 1:
            bins, offsets, sequence = old_bins, table.column("offset").to_numpy(), old[old_bins]
        filled = np.bincount(bins, weights=lengths).astype(np.int64)
        moves = filled < capacity
        if len(filled) <= _bounded(lengths, capacity):
            moves &= np.arange(len(filled)) == filled.argmin()
        out = {c: table.column(c) for c in columns} | {
            "sequence_id": pa.array(sequence, pa.int64()),
            "offset": pa.array(offsets, pa.int64()),
            "moves": pa.array(moves[bins], pa.bool_()),
        }
        return pa.table(out)

    return run


def pack(items: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``items`` (with ``length`` from 1 to ``capacity``) and sequence_id long, offset long.

    Sequences are gapless from 0 and hold at most ``capacity`` tokens. Ties
    are broken by the order in a group. An empty table gives an empty table.
    Columns of ``items`` may have any name; those named sequence_id or offset
    give way to the results. At most ``rounds`` rounds are made: each further
    one could save sequences, but never needs more.
    """
    named = [c for c in items.columns if c.lower() not in ("sequence_id", "offset", "length")]
    # Inside, the other columns have names that nothing clashes with.
    items = items.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(named)), "length")
    packed = _packed(items, capacity, group_pieces, rounds)
    return packed.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(named)), "length", "sequence_id", "offset")


def _packed(items: DataFrame, capacity: int, group_pieces: int, rounds: int) -> DataFrame:
    columns = items.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    schema = f"{kinds}, sequence_id long, offset long, moves boolean"
    full = F.col("length") == capacity

    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    histogram.pop(capacity, 0)
    least = lower_bound(np.array(list(histogram), np.int64), np.array(list(histogram.values()), np.int64), capacity)

    def deal(rows: DataFrame, n: int, *by: str | Column) -> DataFrame:
        return rows.withColumn("group", F.pmod(F.xxhash64(*by), F.lit(max(1, math.ceil(n / group_pieces))))).groupBy("group")

    nowhere = F.lit(0).cast("long")
    out = items.filter(full).select(*columns, (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), nowhere.alias("offset"))
    groups = deal(items.filter(~full).withColumns({"sequence_id": nowhere, "offset": nowhere}), sum(histogram.values()), *columns)
    settled, before = 0, None
    for r in range(rounds):
        packed = materialize(groups.applyInArrow(_pack_group(capacity, r, columns), schema), "packed")
        first = F.col("offset") == 0  # a bin's first piece stands for it
        counts = packed.agg(
            F.count_if(first & ~F.col("moves")).alias("stay"),
            F.count_if(first & F.col("moves")).alias("move"),
            F.count_if("moves").alias("pieces"),
        ).first()
        bins = settled + counts["stay"] + counts["move"]
        if bins <= least or bins == before or counts["move"] < 2 or r == rounds - 1:
            return out.unionByName(packed.drop("moves"))
        settled, before = settled + counts["stay"], bins
        out = out.unionByName(packed.filter(~F.col("moves")).drop("moves"))
        groups = deal(packed.filter("moves").drop("moves"), counts["pieces"], "sequence_id", F.lit(r))
    return out


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The pieces of all documents and where they stand in which sequence."""
    return pack(materialize(pieces(docs, tokenizer_path, end_id, capacity, key, text), "pieces"), capacity)
