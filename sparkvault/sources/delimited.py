"""Delimited files, read in blocks.

Where a cell begins and ends depends on all quotes before it, so a file cannot
just be cut. A block of it is read as a mapping: from each state that the text
before may leave (at a record's begin, at a cell's begin, in a bare cell, in a
quoted one, behind a quote in it) to the state that the block leaves and the
number of records that end in it. The mappings of a file's blocks, applied one
after the other, tell each block its first state and record; then all blocks
are cut into records at once, and records that lie on several blocks are put
together by their number.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvault.operators.fold import Fold, Row, State, ordered_fold

#: Bytes of a block.
BLOCK_BYTES = 1 << 20
RECORD, CELL, BARE, QUOTED, BEHIND = range(5)
QUOTE, DELIMITER, LINE, OTHER = range(4)
#: The state after a token, by the state before it. A quote behind which a quoted cell goes on is part of it.
NEXT = [
    (QUOTED, CELL, RECORD, BARE), (QUOTED, CELL, RECORD, BARE), (BARE, CELL, RECORD, BARE), (BEHIND, QUOTED, QUOTED, QUOTED), (QUOTED, CELL, RECORD, QUOTED),
]
#: States in which a line end ends a record; at a record's begin it is an empty line.
ENDS = (False, True, True, False, True)


def sniff_delimiter(path: Column, head: Column) -> Column:
    """By extension; for csv a semicolon where the first line has more of them than commas, outside quotes and in the first 1024 characters."""
    bare = F.regexp_replace(F.substring(head, 1, 1024), '"[^"]*(?:"|$)', "")
    line = F.substring_index(bare, "\n", 1)
    count = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c)))
    name = F.lower(path)
    return F.when(name.endswith(".tsv"), "\t").when(name.endswith(".psv"), "|").when(count(";") > count(","), ";").otherwise(",")


@lru_cache(maxsize=8)
def _splitter(delimiter: bytes) -> tuple[Callable[[bytes], list[bytes]], dict[bytes, int]]:
    """What cuts bytes into tokens, and the kinds of tokens by their first byte; all others are ``OTHER``."""
    d = re.escape(delimiter)
    return re.compile(rb'"|\n|' + d + rb'|[^"\n' + d + rb"]+").findall, {b'"': QUOTE, delimiter: DELIMITER, b"\n": LINE}


def mapping(block: bytes, delimiter: bytes) -> tuple[list[int], list[int]]:
    """For each state at a block's begin: the state at its end, and how many records end in it."""
    split, kinds = _splitter(delimiter)
    states, ended = list(range(5)), [0] * 5
    for token in split(block):
        kind = kinds.get(token, OTHER)
        if kind == LINE:
            ended = [n + ENDS[s] for n, s in zip(ended, states, strict=True)]
        states = [NEXT[s][kind] for s in states]
    return states, ended


def records(block: bytes, delimiter: bytes, state: int) -> tuple[list[bytes], bool]:
    """A block's records without their line ends, and whether the last one is not ended.

    The first may be the rest of one that began before; an empty line at a
    record's begin is none.
    """
    split, kinds = _splitter(delimiter)
    out, first, at = [], 0, 0
    for token in split(block):
        kind = kinds.get(token, OTHER)
        if kind == LINE and state in (RECORD, CELL, BARE, BEHIND):
            if ENDS[state]:
                out.append(block[first:at])
            first = at + 1
        state = NEXT[state][kind]
        at += len(token)
    if state != RECORD:
        out.append(block[first:])
    return out, state != RECORD


def cells(record: bytes, delimiter: bytes) -> list[str]:
    """The cells of a record; doubled quotes in quoted cells are one, quotes in bare cells are as they are."""
    split, kinds = _splitter(delimiter)
    out, cell, state = [], [], CELL
    for token in split(record):
        kind = kinds.get(token, OTHER)
        new = NEXT[state][kind]
        if kind == DELIMITER and new == CELL:
            out.append(b"".join(cell))
            cell = []
        elif state == BEHIND:
            cell.append(b'"' if kind == QUOTE else b'"' + token)
        elif not (kind == QUOTE and new in (QUOTED, BEHIND)):
            cell.append(token)
        state = new
    return [c.decode(errors="replace") for c in [*out, b"".join(cell)]]


class Chain(Fold):
    """(path, block, state, record): with which state and record each block of a file begins; rows have states and ended."""

    schema = "path string, block int, state int, record long"

    def start(self) -> State:
        return [RECORD, 0]

    def step(self, state: State, row: Row) -> Iterable[tuple]:
        yield row["path"], row["block"], state[0], state[1]
        state[:] = row["states"][state[0]], state[1] + row["ended"][state[0]]


def _blocks(files: DataFrame, size: int) -> DataFrame:
    """(path, d, block, bytes) of (path, d, content): line ends are one character, a byte-order mark goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, d, content in zip(*(batch.column(c) for c in ("path", "d", "content")), strict=True):
                whole = content.as_py().removeprefix(b"\xef\xbb\xbf").replace(b"\r\n", b"\n").removesuffix(b"\r")
                for n, first in enumerate(range(0, len(whole), size)):
                    yield pa.record_batch({"path": [path.as_py()], "d": [d.as_py()], "block": pa.array([n], pa.int32()), "bytes": [whole[first : first + size]]})

    return files.mapInArrow(run, "path string, d string, block int, bytes binary")


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [mapping(b, d.encode()) for b, d in zip(batch.column("bytes").to_pylist(), batch.column("d").to_pylist(), strict=True)]
        columns = {"path": batch.column("path"), "block": batch.column("block")}
        columns |= {name: pa.array([f[i] for f in found], pa.list_(pa.int32())) for i, name in enumerate(("states", "ended"))}
        yield pa.record_batch(columns)


RECORDS = "path string, d string, row long, block int, part binary, cells array<string>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that lie in a block alone with their cells, parts of others as bytes."""
    for batch in batches:
        for x in batch.to_pylist():
            delimiter, rows = x["d"].encode(), []
            found, is_open = records(x["bytes"], delimiter, x["state"])
            for n, record in enumerate(found):
                whole = not (n == 0 and x["state"] != RECORD or n == len(found) - 1 and is_open)
                rows.append((x["path"], x["d"], x["record"] + n, x["block"], None if whole else record, cells(record, delimiter) if whole else None))
            if rows:
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in RECORDS.split(", ")])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [cells(b"".join(parts), d.encode()) for parts, d in zip(batch.column("parts").to_pylist(), batch.column("d").to_pylist(), strict=True)]
        yield pa.record_batch({"path": batch.column("path"), "row": batch.column("row"), "cells": pa.array(found, pa.list_(pa.string()))})


def read_delimited(spark: SparkSession, paths: list[str], limit: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, row, cells array<string>) of csv, tsv and psv files; rows may be ragged.

    Quoted cells may hold delimiters, line ends and doubled quotes; a quote in
    a bare cell, or behind which a quoted cell goes on, is one; a cell that is
    never closed ends with the file. Empty lines are no rows, the byte-order
    mark is dropped, a carriage return before a line end too. What is not UTF-8
    is replaced. A file above ``limit`` bytes, where that is given, is one row
    without row and cells.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content", (F.col("length") <= limit if limit is not None else F.lit(True)).alias("fits"))
    head = F.substring("content", 1, 1028).cast("string")
    fit = files.filter("fits").withColumn("d", sniff_delimiter(F.col("path"), F.regexp_replace(head, "^﻿", ""))).select("path", "d", "content")
    blocks = _blocks(fit, block_bytes).repartition("path", "block")
    states = blocks.mapInArrow(_mapped, "path string, block int, states array<int>, ended array<int>")
    begun = blocks.join(ordered_fold(states, ["path"], ["block"], Chain()), ["path", "block"])
    found = begun.select("path", "d", "block", "bytes", "state", "record").mapInArrow(_cut, RECORDS)
    parts = found.filter("part is not null").groupBy("path", "d", "row").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("p"))
    across = parts.select("path", "d", "row", F.col("p.part").alias("parts")).mapInArrow(_joined, "path string, row long, cells array<string>")
    out = found.filter("part is null").select("path", "row", "cells").unionByName(across).withColumn("row", F.col("row").cast("int"))
    if limit is None:
        return out
    refused = files.filter("not fits").select("path", F.lit(None).cast("int").alias("row"), F.lit(None).cast("array<string>").alias("cells"))
    return out.unionByName(refused)
