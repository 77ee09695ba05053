"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the word contracts call white space: the space and U+0009 to U+000D.
BLANK = "\\x20\\x09-\\x0D"
BLANKS = " \t\n\x0b\f\r"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent (a local session, as in tests) a new
    folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage; the written table outlives any executor.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the system; Python workers stay alive between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with what it has freed given back when its task ends: the worker stays, idle or for another stage."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def unused(columns: list[str], name: str) -> str:
    """``name``, lengthened in front until none of ``columns`` begins with it, in any case."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name = f"_{name}"
    return name


def n_blocks(df: DataFrame, text: str, target_bytes: int, target_rows: int) -> int:
    """How many blocks of about ``target_bytes`` of text and ``target_rows`` rows ``df`` fills."""
    size, rows = df.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    return max(1, math.ceil((size or 0) / target_bytes), math.ceil(rows / target_rows))


def fold_bucket(column: Column, modulus: int) -> Column:
    """The contracts' fold: crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def text_bytes(batch: pa.RecordBatch | pa.Table, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive [first, last) runs whose sizes add up to at most ``most``.

    A single larger element makes a run of its own.
    """
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if sizes:
        yield first, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer over uint64 (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
