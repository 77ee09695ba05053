"""A search index kept up to date by batches of whole documents and removals.

A batch is a segment of its own: the postings of its documents, as a list of
grams for each field, and the list of these documents, with a mark on those
that it removes. Segments of neighbouring
batches are merged, ``fan`` of about the same size at a time, so that there are
a few for each power of ``fan`` in the number of batches; a merged segment has
each document's latest state alone. A segment is there once its row stands in
the table of segments, which is written last; one that lies within another
has been merged into it, is not read, and is removed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvault.operators.search import field_grams, posted
from sparkvault.operators.text import tokenize

KEY = ["vault_id", "path"]
#: Segments of about the same size that are merged.
FAN = 10

Segment = tuple[int, int]  # the first and the last batch
PARTS = ("segments", "documents", "postings")


def _folder(root: str, part: str, segment: Segment) -> str:
    return f"{root}/{part}/low={segment[0]}/high={segment[1]}"


def segments(spark: SparkSession, root: str) -> list[Segment]:
    """The segments to be read, in order; a row for each is all that comes to the driver."""
    try:
        found = {(r["low"], r["high"]) for r in spark.read.schema("n int, low long, high long").parquet(f"{root}/segments").select("low", "high").collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    within = lambda a, b: a != b and b[0] <= a[0] and a[1] <= b[1]
    return sorted(s for s in found if not any(within(s, other) for other in found))


def _read(spark: SparkSession, root: str, part: str, chosen: list[Segment]) -> DataFrame:
    """The rows of some segments; their folders alone are listed."""
    return spark.read.parquet(*(_folder(root, part, s) for s in chosen))


def _write(root: str, segment: Segment, documents: DataFrame, postings: DataFrame) -> None:
    """Write a segment; written again it replaces itself."""
    postings.write.mode("overwrite").parquet(_folder(root, "postings", segment))
    documents.write.mode("overwrite").parquet(_folder(root, "documents", segment))
    documents.sparkSession.range(1).select(F.lit(1).alias("n")).write.mode("overwrite").parquet(_folder(root, "segments", segment))


def _latest(documents: DataFrame) -> DataFrame:
    return documents.groupBy(*KEY).agg(F.max_by(F.struct("hash", "removed", "batch"), "batch").alias("d")).select(*KEY, "d.*")


def _remove(spark: SparkSession, root: str, segment: Segment) -> None:
    """Delete a merged segment's folders, its row among the segments first."""
    for part in PARTS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_folder(root, part, segment))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _due(found: list[Segment], fan: int) -> list[Segment] | None:
    """The first ``fan`` neighbours of one size, sizes in powers of ``fan``."""
    size = lambda s: int(math.log(s[1] - s[0] + 1, fan) + 1e-9)
    for i in range(len(found) - fan + 1):
        run = found[i : i + fan]
        if len({size(s) for s in run}) == 1:
            return run
    return None


def compact(spark: SparkSession, root: str, fan: int = FAN, keep: bool = False) -> int:
    """Merge segments until fewer than ``fan`` neighbours have one size; how many merges there were.

    A removal is forgotten once nothing older is left that it could hide.
    ``keep`` leaves merged segments for readers that have begun; the next call
    without it does not find them, so that they are then the caller's.
    """
    merges = 0
    while run := _due(found := segments(spark, root), fan):
        merged = (run[0][0], run[-1][1])
        documents = _latest(_read(spark, root, "documents", run))
        if run[0] == found[0]:
            documents = documents.filter("not removed")
        live = documents.filter("not removed").select(*KEY, "batch").hint("shuffle_hash")
        postings = _read(spark, root, "postings", run).join(live, [*KEY, "batch"], "left_semi")
        _write(root, merged, documents, postings)
        merges += 1
        for segment in [] if keep else run:
            _remove(spark, root, segment)
    return merges


def live_index(root: str, analyzer: Callable[[Column], Column] = tokenize, first: int = 0, fan: int = FAN) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the index at ``root``.

    A batch has whole documents (vault_id, path, hash, title, tags, body), each
    path once, and may have ``removed``: true for a path that is gone. Batches
    are numbered from ``first`` on; one that runs again replaces itself, or is
    part of a larger segment already and changes nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, n = batch.sparkSession, first + batch_id
        if "removed" not in batch.columns:
            batch = batch.withColumn("removed", F.lit(False))
        batch = batch.withColumn("removed", F.coalesce("removed", F.lit(False)))
        number = F.lit(n).cast("long").alias("batch")
        if not any(low <= n <= high and low < high for low, high in segments(spark, root)):
            documents = batch.select(*KEY, "hash", "removed", number)
            _write(root, (n, n), documents, field_grams(batch.filter("not removed"), analyzer).withColumn("batch", number))
        compact(spark, root, fan)

    return run


def read_live_index(spark: SparkSession, root: str) -> DataFrame:
    """Postings (vault_id, path, field, gram) of the latest state of every document that is not removed."""
    found = segments(spark, root)
    if not found:
        return spark.createDataFrame([], "vault_id string, path string, field string, gram string")
    live = _latest(_read(spark, root, "documents", found)).filter("not removed")
    return posted(_read(spark, root, "postings", found).join(live.select(*KEY, "batch").hint("shuffle_hash"), [*KEY, "batch"], "left_semi"))
