"""Structured Streaming forms of the op-log operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvault.functions import predicates
from sparkvault.operators.changes import fold_latest
from sparkvault.operators.fold import PairRenames, RateLimit, StagedCommits, StuckWrites
from sparkvault.operators.oplog import fanout_counts, fanout_ops, sent_ops  # noqa: F401
from sparkvault.streaming.live import compact, live_index, read_live_index  # noqa: F401
from sparkvault.streaming.ordered import ordered_stream


def ingest_ops(ops: DataFrame, prune: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): ops that keep their type's rules and are new by (client_id, seq); the others with their reason."""
    reason = predicates.invalid_op(
        F.col("type"), F.col("seq"), F.unix_micros(F.col("ts").cast("timestamp")), F.col("path"), F.col("from"), F.col("to"), F.col("data"), F.col("binary"), F.col("pre_hash")
    )
    checked = ops.withColumn("reason", reason)
    fresh = checked.filter("reason is null").drop("reason").withWatermark("ts", prune).dropDuplicatesWithinWatermark(["client_id", "seq"])
    return fresh, checked.filter("reason is not null")


def session_batches(ops: DataFrame, gap: str = "3 seconds", late: str = "1 minute") -> DataFrame:
    """(client_id, window, ops, bytes): sessions of a client's ops by their idle gap."""
    size = F.when(F.col("type") == "write", F.octet_length("data")).otherwise(0)
    return ops.withWatermark("ts", late).groupBy("client_id", F.session_window("ts", gap).alias("window")).agg(F.count("*").alias("ops"), F.sum(size).alias("bytes"))


def pair_renames(events: DataFrame, within: str = "250 milliseconds", late: str = "1 minute") -> DataFrame:
    """(vault_id, hash, from, to, us) as :func:`sparkvault.operators.changes.detect_renames`, one-to-one and by vault.

    A delete that no create answers comes out alone by a timer, once the
    watermark has passed its window. ``events`` is as there.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select(F.col("vault_id").cast("string").alias("vault_id"), "hash", "action", "path", us.alias("us"), F.col("ts").cast("timestamp").alias("ts"))
    # Of equal times the deletes come first; a null hash has a key of its own.
    return ordered_stream(rows, ["vault_id", "hash"], [("us", True), ("action", False), ("path", True)], PairRenames(within), late)


def counters(events: DataFrame, labels: list[str], window: str | None = None, slide: str | None = None, late: str = "1 minute") -> DataFrame:
    """Running counts by labels, or counts by tumbling or sliding window."""
    if window is None:
        return events.groupBy(*labels).count()
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("window"), *labels).count()


def fanout(batches: DataFrame, clients: DataFrame) -> DataFrame:
    """A stream of batches joined with the table of clients."""
    return fanout_ops(batches, clients)


def split_frozen(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sendable, held): frozen ops are kept and not sent."""
    frozen = F.coalesce("frozen", F.lit(False))
    return ops.filter(~frozen), ops.filter(frozen)


def rate_limit(ops: DataFrame, limit: int, seconds: int, key: str = "client_id", late: str = "1 minute") -> DataFrame:
    """(key, seq, in_window, refused): the key has ``limit`` accepted ops within the last ``seconds``. Refused ops do not count.

    ``ops`` has seq and us (its time in microseconds); a key without accepted
    ops in the window has no state.
    """
    rows = ops.select(F.col(key).cast("string").alias(key), "seq", "us", F.timestamp_micros("us").alias("ts"))
    return ordered_stream(rows, [key], [("us", True), ("seq", True)], RateLimit(limit, seconds, key), late)


def stuck_writes(ops: DataFrame, depth: int = 3, late: str = "1 minute") -> DataFrame:
    """(client_id, path, seq, stuck): the hash is among the last ``depth`` accepted of the client and path since the path's last commit.

    ``ops`` has vault_id, path, kind (write or commit), client_id, seq, hash, us.
    """
    rows = ops.select("vault_id", "path", "kind", "client_id", "seq", "hash", "us", F.timestamp_micros("us").alias("ts"))
    return ordered_stream(rows, ["vault_id", "path"], [("us", True), ("kind", False), ("client_id", True), ("seq", True)], StuckWrites(depth), late)


def staged_commits(ops: DataFrame, max_bytes: int = 50 << 20, max_ops: int = 200, max_delay_s: float = 60, quiet_s: float = 3, late: str = "1 minute") -> DataFrame:
    """(client_id, ops, bytes, reason): commits of a client's stage. ``ops`` has client_id, seq, bytes long, us long.

    A stage is committed when it reaches a cap, and by a timer, without a later
    op, when the watermark has passed its quiet time or longest delay.
    """
    rows = ops.select("client_id", "seq", "bytes", "us", F.timestamp_micros("us").alias("ts"))
    return ordered_stream(rows, ["client_id"], [("us", True), ("seq", True)], StagedCommits(max_bytes, max_ops, max_delay_s, quiet_s), late)


def latest_state(ops: DataFrame) -> DataFrame:
    """(vault_id, path, row): the live row of every path by streaming ``max_by``; complete or update mode."""
    return ops.groupBy("vault_id", "path").agg(F.max_by(F.struct("type", "hash", "seq"), "seq").alias("row"))


def upsert_manifest(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds each batch, folded, to the manifest at ``path``.

    A batch writes only its own rows, in a folder of its number, so that a
    batch that runs again replaces itself; ``read_manifest`` folds over all.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.filter("type <> 'rename'").select("vault_id", "path", F.col("seq").alias("row_no"), "hash", (F.col("type") == "delete").alias("deleted"))
        fold_latest(rows, keep_deleted=True).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return run


def read_manifest(spark: SparkSession, path: str, keep_deleted: bool = False) -> DataFrame:
    """The manifest that ``upsert_manifest`` has at ``path``."""
    return fold_latest(spark.read.parquet(path).drop("batch"), keep_deleted=keep_deleted)
