"""Folds in order, over tables and streams, and the line diff and merge, against plain loops and golden rows."""

import random
import types

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkvault.operators import changes, fold, merge, oplog
from sparkvault.streaming import ordered, streams

EVENTS = "vault_id string, hash string, action string, path string, ts timestamp"


def events(spark, rows):
    """(vault, hash, action, path, milliseconds) as events."""
    df = spark.createDataFrame(rows, "vault_id string, hash string, action string, path string, ms long")
    return df.withColumn("ts", F.timestamp_millis("ms")).drop("ms")


def paired(df):
    return sorted((r["vault_id"], r["from"], r["to"]) for r in df.collect())


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("v", "h", "delete", "a", 0), ("v", "h", "delete", "b", 200), ("v", "h", "create", "c", 300)], [("v", "a", None), ("v", "b", "c")]),
        ([("v", "h", "create", "x", 0), ("v", "h", "delete", "b", 10), ("v", "h", "create", "c", 20)], [("v", "b", "c")]),
        ([("v", "h", "delete", "a", 0), ("v", "h", "create", "b", 250)], [("v", "a", "b")]),
        ([("v", "h", "delete", "a", 0), ("v", "h", "create", "b", 251)], [("v", "a", None)]),
        ([("v", "h", "delete", "a", 0), ("v", "h", "create", "b", 1), ("v", "h", "create", "c", 2)], [("v", "a", "b")]),
        ([("v", "h", "delete", "a", 0), ("w", "h", "create", "b", 1)], [("v", "a", None)]),
        ([("v", None, "delete", "a", 0), ("v", None, "create", "b", 1)], [("v", "a", None)]),
        ([], []),
    ],
)
def test_renames_are_paired_from_a_queue(spark, rows, want):
    assert paired(changes.detect_renames(events(spark, rows))) == want


def random_events(seed, n=400):
    r = random.Random(seed)
    return [(r.choice("vw"), r.choice(["h", "i", None]), r.choice(["delete", "create"]), f"p{i}", r.randrange(20_000)) for i in range(n)]


def stream_in_batches(spark, df, folder, batches):
    """The rows as a stream of one file a batch, in the order given."""
    for i, part in enumerate(batches):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        for f in folder.glob("in/part-*"):
            f.rename(folder / "in" / f"{i:03}.parquet")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "[0-9]*.parquet").parquet(f"{folder}/in")


def run_stream(out, folder):
    q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{folder}/out")


def test_renames_of_a_stream_equal_those_of_the_table_out_of_order(spark, tmp_path):
    rows = random_events(1)
    want = paired(changes.detect_renames(events(spark, rows)))
    late = [("v", "z", "create", "end", 60_000)]  # moves the watermark past all others
    r = random.Random(2)
    rows.sort(key=lambda x: x[4] + r.randrange(3_000))
    parts = [events(spark, rows[i : i + 150]) for i in range(0, len(rows), 150)] + [events(spark, late)]
    stream = stream_in_batches(spark, events(spark, late), tmp_path, parts)
    assert paired(run_stream(streams.pair_renames(stream, late="5 seconds"), tmp_path)) == want


def commits(rows, max_bytes, max_ops, delay, quiet):
    """The stage op after op, with a look at both deadlines before each."""
    out, stage = [], None
    for client, us, size in [*rows, (None, 1 << 60, 0)]:
        if stage and us >= min(stage["f"] + delay, stage["l"] + quiet):
            out.append((stage["c"], stage["n"], stage["b"], "max_delay" if stage["f"] + delay <= stage["l"] + quiet else "quiet"))
            stage = None
        if client is None:
            break
        stage = stage or {"c": client, "n": 0, "b": 0, "f": us}
        stage.update(n=stage["n"] + 1, b=stage["b"] + size, l=us)
        if stage["b"] >= max_bytes or stage["n"] >= max_ops:
            out.append((client, stage["n"], stage["b"], "byte_cap" if stage["b"] >= max_bytes else "file_cap"))
            stage = None
    return out


def test_commits_of_a_stream_come_by_timers_out_of_order(spark, tmp_path):
    r = random.Random(3)
    rows = [(f"c{r.randrange(3)}", i, r.randrange(30_000_000), r.randrange(60)) for i in range(300)]
    want = []
    for c in ("c0", "c1", "c2"):
        own = sorted((us, seq, size) for client, seq, us, size in rows if client == c)
        want += commits([(c, us, size) for us, _, size in own], 150, 5, 900_000, 400_000)
    frame = lambda part: spark.createDataFrame(part, "client_id string, seq long, us long, bytes long")
    rows.sort(key=lambda x: x[2] + r.randrange(2_000_000))
    parts = [frame(rows[i : i + 120]) for i in range(0, 300, 120)] + [frame([("end", 0, 90_000_000, 1)])]
    stream = stream_in_batches(spark, parts[0], tmp_path, parts)
    got = run_stream(streams.staged_commits(stream, 150, 5, 0.9, 0.4, late="4 seconds"), tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {x[3] for x in want} == {"byte_cap", "file_cap", "quiet", "max_delay"}


def test_a_commit_clears_the_ring_of_every_client(spark):
    op = lambda c, seq, h, t: ("v", c, "p", seq, h, t)
    rows = [op("a", 1, "x", 1), op("b", 1, "x", 2), op("a", 2, "x", 3), op("a", 3, "y", 6), op("a", 4, "x", 7), op("b", 2, "x", 8), op("a", 5, "y", 9)]
    ops = spark.createDataFrame(rows, "vault_id string, client_id string, path string, seq long, hash string, t long").withColumn("ts", F.timestamp_seconds("t"))
    cleared = spark.createDataFrame([("v", "p", 5), ("v", "q", 6), ("w", "p", 8)], "vault_id string, path string, t long").withColumn("ts", F.timestamp_seconds("t"))
    stuck = lambda df: {(r.client_id, r.seq) for r in df.filter("stuck").collect()}
    assert stuck(oplog.stuck_writes(ops)) == {("a", 2), ("a", 4), ("b", 2), ("a", 5)}
    assert stuck(oplog.stuck_writes(ops, cleared)) == {("a", 2), ("a", 5)}


def test_only_accepted_events_count(spark):
    rows = spark.createDataFrame([("a", i, i) for i in range(8)], "client_id string, seq long, t long").withColumn("ts", F.timestamp_seconds("t"))
    out = {r.seq: (r.in_window, r.refused) for r in oplog.rate_limit_accepted(rows, 2, 4).collect()}
    assert out == {0: (0, False), 1: (1, False), 2: (2, True), 3: (2, True), 4: (1, False), 5: (1, False), 6: (2, True), 7: (2, True)}


def test_a_fold_carries_its_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = spark.range(500).select((F.col("id") % 3).cast("string").alias("by"), F.col("id").alias("seq"), (F.col("id") % 11).alias("size"))
        out = fold.ordered_fold(rows, ["by"], ["seq"], fold.PackBatches(20, "string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for by in range(3):
        used = chunk = 0
        for i in range(by, 500, 3):
            if used and used + i % 11 > 20:
                used, chunk = 0, chunk + 1
            used += i % 11
            want.add((str(by), i, chunk))
    assert {tuple(r) for r in out} == want and len(out) == 500


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_hunks_are_as_small_as_a_longest_common_sequence():
    r = random.Random(4)
    for _ in range(400):
        of = r.choice([2, 3, 6, 40])
        a = [str(r.randrange(of)) for _ in range(r.randrange(30))]
        b = [x for x in a if r.random() > 0.2] if r.random() < 0.5 else [str(r.randrange(of)) for _ in range(r.randrange(30))]
        for _ in range(r.randrange(4)):
            b.insert(r.randrange(len(b) + 1), str(r.randrange(of)))
        for most in (merge.EDITS, 2):  # beyond it, cut at lines that occur once
            out, at, found = [], 0, merge.text_hunks(a, b, most)
            for start, end, first, last in found:
                assert at <= start <= end
                out, at = [*out, *a[at:start], *b[first:last]], end
            assert [*out, *a[at:]] == b
            if most == merge.EDITS:
                assert sum(e - s + n - f for s, e, f, n in found) == len(a) + len(b) - 2 * longest_common(a, b)


def test_insertions_into_equal_groups_are_hunks_of_their_own(spark):
    group = ["{", "  a", "  b", "}", "", "x", "y"]
    base, other = group * 20, []
    for _ in range(20):
        other += [*group[:2], "new 1", "new 2", *group[2:]]
    rows = spark.createDataFrame([("v", "p", "\n".join(base), "\n".join(other))], "vault_id string, path string, a string, b string")
    found = merge.line_hunks(rows, "a", "b", "ours").collect()
    assert len(found) == 20 and all(r.start == r.end and list(r.lines) == ["new 1", "new 2"] for r in found)


@pytest.mark.parametrize(
    ("ours", "theirs", "overlap"),
    [
        ((0, 0), (0, 5), False), ((0, 5), (5, 5), False), ((5, 5), (5, 9), False), ((3, 3), (0, 5), True), ((0, 5), (3, 3), True),
        ((4, 4), (4, 4), True), ((4, 4), (5, 5), False), ((0, 3), (3, 5), False), ((0, 4), (3, 5), True), ((1, 2), (1, 2), True),
    ],
)
def test_overlaps_at_edges(spark, ours, theirs, overlap):
    rows = [("v", "p", side, *at, [side]) for side, at in (("ours", ours), ("theirs", theirs))]
    hunks = spark.createDataFrame(rows, "vault_id string, path string, side string, start int, end int, lines array<string>")
    assert merge.hunk_overlaps(hunks).count() == overlap
    assert merge.conflict_regions(hunks).count() == 2 - overlap


@pytest.mark.parametrize(
    ("base", "ours", "theirs", "want", "conflicts"),
    [
        ("a\nb\nc\nd", "a\nnew\nb\nc\nd", "a\nB\nc\nd", "a\nnew\nB\nc\nd", 0),
        ("a\nb\nc\nd", "a\nb\nnew\nc\nd", "a\nB\nc\nd", "a\nB\nnew\nc\nd", 0),
        ("a\nb\nc\nd", "a\nb\nc\nd\nx", "a\nb\nc\nd\ny", "a\nb\nc\nd\n<<<<<<< ours\nx\n=======\ny\n>>>>>>> theirs", 1),
        ("a\nb\nc\nd", "d", "a\nb\nx\nc\nd", "<<<<<<< ours\n=======\na\nb\nx\nc\n>>>>>>> theirs\nd", 1),
        (None, "x", "y", "<<<<<<< ours\nx\n=======\ny\n>>>>>>> theirs", 1),
    ],
)
def test_merges_at_edges(spark, base, ours, theirs, want, conflicts):
    rows = spark.createDataFrame([("v", "p", base, ours, theirs)], "vault_id string, path string, base_text string, our_text string, their_text string")
    assert [(r.merged, r.conflicts) for r in merge.merge_texts(rows).collect()] == [(want, conflicts)]


class Handle:
    """A group's state in plain lists, for a processor outside a stream."""

    def __init__(self):
        self.rows, self.value, self.timers = [], None, []

    def getListState(self, *_):  # noqa: N802
        return types.SimpleNamespace(appendList=self.rows.extend, get=lambda: iter(list(self.rows)), clear=self.rows.clear, put=self.rows.extend)

    def getValueState(self, *_):  # noqa: N802
        return types.SimpleNamespace(get=lambda: self.value, update=lambda v: setattr(self, "value", v), clear=lambda: setattr(self, "value", None))

    def registerTimer(self, ms):  # noqa: N802
        self.timers.append(ms)


def test_keys_of_a_stream_share_groups_and_rows_are_few_at_a_time(monkeypatch):
    monkeypatch.setattr(ordered, "OUT_ROWS", 100)
    r = random.Random(8)
    rows = [(r.choice(["a", "b", None]), i, r.randrange(3_000_000)) for i in range(1_000)]
    kinds = pa.schema([("client_id", pa.string()), ("seq", pa.int64()), ("us", pa.int64())])
    rule, handle = fold.RateLimit(2, 1), Handle()
    run = ordered.Ordered(rule, kinds.names, kinds, ["client_id"], [("us", True), ("seq", True)])
    run.init(handle)
    for part in (rows[:600], rows[600:]):
        assert not list(run.handleInputRows((7,), iter([pd.DataFrame(part, columns=kinds.names)]), None))
    assert len(handle.rows) == 2  # batches, not rows
    got = []
    for mark in (1_500, 10_000):
        frames = list(run.handleExpiredTimer((7,), types.SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark), None))
        assert max(map(len, frames)) <= 200
        got += [tuple(x) for f in frames for x in f.astype(object).where(f.notna(), None).itertuples(index=False)]
    assert handle.value is None and not handle.rows
    want = []
    for key in ("a", "b", None):
        state = rule.start()
        for us, seq in sorted((us, seq) for k, seq, us in rows if k == key):
            want += rule.step(state, {"client_id": key, "seq": seq, "us": us})
    assert sorted(got, key=lambda x: x[1]) == sorted(want, key=lambda x: x[1])
