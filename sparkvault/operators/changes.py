"""Snapshots compared: reconcile, diff, publish, verify, and the guards on their outcome.

Comparisons join hash columns only; contents are joined for what has changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkvault.operators.fold import Digest, PairRenames, ordered_fold

KEY = ["vault_id", "path"]


def fold_latest(log: DataFrame, order: str = "row_no", keep_deleted: bool = False) -> DataFrame:
    """The latest row of every (vault_id, path); tombstones are dropped unless asked for."""
    rest = [c for c in log.columns if c not in KEY]
    latest = log.groupBy(*KEY).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*KEY, "r.*")
    return latest if keep_deleted else latest.filter(~F.col("deleted"))


def pending_paths(*logs: DataFrame) -> DataFrame:
    """The (vault_id, path) that any op of the logs starts from."""
    parts = [log.select("vault_id", F.when(F.col("type") == "rename", F.col("from")).otherwise(F.col("path")).alias("path")) for log in logs]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.distinct()


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """(vault_id, path, left_hash, right_hash) of all paths on either side."""
    a = left.select(*KEY, F.col("hash").alias("left_hash"))
    b = right.select(*KEY, F.col("hash").alias("right_hash"))
    return a.join(b, KEY, "full_outer")


def reconcile(disk: DataFrame, manifest: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """The ops that bring the manifest to the disk: (vault_id, path, type, change, pre_hash, hash).

    A path on disk only is added, one with another hash modified, one in the
    manifest only deleted. Pending paths are left alone.
    """
    both = compare(disk, manifest)
    if pending is not None:
        both = both.join(pending.select(*KEY).distinct(), KEY, "left_anti")
    change = (
        F.when(F.col("right_hash").isNull(), "add").when(F.col("left_hash").isNull(), "delete")
        .when(F.col("left_hash") != F.col("right_hash"), "modify")
    )
    out = both.withColumn("change", change).filter(F.col("change").isNotNull())
    kind = F.when(F.col("change") == "delete", "delete").otherwise("write")
    return out.select(*KEY, kind.alias("type"), "change", F.col("right_hash").alias("pre_hash"), F.col("left_hash").alias("hash"))


def reconcile_counts(ops: DataFrame, disk: DataFrame | None = None) -> DataFrame:
    """(vault_id, adds, modifies, deletes) of :func:`reconcile`'s result."""
    count = lambda kind: F.count_if(F.col("change") == kind)
    return ops.groupBy("vault_id").agg(count("add").alias("adds"), count("modify").alias("modifies"), count("delete").alias("deletes"))


def bulk_delete_guard(counts: DataFrame, manifest_sizes: DataFrame, least: int = 10, share: float = 0.25) -> DataFrame:
    """``counts`` with files and blocked: at least ``least`` deletes and ``share`` of the files."""
    joined = counts.join(manifest_sizes.select("vault_id", "files"), "vault_id")
    blocked = (F.col("deletes") >= least) & (F.col("deletes") >= F.ceil(F.col("files") * share))
    return joined.withColumn("blocked", blocked)


def deletion_sample(ops: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` deleted paths of every vault."""
    place = F.row_number().over(Window.partitionBy("vault_id").orderBy("path"))
    return ops.filter(F.col("change") == "delete").withColumn("rank", place).filter(F.col("rank") <= n).select(*KEY, "rank")


def line_count(text: Column) -> Column:
    """Lines of a text; a last line end does not begin another one."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, "\n$", ""), "\n"))).cast("long")


def diff_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """(vault_id, path, status A/M/D, added, removed): lines by multiset difference for M."""
    both = compare(new, old)
    status = F.when(F.col("right_hash").isNull(), "A").when(F.col("left_hash").isNull(), "D").when(F.col("left_hash") != F.col("right_hash"), "M")
    changed = both.withColumn("status", status).filter(F.col("status").isNotNull()).select(*KEY, "status")
    texts = changed.join(new.select(*KEY, F.col("text").alias("new_text")), KEY, "left").join(old.select(*KEY, F.col("text").alias("old_text")), KEY, "left")
    lines = lambda c: F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "\n$", ""), "\n")
    modified = texts.filter(F.col("status") == "M")
    signed = modified.select(*KEY, F.explode(lines(F.col("new_text"))).alias("line"), F.lit(1).alias("n")).union(
        modified.select(*KEY, F.explode(lines(F.col("old_text"))), F.lit(-1))
    )
    by_line = signed.groupBy(*KEY, "line").agg(F.sum("n").alias("n"))
    moved = by_line.groupBy(*KEY).agg(F.sum(F.greatest("n", F.lit(0))).alias("more"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("less"))
    whole = texts.select(*KEY, "status", line_count(F.col("new_text")).alias("new_lines"), line_count(F.col("old_text")).alias("old_lines"))
    pick = lambda a, m, d: F.when(F.col("status") == "A", a).when(F.col("status") == "D", d).otherwise(m)
    zero = F.lit(0).cast("long")
    return whole.join(moved, KEY, "left").select(
        *KEY, "status",
        pick(F.col("new_lines"), F.coalesce("more", zero), zero).alias("added"),
        pick(zero, F.coalesce("less", zero), F.col("old_lines")).alias("removed"),
    )


def publish_diff(current: DataFrame, desired: DataFrame) -> DataFrame:
    """(vault_id, seq, type, path, hash): the writes, then the deletes, each by path, that make the tree equal ``desired``.

    A vault that ``desired`` does not know gets no op.
    """
    known = desired.select("vault_id").distinct()
    ops = reconcile(desired, current).join(known, "vault_id", "left_semi")
    order = Window.partitionBy("vault_id").orderBy((F.col("type") == "delete"), "path")
    return ops.select("vault_id", F.row_number().over(order).cast("long").alias("seq"), "type", "path", "hash")


def verify_base(manifest: DataFrame, base: DataFrame, disk: DataFrame) -> DataFrame:
    """(vault_id, path, state): ok if the base has the manifest's hash, repairable if the disk has, else lost."""
    side = lambda df, name: df.select(*KEY, F.col("hash").alias(name))
    joined = manifest.select(*KEY, "hash").join(side(base, "base_hash"), KEY, "left").join(side(disk, "disk_hash"), KEY, "left")
    state = F.when(F.col("base_hash") == F.col("hash"), "ok").when(F.col("disk_hash") == F.col("hash"), "repairable").otherwise("lost")
    return joined.select(*KEY, state.alias("state"))


def vaults_ok(verified: DataFrame) -> DataFrame:
    return verified.groupBy("vault_id").agg(F.bool_and(F.col("state") != "lost").alias("ok"))


def dirty_paths(head: DataFrame, disk: DataFrame, tracked: Column) -> DataFrame:
    """(vault_id, path, status) of tracked paths that differ from the head."""
    both = compare(disk, head).filter(tracked)
    status = F.when(F.col("right_hash").isNull(), "A").when(F.col("left_hash").isNull(), "D").when(F.col("left_hash") != F.col("right_hash"), "M")
    return both.withColumn("status", status).filter(F.col("status").isNotNull()).select(*KEY, "status")


def manifest_digest(entries: DataFrame) -> DataFrame:
    """(vault_id, digest): SHA-256 over the sorted ``path TAB hash NL`` lines of a vault.

    The digest is of the lines' sequence, so a vault is one task's; Spark
    sorts its lines and they are read batch by batch, never all at once.
    """

    lines = entries.select(F.col("vault_id").cast("string").alias("vault_id"), F.concat("path", F.lit("\t"), "hash", F.lit("\n")).alias("line")).filter("line is not null")
    return ordered_fold(lines, ["vault_id"], ["line"], Digest())


def digest_tree(entries: DataFrame) -> DataFrame:
    """(vault_id, dir, parent, depth, digest, files): a hash tree over the directories of each vault; the root is ``''`` at depth 0.

    A directory's children, lines ``name TAB hash NL`` and ``name/ TAB digest
    NL``, fall into 256 groups by the hash of their name. A group's digest is
    of its sorted lines, a directory's of its sorted ``group TAB digest NL``
    lines. So no task has more than a share of one directory, and the levels,
    from the deepest up, are an aggregation each.
    """
    names = F.split("path", "/")
    item = lambda dir_, depth, name, line, files: (dir_.alias("dir"), depth.alias("depth"), name.alias("name"), line.alias("line"), files.alias("files"))
    name = F.element_at(names, -1)
    leaves = entries.select("vault_id", *item(F.array_join(F.slice(names, F.lit(1), F.size(names) - 1), "/"), F.size(names) - 1, name, F.concat(name, F.lit("\t"), "hash", F.lit("\n")), F.lit(1).cast("long")))
    leaves = leaves.checkpoint()
    deepest, above, out = leaves.agg(F.max("depth")).first()[0], None, None
    for depth in range(deepest or 0, -1, -1):
        here = leaves.filter(F.col("depth") == depth)
        here = here if above is None else here.unionByName(above)
        group = F.substring(F.sha2(F.col("name").cast("binary"), 256), 1, 2).alias("g")
        groups = here.groupBy("vault_id", "dir", group).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "").cast("binary"), 256).alias("d"), F.sum("files").alias("files"))
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: F.concat(x["g"], F.lit("\t"), x["d"], F.lit("\n"))), "")
        dirs = groups.groupBy("vault_id", "dir").agg(F.sha2(lines.cast("binary"), 256).alias("digest"), F.sum("files").alias("files")).checkpoint()
        own = F.element_at(F.split("dir", "/"), -1)
        parent = F.regexp_replace("dir", "/?[^/]*$", "")
        level = dirs.select("vault_id", "dir", F.when(F.col("dir") != "", parent).alias("parent"), F.lit(depth).alias("depth"), "digest", "files")
        out = level if out is None else out.unionByName(level)
        above = dirs.select("vault_id", *item(parent, F.lit(depth - 1), own, F.concat(own, F.lit("/\t"), "digest", F.lit("\n")), F.col("files")))
    return out


def changed_dirs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(vault_id, dir, state): the directories of two hash trees whose digests differ: changed, added (on the right only) or removed.

    From the roots down: a level's directories are compared only where the
    one above them differs, so that equal subtrees are left at their top.
    """
    side = lambda tree, depth, name: tree.filter(F.col("depth") == depth).select("vault_id", "dir", "parent", F.col("digest").alias(name))
    out, above, depth = None, None, 0
    while True:
        a, b = side(left, depth, "l"), side(right, depth, "r")
        if above is not None:
            a, b = (x.join(above, ["vault_id", "parent"], "left_semi") for x in (a, b))
        both = a.drop("parent").join(b.drop("parent"), ["vault_id", "dir"], "full_outer").filter(~F.col("l").eqNullSafe(F.col("r")))
        state = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").otherwise("changed")
        differing = both.select("vault_id", "dir", state.alias("state")).checkpoint()
        out = differing if out is None else out.unionByName(differing)
        if not differing.limit(1).count():
            return out
        above, depth = differing.select("vault_id", F.col("dir").alias("parent")), depth + 1


def check_pre_hash(ops: DataFrame, state: DataFrame) -> DataFrame:
    """``ops`` with verdict ok or stale: the expected hash (null: absent) is that of the state."""
    now = state.select("vault_id", F.col("path").alias("__p"), F.col("hash").alias("__now"))
    first = F.when(ops["type"] == "rename", ops["from"]).otherwise(ops["path"])
    joined = ops.withColumn("__first", first).join(now.withColumnRenamed("vault_id", "__v"), (F.col("vault_id") == F.col("__v")) & (F.col("__first") == F.col("__p")), "left")
    verdict = F.when(F.col("pre_hash").eqNullSafe(F.col("__now")), "ok").otherwise("stale")
    return joined.withColumn("verdict", verdict).drop("__v", "__p", "__now", "__first")


def restore_deleted(pending: DataFrame, base: DataFrame) -> DataFrame:
    """``pending`` with outcome: deletes get their base hash back (restored) or are missing; others are requeued."""
    joined = pending.join(base.select(*KEY, F.col("hash").alias("base_hash")), KEY, "left")
    outcome = F.when(F.col("type") != "delete", "requeued").when(F.col("base_hash").isNotNull(), "restored").otherwise("missing")
    return joined.withColumn("outcome", outcome)


def find_base_by_hash(wanted: DataFrame, commits: DataFrame, changes: DataFrame, history: int | None = None) -> DataFrame:
    """(vault_id, path, hash, commit_id, ordinal): the newest commit at which a path had a hash.

    ``history`` limits the search to that many newest commits of a vault.
    Changes that have their commit's ordinal are not joined for it.
    """
    dated = changes.filter(F.col("action") != "D")
    if "ordinal" not in changes.columns:
        dated = dated.join(commits.select("vault_id", "commit_id", "ordinal"), ["vault_id", "commit_id"])
    if history is not None:
        newest = commits.groupBy("vault_id").agg(F.max("ordinal").alias("newest"))
        dated = dated.join(newest, "vault_id").filter(F.col("ordinal") > F.col("newest") - history)
    hits = wanted.select(*KEY, "hash").join(dated, [*KEY, "hash"])
    return hits.groupBy(*KEY, "hash").agg(F.max_by("commit_id", "ordinal").alias("commit_id"), F.max("ordinal").alias("ordinal"))


def detect_renames(events: DataFrame, window: str = "250 milliseconds") -> DataFrame:
    """(vault_id, hash, from, to, ts): each delete, and the create of the same content within the window that answers it.

    ``events`` has vault_id, action (delete or create), path, hash, ts. The
    deletes of a content wait in a queue; a create takes the first one, and a
    delete leaves the queue, with a null ``to``, once more than the window has
    passed. A create that finds none waiting pairs nothing and keeps none from
    pairing. At the same time deletes come first.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select(F.col("vault_id").cast("string").alias("vault_id"), "hash", "action", "path", us.alias("us")).filter("us is not null")
    paired = ordered_fold(rows, ["vault_id", "hash"], ["us", F.desc("action"), "path"], PairRenames(window))
    return paired.select("vault_id", "hash", "from", "to", F.timestamp_micros("us").cast(events.schema["ts"].dataType).alias("ts"))
