"""Commit and tag history: latest touches, file histories, point-in-time trees, catch-up and restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkvault.functions import exprs
from sparkvault.operators.changes import reconcile

KEY = ["vault_id", "path"]
#: Tags of all vaults that are broadcast; more are joined by shuffle.
BROADCAST_TAGS = 100_000
#: Paths of all vaults that are broadcast with their newest ordinal.
BROADCAST_PATHS = 200_000


def dated(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """The changes with their commit's ordinal, author and time."""
    return changes.join(commits.select("vault_id", "commit_id", "ordinal", "author", "author_ts"), ["vault_id", "commit_id"])


def at_newest(rows: DataFrame) -> DataFrame:
    """``rows`` at the newest ordinal of their path.

    A maximum of numbers takes no sort, where one of structs has all rows
    sorted; few paths then go to the rows, which stay where they are.
    """
    newest = rows.groupBy(*KEY).agg(F.max("ordinal").alias("__ordinal")).select(*(F.col(c).alias(f"__{c}") for c in KEY), "__ordinal").checkpoint()
    same = F.col("ordinal").eqNullSafe(F.col("__ordinal"))
    for c in KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(F.broadcast(newest) if newest.count() <= BROADCAST_PATHS else newest, same, "left_semi")


def last_touch(history: DataFrame, head: DataFrame) -> DataFrame:
    """(vault_id, path, author, author_ts): who last added or changed each path that is at the head."""
    live = at_newest(history.filter(F.col("action") != "D")).join(head.select(*KEY), KEY, "left_semi")
    last = live.groupBy(*KEY).agg(F.max_by(F.struct("author", "author_ts"), F.struct("ordinal", "hash")).alias("t"))
    return last.select(*KEY, "t.author", "t.author_ts")


def snapshot_at(history: DataFrame, ordinal: Column | None = None) -> DataFrame:
    """(vault_id, path, hash): the tree at an ordinal, or at the end."""
    rows = history if ordinal is None else history.filter(F.col("ordinal") <= ordinal)
    last = at_newest(rows).groupBy(*KEY).agg(F.max(F.struct("ordinal", "action", "hash")).alias("t"))
    return last.filter(F.col("t.action") != "D").select(*KEY, "t.hash")


def resolve_ref(refs: DataFrame, tags: DataFrame, commits: DataFrame) -> DataFrame:
    """(vault_id, ref, ordinal): a ref is a tag's name or a commit id."""
    tagged = refs.join(tags.select("vault_id", F.col("name").alias("ref"), F.col("commit_id").alias("tag_commit")), ["vault_id", "ref"], "left")
    named = tagged.withColumn("commit_id", F.coalesce("tag_commit", "ref"))
    return named.join(commits.select("vault_id", F.col("commit_id").cast("string").alias("commit_id"), "ordinal"), ["vault_id", "commit_id"], "left").select("vault_id", "ref", "ordinal")


def ranked_tags(tags: DataFrame) -> DataFrame:
    """(vault_id, tags): the tags of a vault in one array of struct(ordinal, name, rank), by ordinal; rank 1 is the newest."""
    each = tags.groupBy("vault_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("ordinal", "name")))).alias("t"))
    ranked = F.transform("t", lambda x, i: F.struct(x["ordinal"].alias("ordinal"), x["name"].alias("name"), (i + 1).alias("rank")))
    return each.select("vault_id", ranked.alias("tags"))


def _with_tags(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """``rows`` with the ranked tags of their vault as one array; few tags go to the rows, which then stay where they are."""
    few = tags.limit(BROADCAST_TAGS + 1).count() <= BROADCAST_TAGS
    return rows.join(F.broadcast(ranked_tags(tags)) if few else ranked_tags(tags), "vault_id")


def path_spans(history: DataFrame) -> DataFrame:
    """(vault_id, path, start, until, hash): the ordinals from which and before which a path is there with a content; until is null at the head."""
    # Dealt out by path before, so that the states and the window over them take one shuffle.
    last = history.repartition(*KEY).groupBy(*KEY, "ordinal").agg(F.max(F.struct("action", "hash")).alias("t"))
    until = F.lead("ordinal").over(Window.partitionBy(*KEY).orderBy("ordinal"))
    return last.withColumn("until", until).filter(F.col("t.action") != "D").select(*KEY, F.col("ordinal").alias("start"), "until", "t.hash")


def tag_trees(history: DataFrame, tags: DataFrame) -> DataFrame:
    """(vault_id, rank, name, path, hash): the tree of every tag; rank 1 is the newest.

    One row for each path and tag at which it is there: the states of a path
    become intervals of ordinals. Each interval meets its vault's tags as one
    array and keeps those inside, so that a row is made only where a path is
    in a tag; an array grows with the tags of a vault, not with its history.
    """
    inside = lambda t: (t["ordinal"] >= F.col("start")) & (F.col("until").isNull() | (t["ordinal"] < F.col("until")))
    met = _with_tags(path_spans(history), tags).select(*KEY, "hash", F.explode(F.filter("tags", inside)).alias("t"))
    return met.select("vault_id", "t.rank", "t.name", "path", "hash")


def changed_between_versions(trees: DataFrame) -> DataFrame:
    """(vault_id, path, name): tags whose hash of a path differs from the next older tag's."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("rank"))
    older, gap = F.lag("hash").over(w), F.lag("rank").over(w) - F.col("rank")
    return trees.withColumn("older", older).withColumn("gap", gap).filter((F.col("gap") == 1) & (F.col("older") != F.col("hash"))).select(*KEY, "name", "rank")


def file_history(trees: DataFrame, tags_per_vault: DataFrame) -> DataFrame:
    """(vault_id, path, first_tag, last_tag, changed_at): newest first; last_tag is null while it is in the newest tag.

    A change counts where two neighbouring tags both have the path; being in
    the oldest tag counts as a change there.
    """
    w = Window.partitionBy(*KEY).orderBy("rank")
    newer, older, old_hash = F.coalesce(F.lag("rank").over(w), F.lit(0)), F.lead("rank").over(w), F.lead("hash").over(w)
    # All that a row has to do with its neighbours comes from one window, whose rows the aggregation then takes as they lie.
    marked = trees.select(*KEY, "rank", "name", (F.col("rank") - newer > 1).alias("gone"), F.coalesce((older == F.col("rank") + 1) & (old_hash != F.col("hash")), F.lit(False)).alias("changed"))
    ends = marked.groupBy(*KEY).agg(
        F.max_by(F.struct("name", "rank"), "rank").alias("first"), F.min_by(F.when(F.col("gone"), F.col("name")), F.when(F.col("gone"), F.col("rank"))).alias("last_tag"),
        F.array_sort(F.collect_list(F.when(F.col("changed"), F.struct("rank", "name")))).alias("c"),
    )
    oldest = F.when(F.col("first.rank") == F.col("tags"), F.array(F.col("first.name"))).otherwise(F.array().cast("array<string>"))
    names = F.concat(F.transform("c", lambda p: p["name"]), oldest)
    return ends.join(tags_per_vault.select("vault_id", "tags"), "vault_id").select(*KEY, F.col("first.name").alias("first_tag"), "last_tag", names.alias("changed_at"))


def version_markers(trees: DataFrame, tags: DataFrame) -> DataFrame:
    """(vault_id, path, name, marker): default, changed_here, not_yet or deleted, for every path and tag.

    A path's first and last tag and those where it changed come from one pass
    over the trees; they then meet the vault's tags as one array.
    """
    w = Window.partitionBy(*KEY).orderBy("rank")
    changed = F.when((F.lead("rank").over(w) == F.col("rank") + 1) & (F.lead("hash").over(w) != F.col("hash")), F.col("rank"))
    paths = trees.select(*KEY, "rank", changed.alias("c")).groupBy(*KEY).agg(F.max("rank").alias("first"), F.min("rank").alias("last"), F.collect_set("c").alias("changed"))
    grid = _with_tags(paths, tags).select(*KEY, "first", "last", "changed", F.explode("tags").alias("t")).select(*KEY, "first", "last", "changed", "t.name", "t.rank")
    marker = (
        F.when(F.col("rank") > F.col("first"), "not_yet").when(F.col("rank") < F.col("last"), "deleted")
        .when(F.array_contains("changed", F.col("rank")), "changed_here").otherwise("default")
    )
    return grid.select(*KEY, "name", marker.alias("marker"))


def catchup_ops(history: DataFrame, base: Column, head: Column | None = None) -> DataFrame:
    """(vault_id, path, type, hash, author, ordinal): the latest change of each path after the base, in order."""
    rows = history.filter(F.col("ordinal") > base)
    if head is not None:
        rows = rows.filter(F.col("ordinal") <= head)
    last = rows.groupBy(*KEY).agg(F.max(F.struct("ordinal", "action", "hash", "author")).alias("t"))
    kind = F.when(F.col("t.action") == "D", "delete").otherwise("write")
    return last.select(*KEY, kind.alias("type"), F.when(kind == "write", F.col("t.hash")).alias("hash"), "t.author", "t.ordinal")


def bootstrap_ops(head: DataFrame, admitted: Column) -> DataFrame:
    """One write for every admitted file at the head, without an author."""
    return head.filter(admitted).select(*KEY, F.lit("write").alias("type"), "hash")


def log_entries(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """``commits`` with the sorted array of the files each touched."""
    files = changes.groupBy("vault_id", "commit_id").agg(F.array_sort(F.collect_set("path")).alias("files"))
    return commits.join(files, ["vault_id", "commit_id"], "left")


def history_page(commits: DataFrame, before: Column | None = None, since: Column | None = None, limit: int = 50) -> DataFrame:
    """The newest commits of each vault below a cursor, up to the first that is older than ``since``."""
    rows = commits if before is None else commits.filter(F.col("ordinal") < before)
    newest = Window.partitionBy("vault_id").orderBy(F.desc("ordinal"))
    if since is not None:
        old = F.max((F.col("author_ts") < since).cast("int")).over(newest.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("__old", old).filter(F.col("__old") == 0).drop("__old")
    return rows.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= min(limit, 200))


def tag_list(tags: DataFrame, prefix: str = "") -> DataFrame:
    """Tags with kind review or tag and their place, newest first, then by falling name."""
    kind = F.when(F.col("name").startswith(exprs.REVIEW_PREFIX), "review").otherwise("tag")
    place = F.row_number().over(Window.partitionBy("vault_id").orderBy(F.desc("created_at"), F.desc("name")))
    return tags.filter(F.col("name").startswith(prefix)).withColumn("kind", kind).withColumn("place", place)


def filter_tags_by_mode(tags: DataFrame, mode: str = "all") -> DataFrame:
    review = F.col("name").startswith(exprs.REVIEW_PREFIX)
    return tags.filter(review if mode == "only_reviewed" else ~review if mode == "only_versioned" else F.lit(True))


def tag_set_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(vault_id, name, change): added or removed."""
    key = ["vault_id", "name"]
    added = new.select(*key).exceptAll(old.select(*key)).withColumn("change", F.lit("added"))
    return added.unionByName(old.select(*key).exceptAll(new.select(*key)).withColumn("change", F.lit("removed")))


def tags_without(tags: DataFrame, dropped: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) by the columns of ``by``: name or commit_id with vault_id."""
    return tags.join(dropped.select(*by).distinct(), by, "left_anti"), tags.join(dropped.select(*by).distinct(), by, "left_semi")


def restore_ops(history: DataFrame, ordinal: Column) -> DataFrame:
    """The ops that make the head's tree equal the tree at an ordinal."""
    return reconcile(snapshot_at(history, ordinal), snapshot_at(history))


def revert_ops(history: DataFrame, commit_ids: DataFrame) -> DataFrame:
    """(vault_id, path, type, hash, conflict): the inverse of the given commits' changes.

    A path that changed again later is in conflict.
    """
    per_commit = history.groupBy(*KEY, "ordinal", "commit_id").agg(F.max(F.struct("action", "hash")).alias("t"))
    w = Window.partitionBy(*KEY).orderBy("ordinal")
    stepped = per_commit.withColumn("before", F.lag("t").over(w)).withColumn("later", F.lead("ordinal").over(w).isNotNull())
    rows = stepped.join(commit_ids.select("vault_id", "commit_id").distinct(), ["vault_id", "commit_id"], "left_semi")
    absent = F.col("before").isNull() | (F.col("before.action") == "D")
    return rows.select(*KEY, "commit_id", F.when(absent, "delete").otherwise("write").alias("type"), F.when(~absent, F.col("before.hash")).alias("hash"), F.col("later").alias("conflict"))


def drift_check(clients: DataFrame, commits: DataFrame, digests: DataFrame) -> DataFrame:
    """``clients`` (vault_id, base, digest) with state: bootstrap, base_lost, up_to_date or catchup."""
    known = commits.select("vault_id", F.col("commit_id").alias("base"), F.col("ordinal").alias("base_ordinal"))
    heads = commits.groupBy("vault_id").agg(F.max("ordinal").alias("head_ordinal"))
    joined = clients.join(known, ["vault_id", "base"], "left").join(heads, "vault_id", "left").join(digests.withColumnRenamed("digest", "head_digest"), "vault_id", "left")
    state = (
        F.when(F.col("base").isNull(), "bootstrap").when(F.col("base_ordinal").isNull(), "base_lost")
        .when((F.col("base_ordinal") == F.col("head_ordinal")) & F.col("digest").eqNullSafe(F.col("head_digest")), "up_to_date").otherwise("catchup")
    )
    return joined.withColumn("state", state)


def trash_listing(trash: DataFrame) -> DataFrame:
    """(vault_id, bucket, path, place): buckets newest first, then paths."""
    place = F.row_number().over(Window.partitionBy("vault_id").orderBy(F.desc("bucket"), "path"))
    return trash.withColumn("place", place)


def trash_restore(trash: DataFrame) -> DataFrame:
    """The newest bucket of every path."""
    return trash.groupBy(*KEY).agg(F.max("bucket").alias("bucket"))


def file_meta(files: DataFrame, touched: DataFrame, has_history: Column) -> DataFrame:
    """``files`` with has_history and, for history files only, who updated them and when."""
    joined = files.withColumn("has_history", has_history).join(touched.select(*KEY, F.col("author").alias("updated_by"), F.col("author_ts").alias("updated_at")), KEY, "left")
    only = lambda c: F.when(F.col("has_history"), F.col(c)).alias(c)
    return joined.select(*files.columns, "has_history", only("updated_by"), only("updated_at"))
