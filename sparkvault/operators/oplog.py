"""Op logs: coalescing, filtering, numbering, classification, batches and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkvault.functions import exprs, predicates
from sparkvault.operators.fold import Debounce, PackBatches, RateLimit, StuckWrites, ordered_fold


def _micros(ts: Column | str) -> Column:
    """Microseconds of a timestamp of either kind."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def coalesce_writes(ops: DataFrame, by: str = "client_id", order: str = "seq") -> DataFrame:
    """Neighbouring writes of one path become one: the first seq and pre_hash, the last data and ts."""
    w = Window.partitionBy(by).orderBy(order)
    same = (F.col("type") == "write") & (F.lag("type").over(w) == "write") & (F.col("path") == F.lag("path").over(w))
    runs = ops.withColumn("__new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("__run", F.sum("__new").over(w))
    first, last = {"seq", "pre_hash"}, [c for c in ops.columns if c not in (by, "seq", "pre_hash")]
    kept = [c for c in ops.columns if c in first]
    out = runs.groupBy(by, "__run").agg(
        F.min_by(F.struct(*kept), order).alias("f"), F.max_by(F.struct(*last), order).alias("l")
    )
    return out.select(by, "f.*", "l.*").select(*ops.columns)


def filter_acked(ops: DataFrame, acked: DataFrame, by: str = "client_id", position: str = "pos") -> DataFrame:
    """The tail of every batch from the first seq above the client's high water on.

    A batch whose tail does not rise strictly is marked ``rejected``.
    """
    joined = ops.join(acked.select(by, "high"), by, "left").withColumn("high", F.coalesce("high", F.lit(0)))
    whole = Window.partitionBy(by)
    start = F.min(F.when(F.col("seq") > F.col("high"), F.col(position))).over(whole)
    tail = joined.withColumn("__start", start).filter(F.col(position) >= F.col("__start"))
    rises = F.coalesce(F.col("seq") > F.lag("seq").over(Window.partitionBy(by).orderBy(position)), F.lit(True))
    return tail.withColumn("__rises", rises).withColumn("rejected", ~F.min("__rises").over(whole)).drop("__start", "__rises", "high")


def assign_seq(ops: DataFrame, staged: DataFrame, next_seq: DataFrame, by: str = "client_id", order: str = "path") -> DataFrame:
    """Consecutive numbers from next_seq on for ops whose path is not staged."""
    free = ops.join(staged.select(by, "path").distinct(), [by, "path"], "left_anti").join(next_seq.select(by, "next_seq"), by)
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return free.withColumn("seq", F.col("next_seq") + place - 1).drop("next_seq")


def drop_self_echo(incoming: DataFrame, acked: DataFrame) -> DataFrame:
    """Incoming ops that their author has not acked already."""
    mine = acked.select(F.col("client_id").alias("author"), "seq").distinct()
    return incoming.join(mine, ["author", "seq"], "left_anti")


def drop_paths(ops: DataFrame, refused: DataFrame) -> DataFrame:
    return ops.join(refused.select("path").distinct(), "path", "left_anti")


def retain_from_seq(ops: DataFrame, least: DataFrame, by: str = "client_id") -> DataFrame:
    return ops.join(least.select(by, "least"), by, "left").filter(F.col("seq") >= F.coalesce("least", F.lit(0))).drop("least")


def append_unique_seq(acked: DataFrame, more: DataFrame, by: str = "client_id") -> DataFrame:
    return acked.unionByName(more.join(acked.select(by, "seq"), [by, "seq"], "left_anti").select(*acked.columns))


def pending_commit_status(acked: DataFrame, manifest: DataFrame) -> DataFrame:
    """``acked`` with committed: a write's hash is there, a delete's path absent, a rename's from absent and to there."""
    at = lambda name: manifest.select(F.col("vault_id"), F.col("path").alias(f"__{name}"), F.col("hash").alias(f"__{name}_hash"))
    first = exprs.primary_path(F.col("type"), F.col("path"), F.col("from"))
    rows = acked.withColumn("__first", first).join(at("first"), ["vault_id", "__first"], "left")
    rows = rows.withColumn("__to", F.col("to")).join(at("to"), ["vault_id", "__to"], "left")
    gone = F.col("__first_hash").isNull()
    committed = (
        F.when(F.col("type") == "write", F.col("__first_hash").eqNullSafe(F.col("hash")))
        .when(F.col("type") == "delete", gone).otherwise(gone & F.col("__to_hash").isNotNull())
    )
    return rows.withColumn("committed", committed).select(*acked.columns, "committed")


def overlapping_writers(incoming: DataFrame, staged: DataFrame) -> DataFrame:
    """Clients' incoming ops that touch a path that another client has staged."""
    touched = lambda df: df.withColumn("touched", F.explode(F.array_compact(F.array("path", "from", "to"))))
    theirs = touched(staged).select("touched", F.col("client_id").alias("other")).distinct()
    mine = touched(incoming)
    return mine.join(theirs, (mine["touched"] == theirs["touched"]) & (mine["client_id"] != theirs["other"]), "left_semi").drop("touched").distinct()


def classify(incoming: DataFrame, staged: DataFrame, diff_mode: str = "inline") -> DataFrame:
    """The decision for every incoming op against the staged op at its path, or at an end of its rename.

    Both have vault_id, type, path, from, to, hash, binary; incoming has an
    id. The result has id, staged_seq, action, kind, format. A write against a
    write is ``merge`` unless a side is binary: its texts go to the line merge.
    A theta join on either end becomes an equi join by listing the ends.
    """
    ends = F.array_distinct(F.array_compact(F.array("path", "from", "to")))
    left = incoming.select("vault_id", "id", "type", "path", "from", "to", "binary", F.explode(ends).alias("at"))
    key = exprs.primary_path(F.col("type"), F.col("path"), F.col("from"))
    both_ends = F.when(F.col("type") == "rename", F.array("from", "to")).otherwise(F.array(key))
    right = staged.select(
        "vault_id", F.explode(both_ends).alias("at"), key.alias("s_key"),
        *(F.col(c).alias(f"s_{c}") for c in ("seq", "type", "path", "from", "to", "binary")),
    )
    # One staged op answers an incoming one: that at its source before that at its destination, then the first.
    hits = left.join(right, ["vault_id", "at"])
    rank = F.struct((F.col("at") != exprs.primary_path(F.col("type"), F.col("path"), F.col("from"))).cast("int").alias("far"), F.col("s_seq"))
    chosen = hits.groupBy("vault_id", "id").agg(
        F.min_by(F.struct("s_seq", "s_type", "s_key", "s_from", "s_to", "s_binary"), rank).alias("s")
    ).select("vault_id", "id", "s.*")
    rows = incoming.join(chosen, ["vault_id", "id"], "left")
    is_, s_is = (lambda t: F.col("type") == t), (lambda t: F.col("s_type") == t)
    binary = F.coalesce("binary", F.lit(False)) | F.coalesce("s_binary", F.lit(False))
    fmt = predicates.conflict_format(F.col("path"), diff_mode)
    at_dest = (F.col("s_key") == F.col("to")) & (F.col("s_key") != F.col("from"))
    decided = lambda action, kind=None, form=None: F.struct(
        F.lit(action).alias("action"), (F.lit(kind) if not isinstance(kind, Column) else kind).cast("string").alias("kind"),
        (form if isinstance(form, Column) else F.lit(form)).cast("string").alias("format"),
    )
    alone = F.when(is_("write"), decided("apply")).when(is_("delete"), decided("apply_delete")).when(is_("rename"), decided("apply_rename"))
    decision = (
        F.when(F.col("s_type").isNull(), alone)
        .when(is_("write") & s_is("write"), F.when(binary, decided("apply", "binary", "sidecar")).otherwise(decided("merge")))
        .when(is_("write") & s_is("delete"), decided("write_sidecar", "edit_vs_delete", "sidecar"))
        .when(is_("write") & s_is("rename"), decided("apply", "rename_collision", "sidecar"))
        .when(
            is_("delete") & s_is("write"),
            F.when(binary | (fmt == "sidecar"), decided("write_sidecar", "delete_vs_edit", "sidecar")).otherwise(decided("write_conflict", "delete_vs_edit", fmt)),
        )
        .when(is_("delete") & s_is("delete"), decided("noop"))
        .when(is_("delete") & s_is("rename"), decided("noop", "rename_collision"))
        .when(is_("rename") & s_is("write"), F.when(at_dest, decided("apply_rename", "rename_collision", "sidecar")).otherwise(decided("apply_rename")))
        .when(
            is_("rename") & s_is("rename") & (F.col("from") == F.col("s_from")),
            decided("apply_rename", F.when(F.col("to") != F.col("s_to"), "rename_collision")),
        )
        .when(is_("rename") & s_is("delete"), decided("apply_rename"))
        .otherwise(decided("noop"))
    )
    return rows.select("vault_id", "id", F.col("s_seq").alias("staged_seq"), decision.alias("d")).select("vault_id", "id", "staged_seq", "d.*")


def resolve_collisions(local: DataFrame, incoming: DataFrame, taken: DataFrame) -> DataFrame:
    """(vault_id, path, client_id, new_path): local files at an incoming path with other content, and the first free name.

    Names are ``stem.key.ext`` and then ``stem.key.1.ext`` and on. Every taken
    path says which number of which name it is; the first number missing is free.
    """
    clash = local.alias("l").join(incoming.alias("i"), ["vault_id", "path"]).filter(F.col("l.hash") != F.col("i.hash")).select("vault_id", "path", "l.client_id").distinct()
    ext = F.regexp_extract("path", r"[^/](\.[^./]*)$", 1)
    stem = F.substring("path", F.lit(1), F.length("path") - F.length(ext))
    asked = clash.withColumns({"ext": ext, "head": F.concat(stem, F.lit("."), "client_id")})
    number = F.struct(F.expr("try_cast(regexp_extract(path, r, 2) as bigint)").alias("n"), F.expr("regexp_extract(path, r, 1)").alias("head"), F.expr("regexp_extract(path, r, 3)").alias("ext"))
    forms = F.explode(F.array(F.lit(r"^(.*)()(\.[^./]*)$"), F.lit(r"^(.*)()()$"), F.lit(r"^(.*)\.([1-9][0-9]*)(\.[^./]*)$"), F.lit(r"^(.*)\.([1-9][0-9]*)()$")))
    read = taken.select("vault_id", "path", forms.alias("r")).filter(F.regexp_like("path", F.col("r"))).select("vault_id", number.alias("t"), F.contains("r", F.lit("[1-9]")).alias("numbered"))
    used = read.filter(~F.col("numbered") | F.col("t.n").isNotNull()).select("vault_id", "t.head", "t.ext", F.coalesce("t.n", F.lit(0).cast("long")).alias("n")).distinct()
    found = asked.join(used, ["vault_id", "head", "ext"], "left")
    place = F.row_number().over(Window.partitionBy("vault_id", "path", "client_id").orderBy("n")) - 1
    free = found.withColumn("place", place).groupBy("vault_id", "path", "client_id", "head", "ext").agg(F.count_if(F.col("n") == F.col("place")).alias("n"))
    suffix = F.when(F.col("n") == 0, "").otherwise(F.concat(F.lit("."), F.col("n").cast("string")))
    return free.select("vault_id", "path", "client_id", F.concat("head", suffix, "ext").alias("new_path"))


def idempotency_highwater(ops: DataFrame, by: str = "client_id", since: Column | None = None, most: int | None = None) -> DataFrame:
    """(client, high, last_ts): pruned by age, and to the ``most`` latest clients."""
    out = ops.groupBy(by).agg(F.max("seq").alias("high"), F.max("ts").alias("last_ts"))
    if since is not None:
        out = out.filter(F.col("last_ts") >= since)
    return out.orderBy(F.desc("last_ts"), by).limit(most) if most is not None else out


def stage_stats(ops: DataFrame, by: str = "client_id") -> DataFrame:
    """(client, ops, write_bytes, first_ts, last_ts) of every stage."""
    size = F.when(F.col("type") == "write", F.octet_length("data")).otherwise(0)
    return ops.groupBy(by).agg(F.count("*").alias("ops"), F.sum(size).alias("write_bytes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def flush_reason(stats: DataFrame, now: Column, quiet_s: int = 3, max_delay_s: int = 60, max_bytes: int = 50 << 20, max_ops: int = 200) -> DataFrame:
    """``stats`` with the first of byte_cap, file_cap, max_delay, quiet that holds at ``now``."""
    age = lambda c: _micros(now) - _micros(c)
    reason = (
        F.when(F.col("write_bytes") >= max_bytes, "byte_cap").when(F.col("ops") >= max_ops, "file_cap")
        .when(age("first_ts") >= max_delay_s * 1_000_000, "max_delay").when(age("last_ts") >= quiet_s * 1_000_000, "quiet")
    )
    return stats.withColumn("reason", reason)


def stuck_writes(ops: DataFrame, commits: DataFrame | None = None, depth: int = 3) -> DataFrame:
    """(vault_id, client_id, path, seq, stuck) of ``ops``: the hash is among the last ``depth`` accepted of the same client and path.

    ``ops`` has vault_id, client_id, path, seq, hash, ts; ``commits`` has
    vault_id, path, ts: a commit that touches a path, by either end of a
    rename, has the path's writes of all clients forgotten. At the same time
    writes come before commits. A path's ops and commits are one sequence.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    writes = ops.select("vault_id", "path", "client_id", F.col("seq").cast("long").alias("seq"), "hash", us, F.lit("write").alias("kind"))
    if commits is not None:
        none = lambda kind: F.lit(None).cast(kind)
        cleared = commits.select("vault_id", "path", none("string").alias("client_id"), none("long").alias("seq"), none("string").alias("hash"), us, F.lit("commit").alias("kind"))
        writes = writes.unionByName(cleared.distinct())
    return ordered_fold(writes, ["vault_id", "path"], ["us", F.desc("kind"), "client_id", "seq"], StuckWrites(depth))


def rate_limit(events: DataFrame, limit: int, seconds: int, by: str = "client_id") -> DataFrame:
    """``events`` with in_window, the earlier ones within ``seconds``, and exceeded. All events count, the refused ones too."""
    w = Window.partitionBy(by).orderBy(_micros("ts")).rangeBetween(-seconds * 1_000_000, -1)
    return events.withColumn("in_window", F.count("*").over(w)).withColumn("exceeded", F.col("in_window") >= limit)


def rate_limit_accepted(events: DataFrame, limit: int, seconds: int, by: str = "client_id") -> DataFrame:
    """(client, seq, in_window, refused): as :func:`rate_limit`, but only events that were not refused count. At the same time by seq."""
    rows = events.select(F.col(by).cast("string").alias(by), F.col("seq").cast("long").alias("seq"), _micros("ts").alias("us"))
    return ordered_fold(rows, [by], ["us", "seq"], RateLimit(limit, seconds, by))


def debounce_batches(ops: DataFrame, idle_s: float, by: str = "client_id", max_delay_s: float | None = None) -> DataFrame:
    """(client, batch, ops, first_ts, last_ts): a batch closes at an idle gap above ``idle_s``, or ``max_delay_s`` after its first op.

    Gaps alone are runs by windows. The longest delay counts from the batch's
    own first op, so with it Spark sorts each client's ops and they are read
    batch by batch with two times carried on.
    """
    agg = [F.count("*").alias("ops"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")]
    if max_delay_s is None:
        w = Window.partitionBy(by).orderBy("ts", "seq")
        new = F.coalesce((_micros("ts") - _micros(F.lag("ts").over(w)) > int(idle_s * 1_000_000)).cast("int"), F.lit(0))
        runs = ops.withColumn("__new", new).withColumn("batch", F.sum("__new").over(w))
        return runs.groupBy(by, "batch").agg(*agg)
    of_client, of_ts = (ops.schema[c].dataType for c in (by, "ts"))
    rows = ops.select(F.col(by).alias("by"), "seq", _micros("ts").alias("us"))
    walked = ordered_fold(rows, ["by"], ["us", "seq"], Debounce(idle_s, max_delay_s, of_client.simpleString()))
    return walked.withColumn("ts", F.timestamp_micros("us").cast(of_ts)).groupBy(F.col("by").alias(by), "batch").agg(*agg)


def pack_batches_approx(ops: DataFrame, size: Column, target: int, by: str = "client_id", order: str = "seq") -> DataFrame:
    """``ops`` with chunk, the running size divided by the target: chunks of about it, without a sequential pass."""
    w = Window.partitionBy(by).orderBy(order)
    return ops.withColumn("chunk", F.floor((F.sum(size).over(w) - size) / target))


def pack_batches(ops: DataFrame, size: Column, target: int, by: str = "client_id", order: str = "seq") -> DataFrame:
    """(client, seq, chunk, more): greedy chunks in order; an op above the target has a chunk of its own.

    Sequential by nature: Spark deals the logs out by client and sorts them,
    and a log is read batch by batch with two numbers carried on.
    """
    rows = ops.select(F.col(by).alias("by"), F.col(order).cast("long").alias("seq"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"))
    packed = ordered_fold(rows, ["by"], ["seq"], PackBatches(target, ops.schema[by].dataType.simpleString()))
    last = packed.groupBy(F.col("by").alias("client")).agg(F.max("chunk").alias("last"))
    return packed.join(last, F.col("by").eqNullSafe(F.col("client"))).select(F.col("by").alias(by), "seq", "chunk", (F.col("chunk") < F.col("last")).alias("more"))


def _shown(ops: DataFrame) -> Column:
    """Whether all clients see an op: it touches no config or control path at either end."""
    shown = F.lit(True)
    for c in (c for c in ("path", "from", "to") if c in ops.columns):
        shown = shown & ~F.coalesce(predicates.path_class(F.col(c)).isin("config", "control"), F.lit(False))
    return shown


def fanout_ops(batches: DataFrame, clients: DataFrame) -> DataFrame:
    """Every op for each other client of its vault; those that touch a config or control path, at either end, for admins alone."""
    to = clients.select("vault_id", F.col("client_id").alias("recipient"), "admin")
    pairs = batches.join(to, "vault_id").filter(F.col("recipient") != F.col("client_id"))
    return pairs.filter(F.col("admin") | _shown(batches))


def sent_ops(batches: DataFrame) -> DataFrame:
    """(vault_id, client_id, shown, n): how many ops each client sends, those that all clients see and the others."""
    return batches.groupBy("vault_id", "client_id", _shown(batches).alias("shown")).agg(F.count("*").alias("n"))


def fanout_counts(sent: DataFrame, clients: DataFrame) -> DataFrame:
    """(vault_id, recipient, admin, ops): how many ops :func:`fanout_ops` has for each row of ``clients``, from :func:`sent_ops`.

    A client gets all of its vault's ops that it may see, but for its own, so
    that no pair of an op and a client is made.
    """
    known = sent.filter(F.col("client_id").isNotNull())
    both = lambda name: (F.sum("n").alias(f"{name}_all"), F.sum(F.when(F.col("shown"), F.col("n")).otherwise(0)).alias(f"{name}_shown"))
    to = clients.filter(F.col("client_id").isNotNull()).select("vault_id", F.col("client_id").alias("recipient"), "admin")
    own = known.groupBy("vault_id", F.col("client_id").alias("recipient")).agg(*both("own"))
    met = to.join(known.groupBy("vault_id").agg(*both("vault")), "vault_id").join(own, ["vault_id", "recipient"], "left")
    of = lambda what: F.col(f"vault_{what}") - F.coalesce(f"own_{what}", F.lit(0))
    return met.select("vault_id", "recipient", "admin", F.when(F.col("admin"), of("all")).otherwise(of("shown")).alias("ops")).filter("ops > 0")


def visible_ops(ops: DataFrame, admin: Column) -> DataFrame:
    """Ops without those that touch a config path at either end, unless ``admin``."""
    config = lambda c: F.coalesce(predicates.path_class(F.col(c)) == "config", F.lit(False))
    return ops.filter(admin | ~(config("path") | config("from") | config("to")))


def apply_ops(snapshot: DataFrame, ops: DataFrame) -> DataFrame:
    """(vault_id, path, hash): the tree after writes, deletes and renames in order of seq.

    A rename moves what its source held before; of a source that holds nothing
    the target is absent. ``seq`` is unique in a vault. A path's life is a list
    of spans between the ops that touch it, and a rename's target points at the
    span of its source that ends there. Pointers over pointers are followed
    with a doubled step each round, so that a chain of n renames takes log2(n)
    joins of the renames alone; without renames none is made.
    """
    start = snapshot.select("vault_id", "path", F.lit(None).cast("long").alias("seq"), F.lit("write").alias("does"), "hash", F.lit(None).cast("string").alias("src"))
    seq = F.col("seq").cast("long").alias("seq")
    has = lambda name, kind="string": F.col(name) if name in ops.columns else F.lit(None).cast(kind)
    plain = ops.filter("type in ('write', 'delete')").select("vault_id", "path", seq, F.col("type").alias("does"), F.when(F.col("type") == "write", F.col("hash")).alias("hash"), F.lit(None).cast("string").alias("src"))
    moves = ops.filter((F.col("type") == "rename") & (has("from") != has("to")))
    none = F.lit(None).cast("string")
    leave = moves.select("vault_id", has("from").alias("path"), seq, F.lit("leave").alias("does"), none.alias("hash"), none.alias("src"))
    come = moves.select("vault_id", has("to").alias("path"), seq, F.lit("come").alias("does"), none.alias("hash"), has("from").alias("src"))
    touches = start.unionByName(plain).unionByName(leave).unionByName(come)
    # A span goes by its first op's seq; ``before`` is the span of the path before it.
    w = Window.partitionBy("vault_id", "path").orderBy("at")
    spans = touches.withColumn("at", F.coalesce("seq", F.lit(-(1 << 62))))
    spans = spans.withColumn("before", F.lag("at").over(w)).withColumn("is_last", F.lead("at").over(w).isNull())
    written = spans.filter("does = 'write'")
    settled = written.filter("is_last").select("vault_id", "path", "hash")
    if "from" not in ops.columns or not moves.limit(1).count():
        return settled
    left_at = spans.filter("does = 'leave' and before is not null").select("vault_id", F.col("path").alias("src"), "seq", F.col("before").alias("src_at"))
    chain = spans.filter("does = 'come'").join(left_at, ["vault_id", "src", "seq"]).select("vault_id", "path", "at", "is_last", "src", "src_at").checkpoint()
    while True:
        further = chain.select("vault_id", F.col("path").alias("src"), F.col("at").alias("src_at"), F.struct("src", "src_at").alias("next"))
        ended = spans.filter("does = 'come'").select("vault_id", F.col("path").alias("src"), F.col("at").alias("src_at"), F.lit(True).alias("come"))
        stepped = chain.join(further, ["vault_id", "src", "src_at"], "left").join(ended, ["vault_id", "src", "src_at"], "left")
        # A target that came from nothing has no pointer, and so has nothing to give.
        stepped = stepped.filter("next is not null or come is null")
        go_on = F.col("next").isNotNull()
        chain = stepped.select("vault_id", "path", "at", "is_last", F.when(go_on, F.col("next.src")).otherwise(F.col("src")).alias("src"), F.when(go_on, F.col("next.src_at")).otherwise(F.col("src_at")).alias("src_at"), go_on.alias("moved")).checkpoint()
        if not chain.filter("moved").limit(1).count():
            break
        chain = chain.drop("moved")
    source = written.select("vault_id", F.col("path").alias("src"), F.col("at").alias("src_at"), "hash")
    return settled.unionByName(chain.filter("is_last").join(source, ["vault_id", "src", "src_at"]).select("vault_id", "path", "hash"))


def vault_usage(state: DataFrame, sizes: str = "size") -> DataFrame:
    return state.groupBy("vault_id").agg(F.count("*").alias("files"), F.sum(sizes).alias("bytes"))


def would_exceed(usage: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """``usage`` with reason file_count, total_bytes or null."""
    return usage.withColumn("reason", F.when(F.col("files") > max_files, "file_count").when(F.col("bytes") > max_bytes, "total_bytes"))


def sort_by_seq(ops: DataFrame, by: str = "client_id") -> DataFrame:
    """Ops in the order of their client and number."""
    return ops.orderBy(by, "seq")


def pending_conflicts(log: DataFrame, since: Column | None = None, resolved: DataFrame | None = None) -> DataFrame:
    """The latest entry of every (vault_id, path) from ``since`` on, with resolved; newest first is the caller's sort.

    ``resolved`` has the (vault_id, path) whose text holds no marker any more.
    """
    rows = log if since is None else log.filter(F.col("ts") >= since)
    rest = [c for c in log.columns if c not in ("vault_id", "path")]
    latest = rows.groupBy("vault_id", "path").agg(F.max_by(F.struct(*rest), F.struct("ts", *(c for c in rest if c != "ts"))).alias("e"))
    latest = latest.select("vault_id", "path", "e.*")
    if resolved is None:
        return latest.withColumn("resolved", F.lit(False))
    marked = resolved.select("vault_id", "path", F.lit(True).alias("resolved")).distinct()
    return latest.join(marked, ["vault_id", "path"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
