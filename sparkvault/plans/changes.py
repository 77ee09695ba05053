"""Registered queries of the snapshot, op-log and history operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkvault.functions import predicates as P
from sparkvault.operators import changes as C
from sparkvault.operators import history as H
from sparkvault.operators import oplog as O
from sparkvault.plans import views as V
from sparkvault.plans.views import with_views

QUERIES, ORACLE = {}, {}


def register(name: str, query, sql: str | None = None, *views: str) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = with_views(sql, *views) if views else sql


def pending(s, d):
    """Pending paths: ops whose paths are those of the documents of their events' numbers."""
    m = V.manifest(s, d)
    e = V.table(s, d, "events").filter(F.col("event_type") == "purchase")
    return m.join(e.select(F.col("event_id").alias("doc_id")), "doc_id", "left_semi")


PENDING = "pending AS (SELECT vault_id, path FROM manifest WHERE doc_id IN (SELECT event_id FROM events WHERE event_type = 'purchase'))"
BOTH = "b AS (SELECT coalesce(d.vault_id, m.vault_id) AS vault_id, coalesce(d.path, m.path) AS path, d.hash AS dh, m.hash AS mh FROM disk d FULL JOIN manifest m ON d.vault_id = m.vault_id AND d.path = m.path)"
RECON = f"""{BOTH}, recon AS (SELECT vault_id, path, CASE WHEN dh IS NULL THEN 'delete' ELSE 'write' END AS type,
    CASE WHEN mh IS NULL THEN 'add' WHEN dh IS NULL THEN 'delete' ELSE 'modify' END AS change, mh AS pre_hash, dh AS hash FROM b WHERE dh IS DISTINCT FROM mh)"""

register(
    "j1_reconcile", lambda s, d: C.reconcile(V.disk(s, d), V.manifest(s, d), pending(s, d)),
    f"WITH {RECON}, {PENDING} SELECT recon.* FROM recon ANTI JOIN pending USING (vault_id, path)", "disk", "manifest",
)
register(
    "j2_diff_snapshots", lambda s, d: C.diff_snapshots(V.manifest(s, d), V.disk(s, d)),
    f"""WITH {BOTH}, c AS (SELECT vault_id, path, CASE WHEN mh IS NULL THEN 'A' WHEN dh IS NULL THEN 'D' ELSE 'M' END AS status FROM b WHERE dh IS DISTINCT FROM mh),
    t AS (SELECT c.*, string_split(regexp_replace(coalesce(d.text, ''), '\\n$', ''), chr(10)) AS n, string_split(regexp_replace(coalesce(m.text, ''), '\\n$', ''), chr(10)) AS o,
        d.text AS nt, m.text AS ot FROM c LEFT JOIN disk d USING (vault_id, path) LEFT JOIN manifest m USING (vault_id, path)),
    u AS (SELECT vault_id, path, unnest(n) AS line, 1 AS k FROM t WHERE status = 'M' UNION ALL SELECT vault_id, path, unnest(o), -1 FROM t WHERE status = 'M'),
    g AS (SELECT vault_id, path, line, sum(k) AS k FROM u GROUP BY ALL),
    x AS (SELECT vault_id, path, sum(greatest(k, 0)) AS a, sum(greatest(-k, 0)) AS r FROM g GROUP BY ALL)
    SELECT vault_id, path, status, CAST(CASE status WHEN 'A' THEN CASE WHEN nt = '' THEN 0 ELSE len(n) END WHEN 'D' THEN 0 ELSE coalesce(a, 0) END AS BIGINT) AS added,
        CAST(CASE status WHEN 'D' THEN CASE WHEN ot = '' THEN 0 ELSE len(o) END WHEN 'A' THEN 0 ELSE coalesce(r, 0) END AS BIGINT) AS removed
    FROM t LEFT JOIN x USING (vault_id, path)""", "disk", "manifest",
)
register(
    "j3_publish_diff", lambda s, d: C.publish_diff(V.manifest(s, d), V.disk(s, d)),
    f"WITH {RECON} SELECT vault_id, row_number() OVER (PARTITION BY vault_id ORDER BY type = 'delete', path) AS seq, type, path, hash FROM recon", "disk", "manifest",
)
register(
    "j4_verify_base", lambda s, d: C.verify_base(V.manifest(s, d), V.disk(s, d), V.disk(s, d).withColumn("path", F.regexp_replace("path", "^moved/", ""))),
    """SELECT m.vault_id, m.path, CASE WHEN b.hash = m.hash THEN 'ok' WHEN k.hash = m.hash THEN 'repairable' ELSE 'lost' END AS state
    FROM manifest m LEFT JOIN disk b USING (vault_id, path) LEFT JOIN (SELECT vault_id, regexp_replace(path, '^moved/', '') AS path, hash FROM disk) k USING (vault_id, path)""",
    "disk", "manifest",
)
register(
    "j6_check_pre_hash", lambda s, d: C.check_pre_hash(V.ops(s, d), O.apply_ops(V.ops(s, d).filter("false").select("vault_id", "path", "hash"), V.ops(s, d).filter("type = 'write'").withColumn("seq", F.col("event_id"))))
    .select("vault_id", "event_id", "verdict"),
    """WITH st AS (SELECT vault_id, path, arg_max(hash, event_id) AS hash FROM ops WHERE type = 'write' GROUP BY ALL)
    SELECT o.vault_id, event_id, CASE WHEN o.pre_hash IS NOT DISTINCT FROM st.hash THEN 'ok' ELSE 'stale' END AS verdict
    FROM ops o LEFT JOIN st ON o.vault_id = st.vault_id AND st.path = CASE WHEN type = 'rename' THEN "from" ELSE o.path END""", "ops",
)
register(
    "j7_overlapping_writers",
    lambda s, d: O.overlapping_writers(V.ops(s, d).filter("type = 'rename'"), V.ops(s, d).filter("type = 'delete'")).select("client_id", "event_id"),
    """WITH st AS (SELECT DISTINCT path AS p, client_id AS c FROM ops WHERE type = 'delete'),
    t AS (SELECT client_id, event_id, unnest([path, "from", "to"]) AS p FROM ops WHERE type = 'rename')
    SELECT DISTINCT client_id, event_id FROM t WHERE EXISTS (SELECT 1 FROM st WHERE st.p = t.p AND st.c <> t.client_id)""", "ops",
)
register(
    "j9_drop_self_echo",
    lambda s, d: O.drop_self_echo(V.ops(s, d).withColumnRenamed("client_id", "author"), V.ops(s, d).filter("type <> 'write'")).select("author", "seq", "event_id"),
    "SELECT client_id AS author, seq, event_id FROM ops WHERE type = 'write'", "ops",
)
register(
    "j10_drop_filtered",
    lambda s, d: O.retain_from_seq(O.drop_paths(V.ops(s, d), V.ops(s, d).filter("binary").select(F.col("to").alias("path")).filter("path is not null")),
        O.idempotency_highwater(V.ops(s, d).filter("type = 'delete'")).select("client_id", (F.col("high") / 2).cast("long").alias("least"))).select("client_id", "seq"),
    """WITH r AS (SELECT DISTINCT "to" AS path FROM ops WHERE "binary" AND "to" IS NOT NULL), l AS (SELECT client_id, CAST(floor(max(seq) / 2) AS BIGINT) AS least FROM ops WHERE type = 'delete' GROUP BY ALL)
    SELECT client_id, seq FROM ops LEFT JOIN l USING (client_id) WHERE (path IS NULL OR path NOT IN (SELECT path FROM r)) AND seq >= coalesce(least, 0)""", "ops",
)
register(
    "j11_pending_commit_status",
    lambda s, d: O.pending_commit_status(V.ops(s, d), O.apply_ops(V.ops(s, d).filter("false").select("vault_id", "path", "hash"), V.ops(s, d).filter("type <> 'rename'").withColumn("seq", F.col("event_id"))))
    .select("event_id", "committed"),
    """WITH st AS (SELECT * FROM (SELECT vault_id, path, arg_max({'t': type, 'h': hash}, event_id) AS o FROM ops WHERE type <> 'rename' GROUP BY ALL)),
    live AS (SELECT vault_id, path, o.h AS hash FROM st WHERE o.t = 'write')
    SELECT event_id, CASE type WHEN 'write' THEN a.hash IS NOT DISTINCT FROM o.hash WHEN 'delete' THEN a.hash IS NULL ELSE a.hash IS NULL AND b.hash IS NOT NULL END AS committed
    FROM ops o LEFT JOIN live a ON a.vault_id = o.vault_id AND a.path = coalesce(o."from", o.path) LEFT JOIN live b ON b.vault_id = o.vault_id AND b.path = o."to" """, "ops",
)
def created_and_deleted(e):
    """Events as deletes and creates of three contents in the vault of each user."""
    return e.select(
        F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("vault_id"), F.when(F.col("event_type") == "error", "delete").otherwise("create").alias("action"),
        F.col("event_id").cast("string").alias("path"), (F.col("event_id") % 3).cast("string").alias("hash"), "ts",
    )


def renames_sql(mark: str, over: str) -> str:
    """The queue of each vault and content, event after event, for those before ``mark``; what still waits comes out where ``over`` holds."""
    return f"""WITH RECURSIVE m AS (SELECT {mark} AS mark FROM events),
    e AS (SELECT *, row_number() OVER (PARTITION BY vault_id, hash ORDER BY us, action DESC, path) AS n FROM (
        SELECT 'v' || user_id AS vault_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'create' END AS action, CAST(event_id AS VARCHAR) AS path, CAST(event_id % 3 AS VARCHAR) AS hash, epoch_us(ts) AS us FROM events), m WHERE us < mark),
    r AS (SELECT DISTINCT vault_id, hash, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(p VARCHAR, u BIGINT)[]) AS q, CAST([] AS STRUCT(f VARCHAR, t VARCHAR, u BIGINT)[]) AS done FROM e UNION ALL
        SELECT vault_id, hash, n, CASE WHEN action = 'delete' THEN list_append(live, {{'p': path, 'u': us}}) ELSE live[2:] END,
            list_concat(dead, CASE WHEN action = 'create' AND len(live) > 0 THEN [{{'f': live[1].p, 't': path, 'u': live[1].u}}] ELSE [] END)
        FROM (SELECT e.*, list_filter(r.q, lambda x: x.u + 7200000000 >= e.us) AS live,
                list_transform(list_filter(r.q, lambda x: x.u + 7200000000 < e.us), lambda x: {{'f': x.p, 't': CAST(NULL AS VARCHAR), 'u': x.u}}) AS dead
            FROM r JOIN e ON e.vault_id = r.vault_id AND e.hash = r.hash AND e.n = r.n + 1)),
    w AS (SELECT vault_id, hash, unnest(q) AS x FROM (SELECT vault_id, hash, arg_max(q, n) AS q FROM r GROUP BY ALL))
    SELECT vault_id, hash, d.f AS "from", d.t AS "to", make_timestamp(d.u) AS ts FROM (SELECT vault_id, hash, unnest(done) AS d FROM r)
    UNION ALL SELECT vault_id, hash, x.p, NULL, make_timestamp(x.u) FROM w, m WHERE {over}"""


register("j19_detect_renames", lambda s, d: C.detect_renames(created_and_deleted(V.table(s, d, "events")), "2 hours"), renames_sql("any_value(4611686018427387904)", "true"))
register(
    "j20_find_base_by_hash", lambda s, d: C.find_base_by_hash(V.changes(s, d).select("vault_id", "path", "hash").distinct(), V.commits(s, d), V.history(s, d)),
    "SELECT vault_id, path, hash, arg_max(commit_id, ordinal) AS commit_id, max(ordinal) AS ordinal FROM history WHERE action <> 'D' GROUP BY vault_id, path, hash", "history",
)
register(
    "j24_dirty_paths", lambda s, d: C.dirty_paths(V.manifest(s, d), V.disk(s, d), F.col("path").rlike("/(?:en|de)/")),
    f"WITH {BOTH} SELECT vault_id, path, CASE WHEN mh IS NULL THEN 'A' WHEN dh IS NULL THEN 'D' ELSE 'M' END AS status FROM b WHERE dh IS DISTINCT FROM mh AND regexp_matches(path, '/(en|de)/')",
    "disk", "manifest",
)
register(
    "j25_restore_deleted",
    lambda s, d: C.restore_deleted(C.reconcile(V.disk(s, d), V.manifest(s, d)), V.manifest(s, d)).select("vault_id", "path", "type", "outcome", "base_hash"),
    f"""WITH {RECON} SELECT r.vault_id, r.path, type, CASE WHEN type <> 'delete' THEN 'requeued' WHEN m.hash IS NOT NULL THEN 'restored' ELSE 'missing' END AS outcome, m.hash AS base_hash
    FROM recon r LEFT JOIN manifest m USING (vault_id, path)""", "disk", "manifest",
)
register(
    "a1_fold_latest",
    lambda s, d: C.fold_latest(V.ops(s, d).filter("type <> 'rename'").select("vault_id", "path", F.col("event_id").alias("row_no"), "hash", "binary", (F.col("type") == "delete").alias("deleted"))),
    """WITH t AS (SELECT vault_id, path, arg_max({'row_no': event_id, 'hash': hash, 'binary': "binary", 'deleted': type = 'delete'}, event_id) AS r FROM ops WHERE type <> 'rename' GROUP BY ALL)
    SELECT vault_id, path, r.row_no, r.hash, r."binary", r.deleted FROM t WHERE NOT r.deleted""", "ops",
)
register(
    "a4_manifest_digest", lambda s, d: C.manifest_digest(V.manifest(s, d)),
    "SELECT vault_id, sha256(string_agg(path || chr(9) || hash || chr(10), '' ORDER BY path || chr(9) || hash || chr(10))) AS digest FROM manifest GROUP BY vault_id", "manifest",
)


def tree_sql(files: str, of: str) -> str:
    """The hash tree of ``of`` in SQL, for paths of three or four components: a level after the other."""
    parts, above = [f"{files}0 AS (SELECT vault_id, path, hash, string_split(path, '/') AS c FROM {of})"], None
    for depth in (3, 2, 1, 0):
        up = f" UNION ALL SELECT vault_id, regexp_replace(dir, '/?[^/]*$', ''), regexp_extract(dir, '[^/]*$'), regexp_extract(dir, '[^/]*$') || '/' || chr(9) || digest || chr(10), files FROM {above}" if above else ""
        parts.append(f"{files}i{depth} AS (SELECT vault_id, array_to_string(c[1:-2], '/') AS dir, c[-1] AS name, c[-1] || chr(9) || hash || chr(10) AS line, 1 AS files FROM {files}0 WHERE len(c) = {depth + 1}{up})")
        parts.append(f"""{files}d{depth} AS (SELECT vault_id, dir, sha256(string_agg(g || chr(9) || d || chr(10), '' ORDER BY g)) AS digest, CAST(sum(files) AS BIGINT) AS files FROM (
            SELECT vault_id, dir, left(sha256(name), 2) AS g, sha256(string_agg(line, '' ORDER BY line)) AS d, sum(files) AS files FROM {files}i{depth} GROUP BY ALL) GROUP BY vault_id, dir)""")
        above = f"{files}d{depth}"
    every = " UNION ALL ".join(f"SELECT vault_id, dir, CASE WHEN dir <> '' THEN regexp_replace(dir, '/?[^/]*$', '') END AS parent, {n} AS depth, digest, files FROM {files}d{n}" for n in range(4))
    return ", ".join(parts) + f", {files} AS ({every})"


register("a4_digest_tree", lambda s, d: C.digest_tree(V.disk(s, d)), f"WITH {tree_sql('t', 'disk')} SELECT * FROM t", "disk")
register(
    "j23_changed_dirs", lambda s, d: C.changed_dirs(C.digest_tree(V.manifest(s, d)), C.digest_tree(V.disk(s, d).filter("path not like 'src1/%'"))),
    f"""WITH kept AS (SELECT * FROM disk WHERE path NOT LIKE 'src1/%'), {tree_sql('a', 'manifest')}, {tree_sql('b', 'kept')}
    SELECT coalesce(a.vault_id, b.vault_id) AS vault_id, coalesce(a.dir, b.dir) AS dir, CASE WHEN a.dir IS NULL THEN 'added' WHEN b.dir IS NULL THEN 'removed' ELSE 'changed' END AS state
    FROM a FULL JOIN b ON a.vault_id = b.vault_id AND a.dir = b.dir WHERE a.digest IS DISTINCT FROM b.digest""", "manifest", "disk",
)
register(
    "a5_bulk_delete_guard",
    lambda s, d: C.bulk_delete_guard(C.reconcile_counts(C.reconcile(V.disk(s, d), V.manifest(s, d))), V.manifest(s, d).groupBy("vault_id").agg(F.count("*").alias("files")), 10, 0.08),
    f"""WITH {RECON}, c AS (SELECT vault_id, count_if(change = 'add') AS adds, count_if(change = 'modify') AS modifies, count_if(change = 'delete') AS deletes FROM recon GROUP BY ALL),
    f AS (SELECT vault_id, count(*) AS files FROM manifest GROUP BY ALL)
    SELECT vault_id, adds, modifies, deletes, files, deletes >= 10 AND deletes >= ceil(files * 0.08) AS blocked FROM c JOIN f USING (vault_id)""", "disk", "manifest",
)
register(
    "a6_vault_usage", lambda s, d: O.would_exceed(O.vault_usage(V.disk(s, d).withColumn("size", F.octet_length("text").cast("long"))), 124, 1 << 40),
    "SELECT vault_id, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CASE WHEN count(*) > 124 THEN 'file_count' WHEN sum(strlen(text)) > 1099511627776 THEN 'total_bytes' END AS reason FROM disk GROUP BY vault_id",
    "disk",
)
register(
    "a7_idempotency_highwater", lambda s, d: O.idempotency_highwater(V.ops(s, d), since=F.lit("2024-01-30 12:00:00").cast("timestamp"), most=1024),
    "SELECT client_id, max(seq) AS high, max(ts) AS last_ts FROM ops GROUP BY client_id HAVING max(ts) >= TIMESTAMP '2024-01-30 12:00:00' ORDER BY last_ts DESC, client_id LIMIT 1024", "ops",
)
register(
    "a14_stage_stats", lambda s, d: O.stage_stats(V.ops(s, d)),
    "SELECT client_id, count(*) AS ops, CAST(sum(CASE WHEN type = 'write' THEN strlen(data) ELSE 0 END) AS BIGINT) AS write_bytes, min(ts) AS first_ts, max(ts) AS last_ts FROM ops GROUP BY client_id", "ops",
)
register(
    "w1_coalesce_writes", lambda s, d: O.coalesce_writes(V.ops(s, d)).select("client_id", "seq", "type", "path", "data", "ts"),
    """WITH a AS (SELECT *, CASE WHEN type = 'write' AND lag(type) OVER w = 'write' AND path = lag(path) OVER w THEN 0 ELSE 1 END AS n FROM ops WINDOW w AS (PARTITION BY client_id ORDER BY seq)),
    r AS (SELECT *, sum(n) OVER (PARTITION BY client_id ORDER BY seq) AS run FROM a)
    SELECT client_id, min(seq) AS seq, any_value(type) AS type, any_value(path) AS path, arg_max(data, seq) AS data, max(ts) AS ts FROM r GROUP BY client_id, run""", "ops",
)
register(
    "w2_filter_acked",
    lambda s, d: O.filter_acked(V.ops(s, d).withColumn("pos", F.col("seq")), O.idempotency_highwater(V.ops(s, d).filter("type = 'delete'")).withColumn("high", (F.col("high") / 2).cast("long")))
    .select("client_id", "seq", "rejected"),
    """WITH h AS (SELECT client_id, CAST(floor(max(seq) / 2) AS BIGINT) AS high FROM ops WHERE type = 'delete' GROUP BY ALL)
    SELECT client_id, seq, false AS rejected FROM ops LEFT JOIN h USING (client_id) WHERE seq > coalesce(high, 0)""", "ops",
)
register(
    "w3_assign_seq",
    lambda s, d: O.assign_seq(V.manifest(s, d).select(F.col("vault_id").alias("client_id"), "path"), pending(s, d).select(F.col("vault_id").alias("client_id"), "path"),
        V.manifest(s, d).groupBy(F.col("vault_id").alias("client_id")).agg((F.count("*") + 1).alias("next_seq"))),
    f"""WITH {PENDING}, n AS (SELECT vault_id, count(*) + 1 AS k FROM manifest GROUP BY ALL), f AS (SELECT vault_id, path FROM manifest ANTI JOIN pending USING (vault_id, path))
    SELECT vault_id AS client_id, path, k + row_number() OVER (PARTITION BY vault_id ORDER BY path) - 1 AS seq FROM f JOIN n USING (vault_id)""", "manifest",
)


def renamed_ends(s, d):
    """Commits: the renames, with each of the two paths that they touch."""
    r = V.ops(s, d).filter("type = 'rename'")
    return r.select("vault_id", F.explode(F.array("from", "to")).alias("path"), "ts")


register(
    "w4_stuck_writes", lambda s, d: O.stuck_writes(V.ops(s, d).filter("type = 'write'"), renamed_ends(s, d)).select("client_id", "seq", "stuck"),
    """WITH e AS (SELECT vault_id, path, 'write' AS kind, client_id, seq, hash, ts FROM ops WHERE type = 'write'
        UNION SELECT vault_id, unnest(["from", "to"]), 'commit', NULL, NULL, NULL, ts FROM ops WHERE type = 'rename'),
    o AS (SELECT *, row_number() OVER (PARTITION BY vault_id, path ORDER BY ts, kind DESC, client_id, seq) AS n FROM e),
    r AS (SELECT DISTINCT vault_id, path, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS client_id, CAST(NULL AS BIGINT) AS seq, false AS stuck, CAST([] AS STRUCT(c VARCHAR, h VARCHAR)[]) AS kept FROM o UNION ALL
        SELECT vault_id, path, n, client_id, seq, again, CASE WHEN kind = 'commit' THEN [] WHEN again THEN kept ELSE list_append(kept, {'c': client_id, 'h': hash}) END
        FROM (SELECT o.*, r.kept, coalesce(list_contains(list_transform(list_filter(r.kept, lambda x: x.c = o.client_id), lambda x: x.h)[-3:], o.hash), false) AS again
            FROM r JOIN o ON o.vault_id = r.vault_id AND o.path = r.path AND o.n = r.n + 1))
    SELECT client_id, seq, stuck FROM r WHERE client_id IS NOT NULL""", "ops",
)
ORACLE["w4_stuck_writes"] = ORACLE["w4_stuck_writes"].replace("WITH", "WITH RECURSIVE", 1)
register(
    "w5_rate_limit", lambda s, d: O.rate_limit(V.ops(s, d), 4, 86_400).select("client_id", "event_id", "in_window", "exceeded"),
    """SELECT client_id, event_id, n AS in_window, n >= 4 AS exceeded FROM (SELECT *, count(*) OVER (PARTITION BY client_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS n FROM ops)""", "ops",
)
register(
    "w5_rate_limit_accepted", lambda s, d: O.rate_limit_accepted(V.ops(s, d), 2, 5 * 86_400),
    """WITH o AS (SELECT client_id, seq, epoch_us(ts) AS us, row_number() OVER (PARTITION BY client_id ORDER BY ts, seq) AS n FROM ops),
    r AS (SELECT DISTINCT client_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS in_window, false AS refused, CAST([] AS BIGINT[]) AS kept FROM o UNION ALL
        SELECT client_id, n, seq, len(now), len(now) >= 2, CASE WHEN len(now) >= 2 THEN now ELSE list_append(now, us) END
        FROM (SELECT o.*, list_filter(r.kept, lambda x: x > o.us - 432000000000) AS now FROM r JOIN o ON o.client_id = r.client_id AND o.n = r.n + 1))
    SELECT client_id, seq, in_window, refused FROM r WHERE n > 0""", "ops",
)
ORACLE["w5_rate_limit_accepted"] = ORACLE["w5_rate_limit_accepted"].replace("WITH", "WITH RECURSIVE", 1)
register(
    "w6_debounce_batches", lambda s, d: O.debounce_batches(V.ops(s, d), 21_600).select("client_id", F.col("batch").cast("long").alias("batch"), "ops", "first_ts", "last_ts"),
    """WITH a AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY client_id ORDER BY ts, seq)) > 21600000000 THEN 1 ELSE 0 END AS n FROM ops),
    r AS (SELECT *, sum(n) OVER (PARTITION BY client_id ORDER BY ts, seq) AS batch FROM a)
    SELECT client_id, CAST(batch AS BIGINT) AS batch, count(*) AS ops, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY client_id, batch""", "ops",
)
register(
    "w7_flush_reason", lambda s, d: O.flush_reason(O.stage_stats(V.ops(s, d)), F.lit("2024-01-31 00:00:00").cast("timestamp"), 3600, 86_400 * 40, 600, 70).select("client_id", "reason"),
    """WITH t AS (SELECT client_id, count(*) AS n, sum(CASE WHEN type = 'write' THEN strlen(data) ELSE 0 END) AS b, max(ts) AS l, min(ts) AS f FROM ops GROUP BY ALL)
    SELECT client_id, CASE WHEN b >= 600 THEN 'byte_cap' WHEN n >= 70 THEN 'file_cap' WHEN epoch_us(TIMESTAMP '2024-01-31') - epoch_us(f) >= 86400000000 * 40 THEN 'max_delay'
        WHEN epoch_us(TIMESTAMP '2024-01-31') - epoch_us(l) >= 3600000000 THEN 'quiet' END AS reason FROM t""", "ops",
)
register(
    "w13_pack_batches_approx", lambda s, d: O.pack_batches_approx(V.ops(s, d), F.coalesce(F.octet_length("data"), F.lit(1)), 64).select("client_id", "seq", "chunk"),
    """SELECT client_id, seq, CAST(floor((sum(coalesce(strlen(data), 1)) OVER (PARTITION BY client_id ORDER BY seq) - coalesce(strlen(data), 1)) / 64) AS BIGINT) AS chunk FROM ops""", "ops",
)
register(
    "w13_pack_batches", lambda s, d: O.pack_batches(V.ops(s, d), F.coalesce(F.octet_length("data"), F.lit(1)), 64),
    """WITH o AS (SELECT client_id, seq, coalesce(strlen(data), 1) AS n FROM ops),
    r AS (SELECT client_id, seq, n AS used, 0 AS chunk FROM o WHERE seq = 1 UNION ALL
        SELECT o.client_id, o.seq, CASE WHEN used > 0 AND used + n > 64 THEN n ELSE used + n END, chunk + CASE WHEN used > 0 AND used + n > 64 THEN 1 ELSE 0 END FROM r JOIN o ON o.client_id = r.client_id AND o.seq = r.seq + 1)
    SELECT client_id, seq, chunk, chunk < max(chunk) OVER (PARTITION BY client_id) AS more FROM r""", "ops",
)
ORACLE["w13_pack_batches"] = ORACLE["w13_pack_batches"].replace("WITH", "WITH RECURSIVE", 1)


register(
    "w6_debounce_max_delay", lambda s, d: O.debounce_batches(V.ops(s, d), 86_400, max_delay_s=3 * 86_400).select("client_id", "batch", "ops", "first_ts", "last_ts"),
    """WITH o AS (SELECT client_id, ts, epoch_us(ts) AS us, row_number() OVER (PARTITION BY client_id ORDER BY ts, seq) AS n FROM ops),
    r AS (SELECT client_id, n, ts, us, us AS f, CAST(0 AS BIGINT) AS batch FROM o WHERE n = 1 UNION ALL
        SELECT o.client_id, o.n, o.ts, o.us, CASE WHEN o.us - r.us > 86400000000 OR o.us - r.f >= 259200000000 THEN o.us ELSE r.f END,
            r.batch + CASE WHEN o.us - r.us > 86400000000 OR o.us - r.f >= 259200000000 THEN 1 ELSE 0 END FROM r JOIN o ON o.client_id = r.client_id AND o.n = r.n + 1)
    SELECT client_id, batch, count(*) AS ops, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY client_id, batch""", "ops",
)
ORACLE["w6_debounce_max_delay"] = ORACLE["w6_debounce_max_delay"].replace("WITH", "WITH RECURSIVE", 1)


def notes(s, d):
    """A snapshot of the five paths that the ops name, in every vault."""
    return V.ops(s, d).select("vault_id").distinct().select("vault_id", F.explode(F.array(*(F.lit(f"notes/{i}.md") for i in range(5)))).alias("path")).withColumn("hash", F.lit("first"))


register(
    "w10_apply_renames", lambda s, d: O.apply_ops(notes(s, d), V.ops(s, d).withColumn("seq", F.col("event_id"))),
    """WITH o AS (SELECT vault_id, row_number() OVER (PARTITION BY vault_id ORDER BY event_id) AS n, type, hash, CAST(substr(coalesce(path, "from"), 7, 1) AS INTEGER) AS p, CAST(substr("to", 7, 1) AS INTEGER) AS t FROM ops),
    r AS (SELECT DISTINCT vault_id, CAST(0 AS BIGINT) AS n, ['first', 'first', 'first', 'first', 'first'] AS s FROM o UNION ALL
        SELECT o.vault_id, o.n, list_transform([0, 1, 2, 3, 4], lambda i: CASE WHEN o.type = 'write' AND i = o.p THEN o.hash WHEN o.type = 'delete' AND i = o.p THEN NULL
            WHEN o.type = 'rename' AND o.p <> o.t AND i = o.t THEN r.s[o.p + 1] WHEN o.type = 'rename' AND o.p <> o.t AND i = o.p THEN NULL ELSE r.s[i + 1] END)
        FROM r JOIN o ON o.vault_id = r.vault_id AND o.n = r.n + 1),
    l AS (SELECT vault_id, arg_max(s, n) AS s FROM r GROUP BY vault_id), u AS (SELECT vault_id, unnest([0, 1, 2, 3, 4]) AS i, unnest(s) AS hash FROM l)
    SELECT vault_id, 'notes/' || i || '.md' AS path, hash FROM u WHERE hash IS NOT NULL""", "ops",
)
ORACLE["w10_apply_renames"] = ORACLE["w10_apply_renames"].replace("WITH", "WITH RECURSIVE", 1)
register(
    "w10_apply_ops",
    lambda s, d: O.apply_ops(V.manifest(s, d).select("vault_id", "path", "hash"), C.reconcile(V.disk(s, d), V.manifest(s, d)).withColumn("seq", F.lit(1))),
    "SELECT vault_id, path, hash FROM disk", "disk",
)
register(
    "u1_pending_paths", lambda s, d: C.pending_paths(V.ops(s, d).filter("type = 'rename'"), V.ops(s, d).filter("type <> 'rename'")),
    'SELECT DISTINCT vault_id, coalesce("from", path) AS path FROM ops', "ops",
)
register(
    "u4_append_unique_seq",
    lambda s, d: O.append_unique_seq(V.ops(s, d).filter("type = 'write'").select("client_id", "seq"), V.ops(s, d).select("client_id", "seq")),
    "SELECT client_id, seq FROM ops", "ops",
)
register(
    "a3_last_touch", lambda s, d: H.last_touch(V.history(s, d), H.snapshot_at(V.history(s, d))),
    """WITH t AS (SELECT h.vault_id, h.path, arg_max({'a': author, 't': author_ts}, {'o': ordinal, 'h': h.hash}) AS x FROM history h SEMI JOIN head USING (vault_id, path) WHERE action <> 'D' GROUP BY ALL)
    SELECT vault_id, path, x.a AS author, x.t AS author_ts FROM t""", "head",
)
register(
    "w8_changed_between_versions", lambda s, d: H.changed_between_versions(H.tag_trees(V.history(s, d), V.tags(s, d))).select("vault_id", "path", "name"),
    "SELECT a.vault_id, a.path, a.name FROM trees a JOIN trees b ON a.vault_id = b.vault_id AND a.path = b.path AND b.rank = a.rank + 1 WHERE a.hash <> b.hash", "trees",
)
register(
    "a12_file_history",
    lambda s, d: H.file_history(H.tag_trees(V.history(s, d), V.tags(s, d)), V.tags(s, d).groupBy("vault_id").agg(F.count("*").cast("int").alias("tags")))
    .withColumn("changed_at", F.array_join("changed_at", ",")),
    """WITH n AS (SELECT vault_id, count(*) AS k FROM tags GROUP BY ALL),
    c AS (SELECT a.vault_id, a.path, a.rank, a.name FROM trees a JOIN trees b ON a.vault_id = b.vault_id AND a.path = b.path AND b.rank = a.rank + 1 WHERE a.hash <> b.hash
        UNION SELECT t.vault_id, path, rank, name FROM trees t JOIN n ON t.vault_id = n.vault_id AND rank = k),
    g AS (SELECT a.*, NOT EXISTS (SELECT 1 FROM trees b WHERE b.vault_id = a.vault_id AND b.path = a.path AND b.rank = a.rank - 1) AND rank > 1 AS gone FROM trees a)
    SELECT g.vault_id, g.path, arg_max(g.name, g.rank) AS first_tag, arg_min(g.name, g.rank) FILTER (WHERE gone) AS last_tag,
        coalesce((SELECT string_agg(name, ',' ORDER BY rank) FROM c WHERE c.vault_id = g.vault_id AND c.path = g.path), '') AS changed_at
    FROM g GROUP BY g.vault_id, g.path""", "trees", "tags",
)
register(
    "w9_version_markers", lambda s, d: H.version_markers(H.tag_trees(V.history(s, d), V.tags(s, d)), V.tags(s, d)),
    """WITH p AS (SELECT vault_id, path, max(rank) AS f, min(rank) AS l FROM trees GROUP BY ALL),
    c AS (SELECT a.vault_id, a.path, a.rank FROM trees a JOIN trees b ON a.vault_id = b.vault_id AND a.path = b.path AND b.rank = a.rank + 1 WHERE a.hash <> b.hash)
    SELECT p.vault_id, p.path, t.name, CASE WHEN t.rank > f THEN 'not_yet' WHEN t.rank < l THEN 'deleted' WHEN c.rank IS NOT NULL THEN 'changed_here' ELSE 'default' END AS marker
    FROM p JOIN tagrank t ON t.vault_id = p.vault_id LEFT JOIN c ON c.vault_id = p.vault_id AND c.path = p.path AND c.rank = t.rank""", "trees", "tagrank",
)
register(
    "w11_catchup_ops", lambda s, d: H.catchup_ops(V.history(s, d), F.lit(900), F.lit(1600)),
    """WITH t AS (SELECT vault_id, path, max({'o': ordinal, 'a': action, 'h': hash, 'w': author}) AS t FROM history WHERE ordinal > 900 AND ordinal <= 1600 GROUP BY ALL)
    SELECT vault_id, path, CASE WHEN t.a = 'D' THEN 'delete' ELSE 'write' END AS type, CASE WHEN t.a <> 'D' THEN t.h END AS hash, t.w AS author, t.o AS ordinal FROM t""", "history",
)
register(
    "w12_bootstrap_ops", lambda s, d: H.bootstrap_ops(H.snapshot_at(V.history(s, d)), F.col("path").rlike("[02468]\\.md$")),
    "SELECT vault_id, path, 'write' AS type, hash FROM head WHERE regexp_matches(path, '[02468]\\.md$')", "head",
)
register(
    "w14_tag_list", lambda s, d: H.tag_list(V.tags(s, d)).select("vault_id", "name", "kind", "place"),
    "SELECT vault_id, name, CASE WHEN name LIKE 'reviewed-%' THEN 'review' ELSE 'tag' END AS kind, CAST(row_number() OVER (PARTITION BY vault_id ORDER BY created_at DESC, name DESC) AS INTEGER) AS place FROM tags", "tags",
)
register(
    "p17_filter_tags_by_mode", lambda s, d: H.filter_tags_by_mode(V.tags(s, d), "only_reviewed").select("vault_id", "name"),
    "SELECT vault_id, name FROM tags WHERE name LIKE 'reviewed-%'", "tags",
)
register(
    "w15_restore_ops", lambda s, d: H.restore_ops(V.history(s, d), F.lit(1000)),
    """WITH o AS (SELECT vault_id, path, t.h AS hash FROM (SELECT vault_id, path, max({'o': ordinal, 'a': action, 'h': hash}) AS t FROM history WHERE ordinal <= 1000 GROUP BY ALL) WHERE t.a <> 'D'),
    b AS (SELECT coalesce(o.vault_id, h.vault_id) AS vault_id, coalesce(o.path, h.path) AS path, o.hash AS dh, h.hash AS mh FROM o FULL JOIN head h ON o.vault_id = h.vault_id AND o.path = h.path)
    SELECT vault_id, path, CASE WHEN dh IS NULL THEN 'delete' ELSE 'write' END AS type, CASE WHEN mh IS NULL THEN 'add' WHEN dh IS NULL THEN 'delete' ELSE 'modify' END AS change,
        mh AS pre_hash, dh AS hash FROM b WHERE dh IS DISTINCT FROM mh""", "head",
)
register(
    "w15_revert_ops", lambda s, d: H.revert_ops(V.history(s, d), V.tags(s, d)),
    """WITH p AS (SELECT vault_id, path, ordinal, commit_id, max({'a': action, 'h': hash}) AS t FROM history GROUP BY ALL),
    q AS (SELECT *, lag(t) OVER w AS b, lead(ordinal) OVER w IS NOT NULL AS conflict FROM p WINDOW w AS (PARTITION BY vault_id, path ORDER BY ordinal))
    SELECT vault_id, path, commit_id, CASE WHEN b IS NULL OR b.a = 'D' THEN 'delete' ELSE 'write' END AS type, CASE WHEN b.a <> 'D' THEN b.h END AS hash, conflict
    FROM q SEMI JOIN tags USING (vault_id, commit_id)""", "history", "tags",
)
register(
    "w17_snapshot_at", lambda s, d: H.snapshot_at(V.history(s, d)), "SELECT vault_id, path, hash FROM head", "head",
)
register(
    "a16_log_entries", lambda s, d: H.log_entries(V.commits(s, d), V.changes(s, d)).select("vault_id", "commit_id", F.array_join("files", ",").alias("files")),
    """SELECT c.vault_id, c.commit_id, f.files FROM commits c LEFT JOIN (SELECT vault_id, commit_id, string_agg(DISTINCT path, ',' ORDER BY path) AS files FROM changes GROUP BY ALL) f USING (vault_id, commit_id)""",
    "commits", "changes",
)
register(
    "l2_history_page", lambda s, d: H.history_page(V.commits(s, d), F.lit(1500), F.lit("1995-01-01").cast("timestamp")).select("vault_id", "commit_id", "place"),
    """SELECT vault_id, commit_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY vault_id ORDER BY ordinal DESC) AS place FROM commits
        WHERE ordinal < 1500 AND author_ts >= TIMESTAMP '1995-01-01') WHERE place <= 50""", "commits",
)
register(
    "u2_tag_set_diff", lambda s, d: H.tag_set_diff(H.filter_tags_by_mode(V.tags(s, d), "only_versioned"), V.tags(s, d)),
    "SELECT vault_id, name, 'added' AS change FROM tags WHERE name LIKE 'reviewed-%'", "tags",
)
register(
    "u6_tags_without", lambda s, d: H.tags_without(V.tags(s, d), H.filter_tags_by_mode(V.tags(s, d), "only_reviewed"), ["vault_id", "commit_id"])[0].select("vault_id", "name"),
    "SELECT vault_id, name FROM tags WHERE (vault_id, commit_id) NOT IN (SELECT (vault_id, commit_id) FROM tags WHERE name LIKE 'reviewed-%')", "tags",
)
register(
    "j23_drift_check",
    lambda s, d: H.drift_check(
        V.commits(s, d).select("vault_id", F.when(F.col("commit_id") % 5 == 0, None).otherwise(F.when(F.col("commit_id") % 7 == 0, -F.col("commit_id")).otherwise(F.col("commit_id"))).alias("base"),
            F.lit("d").alias("digest"), F.col("commit_id").alias("id")),
        V.commits(s, d), V.commits(s, d).select("vault_id", F.lit("d").alias("digest")).distinct()).select("id", "state"),
    """WITH h AS (SELECT vault_id, max(ordinal) AS m FROM commits GROUP BY ALL)
    SELECT commit_id AS id, CASE WHEN commit_id % 5 = 0 THEN 'bootstrap' WHEN commit_id % 7 = 0 AND commit_id <> 0 THEN 'base_lost' WHEN ordinal = m THEN 'up_to_date' ELSE 'catchup' END AS state
    FROM commits JOIN h USING (vault_id)""", "commits",
)
register(
    "w16_trash_restore", lambda s, d: H.trash_restore(V.ops(s, d).filter("type = 'delete'").select("vault_id", "path", F.col("ts").alias("bucket"))),
    "SELECT vault_id, path, max(ts) AS bucket FROM ops WHERE type = 'delete' GROUP BY vault_id, path", "ops",
)
register(
    "w16_trash_listing", lambda s, d: H.trash_listing(V.ops(s, d).filter("type = 'delete'").select("vault_id", "path", F.col("ts").alias("bucket"))),
    "SELECT vault_id, path, ts AS bucket, CAST(row_number() OVER (PARTITION BY vault_id ORDER BY ts DESC, path) AS INTEGER) AS place FROM ops WHERE type = 'delete'", "ops",
)
register(
    "j17_file_meta",
    lambda s, d: H.file_meta(H.snapshot_at(V.history(s, d)), H.last_touch(V.history(s, d), H.snapshot_at(V.history(s, d))), F.col("path").rlike("^p/1")),
    """WITH t AS (SELECT h.vault_id, h.path, arg_max({'a': author, 't': author_ts}, {'o': ordinal, 'h': h.hash}) AS x FROM history h WHERE action <> 'D' GROUP BY ALL)
    SELECT vault_id, path, hash, path LIKE 'p/1%' AS has_history, CASE WHEN path LIKE 'p/1%' THEN x.a END AS updated_by, CASE WHEN path LIKE 'p/1%' THEN x.t END AS updated_at
    FROM head LEFT JOIN t USING (vault_id, path)""", "head",
)
register(
    "j22_fanout_ops",
    lambda s, d: O.fanout_counts(O.sent_ops(V.ops(s, d)), V.keys(s, d).select("vault_id", F.col("name").alias("client_id"), (F.col("role") == "admin").alias("admin")))
    .groupBy("recipient").agg(F.sum("ops").alias("ops")),
    """SELECT name AS recipient, count(*) AS ops FROM ops JOIN keys USING (vault_id) GROUP BY name""", "ops", "keys",
)
register(
    "p13_visible_ops", lambda s, d: O.visible_ops(V.ops(s, d).withColumn("path", F.when(F.col("binary"), F.lit(".vault/access")).otherwise(F.col("path"))), F.lit(False)).select("event_id"),
    "SELECT event_id FROM ops WHERE NOT \"binary\"", "ops",
)
del P
