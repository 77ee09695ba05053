"""Registered queries of the merge, source and streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvault.operators import merge as M
from sparkvault.operators import oplog as O
from sparkvault.operators.text import table_cells, tokenize_ascii
from sparkvault.plans import views as V
from sparkvault.plans.changes import created_and_deleted, renames_sql
from sparkvault.plans.text import GRAMS
from sparkvault.plans.views import scratch, with_views
from sparkvault.sources import files as S
from sparkvault.streaming import streams as T

QUERIES, ORACLE = {}, {}


def register(name: str, query, sql: str | None = None, *views: str) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = with_views(sql, *views) if views else sql


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data as a stream of its files."""
    schema = V.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{sf_dir}/{name}.parquet*")


def drained(frame: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and read what it wrote."""
    spark = frame.sparkSession
    out, state = scratch(spark, "stream"), scratch(spark, "state")
    if mode == "append":
        writer = frame.writeStream.format("parquet").option("path", out)
    else:
        writer = frame.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).outputMode(mode)
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(out)


def theirs(s, d):
    m = V.manifest(s, d)
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("their first line\n"), "text")).otherwise(F.col("text"))
    return m.select("vault_id", "path", F.sha2(text, 256).alias("hash"), text.alias("text"), "doc_id")


def ours(s, d):
    m = V.manifest(s, d)
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\nour last line"))).otherwise(F.col("text"))
    return m.select("vault_id", "path", F.sha2(text, 256).alias("hash"), text.alias("text"), "doc_id")


register(
    "m1_merge_three_way", lambda s, d: M.merge_three_way(V.manifest(s, d), ours(s, d), theirs(s, d)).select("vault_id", "path", "outcome"),
    "SELECT vault_id, path, CASE WHEN doc_id % 35 = 0 THEN 'both' WHEN doc_id % 5 = 0 THEN 'theirs' WHEN doc_id % 7 = 0 THEN 'ours' ELSE 'same' END AS outcome FROM manifest", "manifest",
)


def both_changed(s, d):
    rows = M.merge_three_way(V.manifest(s, d), ours(s, d), theirs(s, d)).filter("outcome = 'both'").select("vault_id", "path")
    for df, name in ((V.manifest(s, d), "base_text"), (ours(s, d), "our_text"), (theirs(s, d), "their_text")):
        rows = rows.join(df.select("vault_id", "path", F.col("text").alias(name)), ["vault_id", "path"])
    return rows


def at_an_edge(s, d):
    """Texts where we insert a line before or behind the one that they replace, or both insert or replace at one place."""
    m = V.manifest(s, d).filter("doc_id % 5 = 1")
    text = lambda *lines: F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in lines))
    t = F.col("text")
    cases = {
        "before": (text("top", "ours", "mid", "end", t), text("top", "theirs", "end", t)), "behind": (text("top", "mid", "ours", "end", t), text("top", "theirs", "end", t)),
        "place": (text("top", "ours", "mid", "end", t), text("top", "theirs", "mid", "end", t)), "inside": (text("top", "mid", "ours", "end", t), text("theirs", t)),
    }
    case = F.explode(F.array(*(F.struct(F.lit(f"#{name}").alias("n"), a.alias("a"), b.alias("b")) for name, (a, b) in cases.items()))).alias("c")
    each = m.select("vault_id", "path", text("top", "mid", "end", t).alias("base_text"), case)
    return each.select("vault_id", F.concat("path", "c.n").alias("path"), "base_text", F.col("c.a").alias("our_text"), F.col("c.b").alias("their_text"))


register(
    "m5_merge_texts", lambda s, d: M.merge_texts(both_changed(s, d).unionByName(at_an_edge(s, d))),
    """SELECT vault_id, path, 'their first line' || chr(10) || text || chr(10) || 'our last line' AS merged, 0 AS conflicts FROM manifest WHERE doc_id % 35 = 0
    UNION ALL SELECT vault_id, path || n, replace(head, ' ', chr(10)) || chr(10) || text, conflicts FROM manifest, (VALUES ('#before', 'top ours theirs end', 0), ('#behind', 'top theirs ours end', 0),
        ('#place', 'top <<<<<<<_ours ours ======= theirs >>>>>>>_theirs mid end', 1), ('#inside', '<<<<<<<_ours top mid ours end ======= theirs >>>>>>>_theirs', 1)) AS c(n, head, conflicts) WHERE doc_id % 5 = 1""", "manifest",
)
ORACLE["m5_merge_texts"] = ORACLE["m5_merge_texts"].replace("replace(head, ' ', chr(10))", "replace(replace(head, ' ', chr(10)), '_', ' ')")


def intervals(s, d):
    """Hunks made from line items: intervals of base lines in the trees of orders, by their return flag's side; a fifth are insertions."""
    li = V.table(s, d, "lineitem")
    start = (F.col("l_partkey") % 40).cast("int")
    return li.select(
        F.lit("v").alias("vault_id"), F.col("l_orderkey").cast("string").alias("path"), F.when(F.col("l_returnflag") == "R", "ours").otherwise("theirs").alias("side"),
        start.alias("start"), (start + F.col("l_suppkey") % 5).cast("int").alias("end"), F.array("l_linestatus").alias("lines"),
    ).distinct()


HUNKS = """h AS (SELECT DISTINCT 'v' AS vault_id, CAST(l_orderkey AS VARCHAR) AS path, CASE WHEN l_returnflag = 'R' THEN 'ours' ELSE 'theirs' END AS side,
    CAST(l_partkey % 40 AS INTEGER) AS s, CAST(l_partkey % 40 + l_suppkey % 5 AS INTEGER) AS e, l_linestatus FROM lineitem)"""
#: Two insertions at one place, an insertion strictly inside a range, or two ranges with a common line.
OVERLAP = "CASE WHEN {0}.s = {0}.e AND {1}.s = {1}.e THEN {0}.s = {1}.s WHEN {0}.s = {0}.e THEN {0}.s > {1}.s AND {0}.s < {1}.e WHEN {1}.s = {1}.e THEN {1}.s > {0}.s AND {1}.s < {0}.e ELSE {0}.s < {1}.e AND {1}.s < {0}.e END"
register(
    "m3_hunk_overlaps", lambda s, d: M.hunk_overlaps(intervals(s, d)),
    f"WITH {HUNKS} SELECT a.vault_id, a.path, a.s AS our_start, b.s AS their_start FROM h a JOIN h b ON a.path = b.path WHERE a.side = 'ours' AND b.side = 'theirs' AND {OVERLAP.format('a', 'b')}",
)
# Regions are the components of the overlaps between any two hunks, found by walking from each hunk to all that it reaches.
register(
    "m4_conflict_regions", lambda s, d: M.conflict_regions(intervals(s, d)).select("path", "start", "end", F.size("ours").alias("n_ours"), F.size("theirs").alias("n_theirs")),
    f"""WITH RECURSIVE {HUNKS}, i AS (SELECT *, row_number() OVER (ORDER BY path, s, e, side, l_linestatus) AS id FROM h),
    l AS (SELECT a.id AS x, b.id AS y FROM i a JOIN i b ON a.path = b.path WHERE a.id <> b.id AND {OVERLAP.format('a', 'b')}),
    r AS (SELECT id, id AS other FROM i UNION SELECT r.id, l.y FROM r JOIN l ON r.other = l.x),
    g AS (SELECT id, min(other) AS region FROM r GROUP BY id)
    SELECT path, min(s) AS start, max(e) AS "end", CAST(count_if(side = 'ours') AS INTEGER) AS n_ours, CAST(count_if(side = 'theirs') AS INTEGER) AS n_theirs FROM i JOIN g USING (id) GROUP BY path, region""",
)
register(
    "s2_read_manifest_log",
    lambda s, d: (lambda p: (V.manifest(s, d).select("vault_id", F.col("doc_id").alias("row_no"), "path", "hash", F.lit(False).alias("binary"), (F.col("doc_id") % 9 == 0).alias("deleted")).write.json(p), S.read_manifest_log(s, p))[1])(scratch(s, "manifest")),
    "SELECT vault_id, doc_id AS row_no, path, hash, false AS binary_, doc_id % 9 = 0 AS deleted FROM manifest".replace("binary_", '"binary"'), "manifest",
)
register(
    "s3_read_op_log",
    lambda s, d: (lambda p: (V.ops(s, d).withColumn("data", F.base64(F.col("data").cast("binary"))).write.json(p), S.read_op_log(s, p).select("client_id", "seq", "type", "path", F.col("data").cast("string").alias("data")))[1])(scratch(s, "ops")),
    "SELECT client_id, seq, type, path, data FROM ops", "ops",
)
register(
    "s4_read_conflict_log",
    lambda s, d: (lambda p: (V.manifest(s, d).select(F.when(F.col("doc_id") % 4 == 0, "{bad").otherwise(F.to_json(F.struct("vault_id", "path", F.lit("overlap").alias("kind")))).alias("value")).write.text(p), S.read_conflict_log(s, p).select("vault_id", "path", "kind"))[1])(scratch(s, "conflicts")),
    "SELECT vault_id, path, 'overlap' AS kind FROM manifest WHERE doc_id % 4 <> 0", "manifest",
)
register(
    "s5_read_access",
    lambda s, d: (lambda p: (V.keys(s, d).select(F.concat_ws(" ", F.when(F.col("role") == "ghost", F.concat(F.lit("# "), "name")).otherwise(F.col("name")), "role", F.when(F.col("role") == "reader", "zz").otherwise(F.col("hash")), F.lit("2024-01-02T03:04"), F.lit("-"), F.coalesce(F.col("expires_at").cast("string"), F.lit("-"))).alias("value")).write.text(p), S.read_access(s, p).select("name", "role", "hash", F.col("expires_at").cast("string").alias("expires_at"), "email"))[1])(scratch(s, "access")),
    "SELECT name, role, hash, CAST(expires_at AS VARCHAR) AS expires_at, CAST(NULL AS VARCHAR) AS email FROM keys WHERE role NOT IN ('ghost', 'reader')", "keys",
)
register(
    "s6_read_roles",
    lambda s, d: S.parse_roles(
        V.table(s, d, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"), F.concat(F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))), F.lit(" read,"), F.when(F.col("p_partkey") % 2 == 0, "write").otherwise("fly")).alias("value")),
        ["read", "write"], ["rod"]).select("file", "role", F.array_join("caps", ",").alias("caps")),
    """WITH l AS (SELECT p_brand AS file, p_partkey AS line, lower(split_part(p_name, ' ', 2)) AS role, CASE WHEN p_partkey % 2 = 0 THEN 'read,write' ELSE 'read' END AS caps FROM part)
    SELECT file, role, arg_min(caps, line) AS caps FROM l WHERE role <> 'rod' GROUP BY file, role""",
)
register(
    "s7_read_rule_sections",
    lambda s, d: S.parse_rule_sections(V.table(s, d, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"),
        F.when(F.col("p_partkey") % 11 == 0, F.when(F.col("p_partkey") % 2 == 0, "[view]").otherwise("[history-ignore]")).when(F.col("p_partkey") % 13 == 0, "# note").otherwise(F.col("p_name")).alias("value")), ["view", "history-ignore"]),
    """WITH l AS (SELECT p_brand AS file, p_partkey AS line, p_name, CASE WHEN p_partkey % 11 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'view' ELSE 'history-ignore' END END AS h FROM part),
    m AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY file ORDER BY line), 'view') AS section FROM l)
    SELECT file, section, CAST(row_number() OVER (PARTITION BY file, section ORDER BY line) AS INTEGER) AS ordinal, p_name AS pattern FROM m WHERE h IS NULL AND line % 13 <> 0""",
)
register(
    "s9_write_snapshot",
    lambda s, d: (lambda p: (S.write_snapshot(V.manifest(s, d).select("vault_id", F.expr("concat('p', doc_id % 300)").alias("path"), F.col("doc_id").alias("row_no"), "hash", F.lit(False).alias("binary"), (F.col("doc_id") % 9 == 0).alias("deleted")), p), S.read_manifest_log(s, p).select("vault_id", "path", "row_no", "hash"))[1])(scratch(s, "snapshot")),
    "WITH t AS (SELECT vault_id, 'p' || doc_id % 300 AS path, max(doc_id) AS row_no, arg_max(hash, doc_id) AS hash FROM manifest GROUP BY ALL) SELECT * FROM t WHERE row_no % 9 <> 0", "manifest",
)
register(
    "s10_write_conflict_log",
    lambda s, d: (lambda p: (S.write_conflict_log(V.ops(s, d).select("vault_id", F.col("ts").cast("timestamp").alias("ts"), F.coalesce("path", "from").alias("path"), F.lit("overlap").alias("kind")), p), S.read_conflict_log(s, p).select("vault_id", "path", "kind"))[1])(scratch(s, "conflicts")),
    "SELECT vault_id, coalesce(path, \"from\") AS path, 'overlap' AS kind FROM ops", "ops",
)
register(
    "s11_save_index",
    lambda s, d: (lambda p: (S.save_index(V.manifest(s, d).select("vault_id", "path", F.lit("body").alias("field"), F.substring("hash", 1, 3).alias("gram")), p), S.load_index(s, p).select("vault_id", "path", "gram"))[1])(scratch(s, "index")),
    "SELECT vault_id, path, substr(hash, 1, 3) AS gram FROM manifest", "manifest",
)
register(
    "t1_ingest_ops",
    lambda s, d: drained(T.ingest_ops(stream(s, d, "events").select(
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("client_id"), (F.col("event_id") % 997 + 1).alias("seq"), F.lit("write").alias("type"), F.when(F.col("event_id") % 10 > 0, "a.md").alias("path"),
        F.lit(None).cast("string").alias("from"), F.lit(None).cast("string").alias("to"), F.col("props").alias("data"), F.lit(False).alias("binary"), F.lit(None).cast("string").alias("pre_hash"), F.col("ts").cast("timestamp").alias("ts")), "60 days")[0]
        .select("client_id", "seq")),
    "SELECT DISTINCT 'c' || user_id AS client_id, event_id % 997 + 1 AS seq FROM events WHERE event_id % 10 > 0",
)
register(
    "t2_session_batches",
    lambda s, d: drained(T.session_batches(stream(s, d, "events").select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("client_id"), F.lit("write").alias("type"), F.col("props").alias("data"), F.col("ts").cast("timestamp").alias("ts")), "6 hours", "60 days"), "complete")
    .select("client_id", "ops", F.col("window.start").cast("timestamp_ntz").alias("first_ts")),
    """WITH a AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS n FROM events),
    r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM a) SELECT 'c' || user_id AS client_id, count(*) AS ops, min(ts) AS first_ts FROM r GROUP BY user_id, b""",
)
register(
    "t7_counters", lambda s, d: drained(T.counters(stream(s, d, "events"), ["event_type"]), "complete").select("event_type", F.col("count").alias("n")),
    "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
)
register(
    "t7_window_counters",
    lambda s, d: drained(T.counters(stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"], "1 day", late="60 days"), "complete")
    .select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), F.col("count").alias("n")),
    "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY ALL",
)
register(
    "t10_latest_state",
    lambda s, d: drained(T.latest_state(stream(s, d, "events").select(F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("vault_id"), F.expr("concat('n', event_id % 4)").alias("path"), F.col("event_type").alias("type"), F.col("props").alias("hash"), F.col("event_id").alias("seq"))), "complete")
    .select("vault_id", "path", "row.type", "row.seq"),
    "SELECT 'v' || user_id AS vault_id, 'n' || event_id % 4 AS path, arg_max(event_type, event_id) AS type, max(event_id) AS seq FROM events GROUP BY ALL",
)
register(
    "t6_fanout",
    lambda s, d: T.fanout_counts(drained(T.sent_ops(stream(s, d, "events").select(F.expr("concat('v', user_id % 8)").alias("vault_id"), F.expr("concat('c', user_id)").alias("client_id"), F.expr("concat('n', event_id % 4)").alias("path"), "event_id")), "complete"),
        V.keys(s, d).select("vault_id", F.col("name").alias("client_id"), (F.col("role") == "admin").alias("admin"))).groupBy("recipient").agg(F.sum("ops").alias("n")),
    "SELECT name AS recipient, count(*) AS n FROM keys JOIN events ON vault_id = 'v' || user_id % 8 GROUP BY name", "keys",
)
def split_by_error(s, d):
    """Both halves of the frozen split, each a stream of its own."""
    halves = T.split_frozen(stream(s, d, "events").withColumn("frozen", F.col("event_type") == "error"))
    sendable, held = (drained(half.select("event_id", F.lit(kept).alias("held"))) for half, kept in zip(halves, (False, True), strict=True))
    return sendable.union(held)


register("t11_hold_frozen", split_by_error, "SELECT event_id, event_type = 'error' AS held FROM events")


def stateful(s, d):
    """Events as a stream of ops with what the stateful operators ask for; purchases are commits of their path."""
    return stream(s, d, "events").select(
        F.expr("concat('v', user_id % 8)").alias("vault_id"), F.expr("concat('c', user_id)").alias("client_id"), F.expr("concat('n', event_id % 4)").alias("path"), F.col("event_id").alias("seq"),
        F.expr("concat('h', event_id % 3)").alias("hash"), F.when(F.col("event_type") == "purchase", "commit").otherwise("write").alias("kind"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.length("props").cast("long").alias("bytes"),
    )


# Sequential by nature: the SQL walks every key's events by recursion, as far as the watermark, an hour before the last event, has passed them.
KEYED = """m AS (SELECT (max(epoch_ms(ts)) - 3600000) * 1000 AS mark FROM events),
    e AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY us, seq) AS n, row_number() OVER (PARTITION BY vault_id, path ORDER BY us, kind DESC, client_id, seq) AS m FROM (
        SELECT 'v' || user_id % 8 AS vault_id, 'c' || user_id AS client_id, 'n' || event_id % 4 AS path, event_id AS seq, 'h' || event_id % 3 AS hash, epoch_us(ts) AS us, CAST(length(props) AS BIGINT) AS bytes,
            CASE WHEN event_type = 'purchase' THEN 'commit' ELSE 'write' END AS kind FROM events), m WHERE us < mark)"""
register(
    "t3_staged_commits", lambda s, d: drained(T.staged_commits(stateful(s, d), max_bytes=100, max_ops=5, max_delay_s=86_400, quiet_s=21_600, late="1 hour")),
    f"""WITH RECURSIVE {KEYED},
    r AS (SELECT DISTINCT client_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS ops, CAST(0 AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS f, CAST(0 AS BIGINT) AS l, CAST([] AS STRUCT(o BIGINT, b BIGINT, w VARCHAR)[]) AS done FROM e UNION ALL
        SELECT client_id, n, CASE WHEN full_ THEN 0 ELSE o END, CASE WHEN full_ THEN 0 ELSE b END, f, l,
            list_concat(CASE WHEN late THEN [{{'o': po, 'b': pb, 'w': why}}] ELSE [] END, CASE WHEN full_ THEN [{{'o': o, 'b': b, 'w': CASE WHEN b >= 100 THEN 'byte_cap' ELSE 'file_cap' END}}] ELSE [] END)
        FROM (SELECT *, b >= 100 OR o >= 5 AS full_ FROM (SELECT *, CASE WHEN late OR po = 0 THEN 1 ELSE po + 1 END AS o, CASE WHEN late OR po = 0 THEN size ELSE pb + size END AS b, CASE WHEN late OR po = 0 THEN us ELSE pf END AS f, us AS l
            FROM (SELECT e.client_id, e.n, e.us, e.bytes AS size, r.ops AS po, r.bytes AS pb, r.f AS pf, r.ops > 0 AND (e.us - r.l >= 21600000000 OR e.us - r.f >= 86400000000) AS late,
                    CASE WHEN r.f + 86400000000 <= r.l + 21600000000 THEN 'max_delay' ELSE 'quiet' END AS why
                FROM r JOIN e ON e.client_id = r.client_id AND e.n = r.n + 1)))),
    z AS (SELECT client_id, max({{'n': n, 'o': ops, 'b': bytes, 'f': f, 'l': l}}) AS z FROM r GROUP BY client_id)
    SELECT client_id, d.o AS ops, d.b AS bytes, d.w AS reason FROM (SELECT client_id, unnest(done) AS d FROM r)
    UNION ALL SELECT client_id, z.o, z.b, CASE WHEN z.f + 86400000000 <= z.l + 21600000000 THEN 'max_delay' ELSE 'quiet' END FROM z, m WHERE z.o > 0 AND least(z.f + 86400000000, z.l + 21600000000) <= mark""",
)
register(
    "t8_rate_limit", lambda s, d: drained(T.rate_limit(stateful(s, d), 3, 86_400, late="1 hour")).select("client_id", "seq", "refused"),
    f"""WITH RECURSIVE {KEYED}, r AS (SELECT DISTINCT client_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST([] AS BIGINT[]) AS kept, false AS refused FROM e UNION ALL
        SELECT client_id, n, seq, CASE WHEN len(now) >= 3 THEN now ELSE list_append(now, us) END, len(now) >= 3
        FROM (SELECT e.client_id, e.n, e.seq, e.us, list_filter(r.kept, lambda x: x > e.us - 86400000000) AS now FROM r JOIN e ON e.client_id = r.client_id AND e.n = r.n + 1))
    SELECT client_id, seq, refused FROM r WHERE n > 0""",
)
register(
    "t9_stuck_writes", lambda s, d: drained(T.stuck_writes(stateful(s, d), late="1 hour")).select("client_id", "path", "seq", "stuck"),
    f"""WITH RECURSIVE {KEYED},
    r AS (SELECT DISTINCT vault_id, path, CAST(0 AS BIGINT) AS m, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS client_id, CAST(NULL AS BIGINT) AS seq, CAST([] AS STRUCT(c VARCHAR, h VARCHAR)[]) AS kept, false AS stuck FROM e UNION ALL
        SELECT vault_id, path, m, kind, client_id, seq, CASE WHEN kind = 'commit' THEN [] WHEN again THEN kept ELSE list_append(kept, {{'c': client_id, 'h': hash}}) END, again
        FROM (SELECT e.*, r.kept, list_contains(list_transform(list_filter(r.kept, lambda x: x.c = e.client_id), lambda x: x.h)[-3:], e.hash) AS again
            FROM r JOIN e ON e.vault_id = r.vault_id AND e.path = r.path AND e.m = r.m + 1))
    SELECT client_id, path, seq, stuck FROM r WHERE kind = 'write'""",
)


def latest_staged(s, d):
    """The last op at each path of a vault, or at the source of a rename, as the one staged."""
    o = V.ops(s, d).withColumn("at", F.coalesce("path", "from"))
    last = o.groupBy("vault_id", "at").agg(F.max_by(F.struct("type", "path", "from", "to", "binary", F.col("event_id").alias("seq")), "event_id").alias("o"))
    return last.select("vault_id", "o.*")


register(
    "j5_classify_changes",
    lambda s, d: O.classify(V.ops(s, d).withColumn("id", F.col("event_id")), latest_staged(s, d)).select("id", "staged_seq", "action", "kind", "format"),
    """WITH st AS (SELECT vault_id, coalesce(path, "from") AS k, arg_max({'t': type, 'b': "binary", 'e': event_id, 'f': "from", 'o': "to"}, event_id) AS o FROM ops GROUP BY ALL),
    r AS (SELECT vault_id, unnest(CASE WHEN o.t = 'rename' THEN [o.f, o.o] ELSE [k] END) AS at, k, o FROM st),
    l AS (SELECT vault_id, event_id, coalesce(path, "from") AS main, unnest(list_distinct(list_filter([path, "from", "to"], lambda x: x IS NOT NULL))) AS at FROM ops),
    h AS (SELECT l.vault_id, l.event_id, arg_min({'k': r.k, 'o': r.o}, {'far': (l.at <> l.main)::INT, 'e': r.o.e}) AS s FROM l JOIN r ON l.vault_id = r.vault_id AND l.at = r.at GROUP BY ALL),
    j AS (SELECT i.event_id AS id, i.type AS t, i."from" AS f, i."to" AS o, s.o.e AS staged_seq, s.o.t AS st, s.k = i."to" AND s.k <> i."from" AS dest, i."from" = s.o.f AS same, i."to" <> s.o.o AS apart,
        i."binary" OR coalesce(s.o.b, false) AS b FROM ops i LEFT JOIN h ON i.vault_id = h.vault_id AND i.event_id = h.event_id)
    SELECT id, staged_seq,
        CASE WHEN st IS NULL THEN CASE t WHEN 'write' THEN 'apply' WHEN 'delete' THEN 'apply_delete' ELSE 'apply_rename' END
            WHEN t = 'write' THEN CASE st WHEN 'write' THEN CASE WHEN b THEN 'apply' ELSE 'merge' END WHEN 'delete' THEN 'write_sidecar' ELSE 'apply' END
            WHEN t = 'delete' THEN CASE WHEN st <> 'write' THEN 'noop' WHEN b THEN 'write_sidecar' ELSE 'write_conflict' END
            WHEN st = 'rename' AND NOT same THEN 'noop' ELSE 'apply_rename' END AS action,
        CASE WHEN t = 'write' THEN CASE st WHEN 'write' THEN CASE WHEN b THEN 'binary' END WHEN 'delete' THEN 'edit_vs_delete' WHEN 'rename' THEN 'rename_collision' END
            WHEN t = 'delete' THEN CASE st WHEN 'write' THEN 'delete_vs_edit' WHEN 'rename' THEN 'rename_collision' END
            WHEN st = 'write' AND dest OR st = 'rename' AND same AND apart THEN 'rename_collision' END AS kind,
        CASE WHEN t = 'write' THEN CASE WHEN st = 'write' AND NOT b THEN NULL WHEN st IS NOT NULL THEN 'sidecar' END
            WHEN t = 'delete' THEN CASE WHEN st = 'write' THEN CASE WHEN b THEN 'sidecar' ELSE 'callout' END END
            WHEN st = 'write' AND dest THEN 'sidecar' END AS format FROM j""", "ops",
)
register(
    "j8_resolve_collisions",
    lambda s, d: O.resolve_collisions(
        V.manifest(s, d).select("vault_id", "path", "hash", F.lit("k").alias("client_id")), V.disk(s, d).select("vault_id", "path", "hash"),
        V.manifest(s, d).select("vault_id", "path").union(V.manifest(s, d).filter("doc_id % 14 = 0").select("vault_id", F.replace("path", F.lit(".md"), F.lit(".k.md"))))),
    """SELECT vault_id, path, 'k' AS client_id, left(path, length(path) - 3) || CASE WHEN doc_id % 14 = 0 THEN '.k.1.md' ELSE '.k.md' END AS new_path FROM manifest WHERE doc_id % 7 = 0 AND doc_id % 10 <> 0""", "manifest",
)
register(
    "a2_pending_conflicts",
    lambda s, d: O.pending_conflicts(V.ops(s, d).filter("type = 'delete'").select("vault_id", "path", "ts", "event_id"), F.lit("2024-01-10").cast("timestamp_ntz"), V.ops(s, d).filter("path = 'notes/1.md'")),
    """SELECT vault_id, path, max(ts) AS ts, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id, path = 'notes/1.md' AS resolved FROM ops WHERE type = 'delete' AND ts >= TIMESTAMP '2024-01-10' GROUP BY vault_id, path""", "ops",
)
register("l3_sort_by_seq", lambda s, d: O.sort_by_seq(V.ops(s, d)).select("client_id", "seq", "event_id"), "SELECT client_id, seq, event_id FROM ops ORDER BY client_id, seq", "ops")
register(
    "m2_line_hunks",
    lambda s, d: M.line_hunks(V.manifest(s, d).select("vault_id", "path", "text").join(ours(s, d).select("vault_id", "path", F.col("text").alias("our_text")), ["vault_id", "path"]).filter("text <> our_text"), "text", "our_text", "ours")
    .select("vault_id", "path", "start", "end", F.array_join("lines", "|").alias("lines")),
    """SELECT vault_id, path, len(string_split(text, chr(10)))::INT AS start, len(string_split(text, chr(10)))::INT AS "end", 'our last line' AS lines FROM manifest WHERE doc_id % 7 = 0""", "manifest",
)


register(
    "t4_pair_renames", lambda s, d: drained(T.pair_renames(created_and_deleted(stream(s, d, "events")), "2 hours", "1 hour")).withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz")).drop("us"),
    renames_sql("(max(epoch_ms(ts)) - 3600000) * 1000", "x.u + 7200000000 < mark"),
)


def tree_of_suppliers(s, d):
    """A file of every supplier, in a folder for each nation; some folders are hidden."""
    root = scratch(s, "tree")
    rows = V.table(s, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.concat_ws(" ", F.col("s_suppkey").cast("string"), "s_name").alias("value"))
    S.write_tree(rows, "nation", root)
    found = S.scan_tree(s, root)
    return found.select(F.regexp_extract("path", "^nation=([0-9]+)/", 1).alias("nation"), "hash", "size", "is_text", F.decode("content", "UTF-8").alias("text"))


register(
    "s1_scan_tree", tree_of_suppliers,
    """WITH t AS (SELECT CAST(s_nationkey AS VARCHAR) AS nation, s_suppkey || ' ' || s_name || chr(10) AS text FROM supplier)
    SELECT nation, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS size, true AS is_text, text FROM t""",
)


def part_files(s, d):
    """The cells of the parts, written as delimited files with quotes, delimiters and line ends in the cells."""
    out = scratch(s, "cells")
    p = V.table(s, d, "part").select(F.col("p_partkey").cast("string"), F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"\n; x\n\n'), "p_type"), "p_type", F.col("p_size").cast("string"))
    p.write.option("escape", '"').csv(out)
    return S.read_delimited(s, [out])


PART_CELLS = """[CAST(p_partkey AS VARCHAR), p_name || ', "' || p_brand || '"' || chr(10) || '; x' || chr(10) || chr(10) || p_type, p_type, CAST(p_size AS VARCHAR)]"""
register("s8_read_delimited", lambda s, d: part_files(s, d).select(F.array_join("cells", "|").alias("cells")), f"SELECT array_to_string({PART_CELLS}, '|') AS cells FROM part")
register(
    "x14_extract_table_files", lambda s, d: table_cells(part_files(s, d).withColumn("key", F.lit(1)), "key", "cells").select("col", "value"),
    f"SELECT unnest([0, 1, 2, 3]) AS col, unnest({PART_CELLS}) AS value FROM part",
)


def in_batches(s, frame, name, put):
    """Write a frame as files, stream these in batches of one file, and hand each batch to ``put``."""
    source = scratch(s, name)
    frame.repartition(4, "path").write.parquet(source)
    batches = s.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    batches.writeStream.foreachBatch(put).option("checkpointLocation", scratch(s, "state")).trigger(availableNow=True).start().awaitTermination()


def indexed_live(s, d):
    """Four batches of the documents, then every seventh again with another text and every eleventh removed; merged by threes."""
    root = scratch(s, "live")
    rows = V.manifest(s, d).select("vault_id", "path", "hash", F.lit("").alias("title"), F.array().cast("array<string>").alias("tags"), F.col("text").alias("body"), F.lit(False).alias("removed"), "doc_id")
    in_batches(s, rows.drop("doc_id"), "docs", T.live_index(root, tokenize_ascii, fan=3))
    again = rows.filter("doc_id % 7 = 0 or doc_id % 11 = 0").withColumns({"hash": F.lit("changed"), "body": F.lit("changed text"), "removed": F.col("doc_id") % 11 == 0})
    in_batches(s, again.drop("doc_id"), "docs", T.live_index(root, tokenize_ascii, 4, fan=3))
    return T.read_live_index(s, root).groupBy("vault_id", "path").agg(F.count("*").alias("grams"), F.max("gram").alias("last"))


def manifest_live(s, d):
    root = scratch(s, "live")
    rows = V.ops(s, d).select("vault_id", F.coalesce("path", "from").alias("path"), "type", F.coalesce("hash", "pre_hash").alias("hash"), F.col("event_id").alias("seq"))
    in_batches(s, rows, "ops", T.upsert_manifest(root))
    return T.read_manifest(s, root).select("vault_id", "path", "row_no", "hash")


register(
    "t5_live_index", indexed_live,
    f"""WITH t AS (SELECT vault_id, path, CASE WHEN doc_id % 7 = 0 THEN 'changed text' ELSE text END AS text FROM manifest WHERE doc_id % 11 <> 0),
    g AS (SELECT vault_id, path, unnest({GRAMS.format('text')}) AS gram FROM t) SELECT vault_id, path, count(*) AS grams, max(gram) AS last FROM g GROUP BY vault_id, path""", "manifest",
)
register(
    "t5_upsert_manifest", manifest_live,
    """WITH t AS (SELECT vault_id, coalesce(path, "from") AS path, type, coalesce(hash, pre_hash) AS hash, event_id FROM ops WHERE type <> 'rename'),
    f AS (SELECT vault_id, path, max(event_id) AS row_no, arg_max(hash, event_id) AS hash, arg_max(type, event_id) AS type FROM t GROUP BY vault_id, path)
    SELECT vault_id, path, row_no, hash FROM f WHERE type <> 'delete'""", "ops",
)
