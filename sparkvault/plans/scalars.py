"""Registered queries of the scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkvault.functions import exprs as E
from sparkvault.functions import predicates as P
from sparkvault.operators import rules as R
from sparkvault.plans import views as V
from sparkvault.plans.views import with_views

QUERIES, ORACLE = {}, {}
GLOBS, LIMIT = ["*.md", "note-?.txt", "[0-9]*.csv"], 4000
IGNORE = ["src1/", "*.tmp", "!src1/en/", "**/de/1*.md", "src2*"]


def register(name: str, query, sql: str | None = None, *views: str) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = with_views(sql, *views) if views else sql


def over(table, columns, key):
    """A query of columns, made from a function, over a whole table beside its key."""
    def run(s, d):
        return V.table(s, d, table).select(key, *columns())
    return run


def paths(s, d):
    """Paths of every document, some with what the rules are about."""
    m = V.manifest(s, d)
    n = F.col("doc_id") % 13
    odd = [".vault/access", ".vault/README.md", ".vault/state/x", "a/.git/x", "/abs.md", "a//b.md", "a/../b.md", "con.txt", "dir/LPT1", "a/b. /c.md", "a/b.", "a\\b", ""]
    path = F.col("path")
    for i, p in enumerate(odd):
        path = F.when(n == i, F.lit(p)).otherwise(path)
    return m.select("doc_id", F.when(F.col("doc_id") % 2 == 0, path).otherwise(F.col("path")).alias("path"), F.length("text").alias("size"))


PATHS = """p AS (SELECT doc_id, length(text) AS size, CASE WHEN doc_id % 2 = 0 THEN CASE doc_id % 13 WHEN 0 THEN '.vault/access' WHEN 1 THEN '.vault/README.md' WHEN 2 THEN '.vault/state/x'
    WHEN 3 THEN 'a/.git/x' WHEN 4 THEN '/abs.md' WHEN 5 THEN 'a//b.md' WHEN 6 THEN 'a/../b.md' WHEN 7 THEN 'con.txt' WHEN 8 THEN 'dir/LPT1' WHEN 9 THEN 'a/b. /c.md' WHEN 10 THEN 'a/b.'
    WHEN 11 THEN 'a\\b' ELSE '' END ELSE path END AS path FROM manifest)"""

register("h1_content_hash", over("documents", lambda: [E.content_hash(F.col("text")).alias("h"), E.parse_hash_hex(F.concat(F.upper(F.sha2("text", 256)), F.when(F.col("doc_id") % 2 == 0, "0").otherwise(""))).alias("p")], "doc_id"),
         "SELECT doc_id, sha256(text) AS h, CASE WHEN doc_id % 2 = 1 THEN sha256(text) END AS p FROM documents")
register("h2_token_hash", over("documents", lambda: [E.token_hash(F.col("text")).alias("h")], "doc_id"), "SELECT doc_id, substr(sha256(text), 1, 24) AS h FROM documents")
register("h3_review_tag", over("orders", lambda: [E.format_review_tag(F.col("o_orderdate")).alias("t"), E.parse_review_tag(E.format_review_tag(F.col("o_orderdate"))).cast("timestamp_ntz").alias("back")], "o_orderkey"),
         "SELECT o_orderkey, strftime(o_orderdate, 'reviewed-%Y-%m-%dT%H-%M-%SZ') AS t, o_orderdate AS back FROM orders")
VERSION = "concat_ws('.', o_orderkey % 3, o_custkey % 12, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE CAST(o_custkey % 4 AS {t}) END)"
register("h4_compare_versions", lambda s, d: V.table(s, d, "orders").select("o_orderkey", E.compare_versions(F.expr(VERSION.format(t="STRING")), F.lit("v1.3")).alias("c")),
         f"""WITH v AS (SELECT o_orderkey, list_transform(string_split({VERSION.format(t='VARCHAR')}, '.'), lambda x: coalesce(try_cast(x AS INTEGER), 0)) AS v FROM orders)
         SELECT o_orderkey, CASE WHEN v < [1, 3, 0] THEN -1 WHEN v > [1, 3, 0] THEN 1 ELSE 0 END AS c FROM v""")  # fmt: skip
register("h5_parse_size", lambda s, d: V.table(s, d, "part").select("p_partkey", E.parse_size(F.expr("concat(p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'kb' WHEN 1 THEN ' MB' WHEN 2 THEN 'gb' WHEN 3 THEN '' ELSE 'tb' END)")).alias("n")),
         "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_partkey * 1024 WHEN 1 THEN p_partkey * 1048576 WHEN 2 THEN p_partkey * 1073741824 WHEN 3 THEN p_partkey END AS n FROM part")
register("h6_parse_duration", lambda s, d: V.table(s, d, "part").select("p_partkey", E.parse_duration(F.expr("concat(p_size, CASE p_partkey % 5 WHEN 0 THEN 'd' WHEN 1 THEN 'h30m' WHEN 2 THEN 'w' WHEN 3 THEN 'ms' ELSE 'y' END)")).alias("n")),
         "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size * 86400.0::DOUBLE WHEN 1 THEN p_size * 3600.0::DOUBLE + 1800 WHEN 2 THEN p_size * 604800.0::DOUBLE WHEN 3 THEN p_size * 0.001::DOUBLE END AS n FROM part")
register("h7_humanize_ago", lambda s, d: V.table(s, d, "events").select("event_id", E.humanize_ago(F.unix_seconds(F.lit("2024-01-20 00:00:00").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))).alias("a")),
         """WITH s AS (SELECT event_id, epoch(TIMESTAMP '2024-01-20')::BIGINT - CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)
         SELECT event_id, CASE WHEN s < 0 THEN '—' WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS a FROM s""")  # fmt: skip
register("h8_parse_vault_address", lambda s, d: V.table(s, d, "pages").select("page_id", E.parse_vault_address(F.col("url")).alias("a")).select("page_id", "a.host", "a.vault_id"),
         r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, nullif(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '^[a-z]+://[^/]+.*/([^/]+)$', 1), '') AS vault_id FROM pages""")  # fmt: skip
register("h9_page_url", lambda s, d: V.manifest(s, d).select("doc_id", E.page_url(F.lit("/n/"), F.concat(F.lit("a b/"), "path")).alias("u"), E.asset_url(F.lit("/n"), F.concat(F.lit("100%/é~/"), "path")).alias("x")),
         "SELECT doc_id, '/n/a%20b/' || left(path, length(path) - 3) AS u, '/n/100%25/%C3%A9~/' || path AS x FROM manifest", "manifest")
HREFS = "h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1)) AS href FROM pages)"


def hrefs(s, d):
    from sparkvault.operators.text import extract_hrefs

    return extract_hrefs(V.table(s, d, "pages"), "page_id", "html")


register("h10_rewrite_links", lambda s, d: hrefs(s, d).select("page_id", E.rewrite_link(F.substring("href", 2, 1000), F.lit("/base/")).alias("u")),
         f"WITH {HREFS}, t AS (SELECT page_id, substr(href, 2) AS x FROM h) SELECT page_id, CASE WHEN x = '' OR regexp_matches(x, '^(/|#|\\?|[A-Za-z][A-Za-z0-9+.-]*:)') THEN x ELSE '/base/' || regexp_replace(x, '^\\./', '') END AS u FROM t")
register("h11_set_query_param", lambda s, d: V.table(s, d, "pages").select("page_id", E.set_query_param(F.col("url"), "page", F.lit("9")).alias("u")),
         r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS b, regexp_extract(url, '#.*$') AS f, list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^page(=|$)')) AS q FROM pages)
         SELECT page_id, b || '?' || array_to_string(list_append(q, 'page=9'), '&') || f AS u FROM p""")  # fmt: skip
register("h12_versioned_url", lambda s, d: V.manifest(s, d).select("doc_id", E.versioned_url(F.lit("/n/"), F.lit("v1"), F.col("path")).alias("u")), "SELECT doc_id, '/n/@v1/' || path AS u FROM manifest", "manifest")
register("h13_parse_versioned_url", lambda s, d: V.manifest(s, d).select("doc_id", E.parse_versioned_url(F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("/@v1/"), "path")).otherwise(F.concat(F.lit("/"), "path"))).alias("p")).select("doc_id", "p.tag", "p.rest"),
         "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'v1' END AS tag, path AS rest FROM manifest", "manifest")
register("h14_normalize_nav_url", lambda s, d: V.table(s, d, "pages").select("page_id", E.normalize_nav_url(F.concat(F.regexp_replace("url", "/*(?:[?#].*)?$", ""), F.when(F.col("page_id") % 2 == 0, "/index/").otherwise("//"))).alias("u")),
         "SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*', ''), '/+$', '') AS u FROM pages")
register("h15_case_fold", lambda s, d: V.table(s, d, "customer").select("c_custkey", E.case_fold(F.col("c_name")).alias("f")), "SELECT c_custkey, lower(c_name) AS f FROM customer")
register("h16_sidecar_path", lambda s, d: V.manifest(s, d).select("doc_id", E.sidecar_path(F.col("path"), F.lit("2026-05-15T14:23:11Z")).alias("s"), E.case_collision_path(F.lit("a.b/noext"), F.lit("2026-05-15T14:23:11Z")).alias("c")),
         "SELECT doc_id, left(path, length(path) - 3) || '.conflict.20260515T142311Z.md' AS s, 'a.b/noext.casecollision.20260515T142311Z' AS c FROM manifest", "manifest")
register("h17_git_marker_text", lambda s, d: V.table(s, d, "documents").select("doc_id", E.git_marker_text(F.col("text"), F.col("source"), F.lit("ours"), F.lit("theirs")).alias("m")),
         "SELECT doc_id, '<<<<<<< ours' || chr(10) || CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN text ELSE text || chr(10) END || '=======' || chr(10) || source || chr(10) || '>>>>>>> theirs' || chr(10) AS m FROM documents")
register("h18_comment_block_text", lambda s, d: V.table(s, d, "documents").select("doc_id", E.comment_block_text(F.lit("lost"), F.col("text"), F.lit("#"), F.lit("")).alias("m")),
         "SELECT doc_id, '# lost' || chr(10) || array_to_string(list_transform(string_split(regexp_replace(text, '\\n$', ''), chr(10)), lambda x: CASE WHEN x = '' THEN '#' ELSE '# ' || x END), chr(10)) || chr(10) AS m FROM documents")
register("h19_callout_text", lambda s, d: V.table(s, d, "documents").select("doc_id", E.callout_text(F.lit("conflict"), F.col("source"), F.col("text")).alias("m")),
         "SELECT doc_id, '> [!conflict] ' || source || chr(10) || '> ```' || chr(10) || array_to_string(list_transform(string_split(regexp_replace(text, '\\n$', ''), chr(10)), lambda x: CASE WHEN x = '' THEN '>' ELSE '> ' || x END), chr(10)) || chr(10) || '> ```' || chr(10) AS m FROM documents WHERE NOT contains(text, '```') UNION ALL SELECT doc_id, NULL FROM documents WHERE contains(text, '```')")
register("h20_delete_vs_edit_text", lambda s, d: V.table(s, d, "documents").select("doc_id", E.delete_vs_edit_text(F.when(F.col("doc_id") % 2 == 0, "comment").otherwise("callout"), F.lit("gone"), F.col("text")).alias("m")),
         "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '# gone' || chr(10) ELSE '> [!conflict] gone' || chr(10) || chr(10) END || text AS m FROM documents")
register("h21_parse_embed_label", lambda s, d: V.table(s, d, "part").select("p_partkey", E.parse_embed_label(F.expr("concat(p_size, '|dark|', p_name, '|', p_size, 'x', p_partkey % 100, '|light')")).alias("e")).select("p_partkey", "e.*"),
         "SELECT p_partkey, p_size AS width, CAST(NULL AS INTEGER) AS height, 'dark' AS variant, p_name AS alt FROM part")
register("h22_excerpt", lambda s, d: V.table(s, d, "documents").select("doc_id", E.excerpt(F.col("text")).alias("x")),
         "WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[\\t\\n\\v\\f\\r ]+', ' ', 'g')) AS f FROM documents) SELECT doc_id, CASE WHEN length(f) <= 160 THEN f ELSE regexp_replace(substr(f, 1, 160), ' [^ ]*$', '') || '…' END AS x FROM f")
register("h23_op_paths", lambda s, d: V.ops(s, d).select("event_id", E.primary_path(F.col("type"), F.col("path"), F.col("from")).alias("p"), E.target_path(F.col("type"), F.col("path"), F.col("to")).alias("t")),
         'SELECT event_id, coalesce("from", path) AS p, coalesce("to", path) AS t FROM ops', "ops")
register("p1_validate_ops", lambda s, d: V.ops(s, d).select("event_id", P.invalid_op(F.col("type"), F.col("seq") - 1, F.lit(1), F.col("path"), F.col("from"), F.col("to"), F.col("data"), F.col("binary"), F.when(F.col("event_id") % 7 > 0, F.col("pre_hash"))).alias("r")),
         """SELECT event_id, CASE WHEN seq = 1 THEN 'bad_seq' WHEN type = 'write' THEN NULL WHEN event_id % 7 = 0 THEN 'no_pre_hash' WHEN "binary" THEN 'has_data' END AS r FROM ops""", "ops")  # fmt: skip
register("p2_validate_path", lambda s, d: paths(s, d).select("doc_id", P.invalid_path(F.col("path")).alias("r")),
         f"""WITH {PATHS} SELECT doc_id, CASE WHEN path = '' THEN 'empty' WHEN contains(path, '\\') THEN 'backslash' WHEN path LIKE '/%' THEN 'absolute' WHEN contains(path, '//') OR contains(path, '/../') THEN 'unclean'
         WHEN path LIKE '%.' THEN 'ends_in_dot' WHEN contains(path, ' /') THEN 'ends_in_space' WHEN contains(path, '/.') THEN 'hidden' WHEN path IN ('con.txt', 'dir/LPT1') THEN 'reserved' END AS r FROM p""", "manifest")  # fmt: skip
register("p3_validate_vault_id", lambda s, d: V.table(s, d, "customer").select("c_custkey", P.valid_vault_id(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))))).alias("v")),
         "SELECT c_custkey, c_custkey % 2 = 1 AS v FROM customer")
register("p4_path_class", lambda s, d: paths(s, d).select("doc_id", P.path_class(F.col("path")).alias("c")),
         f"WITH {PATHS} SELECT doc_id, CASE path WHEN '.vault/README.md' THEN 'public_control' WHEN '.vault/access' THEN 'config' WHEN '.vault/state/x' THEN 'control' WHEN 'a/.git/x' THEN 'hidden' WHEN 'a/../b.md' THEN 'hidden' ELSE 'plain' END AS c FROM p", "manifest")
register("p5_admit_by_allowlist", lambda s, d: paths(s, d).select("doc_id", P.allowlist_reason(F.col("path"), F.col("size"), GLOBS, LIMIT).alias("r")),
         f"WITH {PATHS} SELECT doc_id, CASE WHEN NOT regexp_matches(regexp_extract(path, '[^/]*$'), '^([^/]*\\.md|note-[^/]\\.txt|[0-9][^/]*\\.csv)$') THEN 'type' WHEN size > 4000 THEN 'size' END AS r FROM p", "manifest")
register("p6_has_history", lambda s, d: paths(s, d).select("doc_id", P.allowlist_reason(F.col("path"), F.col("size"), ["1*.md"], 2000).isNull().alias("h")),
         f"WITH {PATHS} SELECT doc_id, regexp_matches(regexp_extract(path, '[^/]*$'), '^1[^/]*\\.md$') AND size <= 2000 AS h FROM p", "manifest")
register("p7_admit_control_plane", lambda s, d: paths(s, d).select("doc_id", P.control_reason(F.col("path"), F.col("size"), GLOBS, LIMIT).alias("r")),
         f"WITH {PATHS} SELECT doc_id, CASE WHEN path LIKE '.vault/%' THEN CASE WHEN size > 4000 THEN 'size' END WHEN NOT regexp_matches(regexp_extract(path, '[^/]*$'), '^([^/]*\\.md|note-[^/]\\.txt|[0-9][^/]*\\.csv)$') THEN 'type' WHEN size > 4000 THEN 'size' END AS r FROM p", "manifest")
_IGN = "CASE WHEN regexp_matches(path, '^(.*/)?src2[^/]*(/.*)?$') THEN true WHEN regexp_matches(path, '^([^/]+/)*de/1[^/]*\\.md(/.*)?$') THEN true WHEN regexp_matches(path, '^src1/en/.*$') THEN false WHEN regexp_matches(path, '^(.*/)?[^/]*\\.tmp(/.*)?$') THEN true WHEN regexp_matches(path, '^(.*/)?src1/.*$') THEN true ELSE false END"
register("p8_ignore_filter", lambda s, d: paths(s, d).select("doc_id", P.excluded(F.col("path"), IGNORE).alias("x")),
         f"WITH {PATHS} SELECT doc_id, CASE WHEN path = '.vault/README.md' THEN false WHEN path LIKE '.vault/%' OR path IN ('a/.git/x', 'a/../b.md') THEN true ELSE {_IGN} END AS x FROM p", "manifest")
register("p9_match_ignore_patterns", lambda s, d: paths(s, d).select("doc_id", P.ignored(F.col("path"), IGNORE).alias("x")), f"WITH {PATHS} SELECT doc_id, {_IGN} AS x FROM p", "manifest")


def vault_rules(s, d):
    """Rules of each vault from its documents, numbered by these: a class under a folder, a negated name, a folder at any depth, an extension."""
    m = V.manifest(s, d).filter("doc_id % 5 = 0")
    pattern = F.expr(r"""CASE doc_id % 4 WHEN 0 THEN concat('/', split_part(path, '/', 1), '/**/[0-4', '\\', '5]*.md') WHEN 1 THEN concat('!', doc_id - 5, '.m?')
        WHEN 2 THEN concat(split_part(path, '/', 2), '/') ELSE '*[13579].md' END""")
    return m.select("vault_id", F.when(F.col("doc_id") % 3 == 0, "edit-ignore").otherwise("view").alias("section"), F.col("doc_id").alias("ordinal"), pattern.alias("pattern"))


register("p9_rule_table", lambda s, d: R.match_rules(V.manifest(s, d), vault_rules(s, d)),
         """WITH r AS (SELECT vault_id, CASE WHEN doc_id % 3 = 0 THEN 'edit-ignore' ELSE 'view' END AS section, doc_id AS n, split_part(path, '/', 1) AS a, split_part(path, '/', 2) AS b FROM manifest WHERE doc_id % 5 = 0),
         h AS (SELECT m.vault_id, path, section, arg_max(n % 4 <> 1, n) AS ignored FROM manifest m JOIN r ON m.vault_id = r.vault_id AND CASE n % 4 WHEN 0 THEN split_part(path, '/', 1) = a AND regexp_matches(path, '/[0-5][^/]*[.]md$')
             WHEN 1 THEN split_part(path, '/', -1) = (n - 5) || '.md' WHEN 2 THEN split_part(path, '/', 2) = b OR split_part(path, '/', 1) = b ELSE regexp_matches(path, '[13579][.]md$') END GROUP BY ALL)
         SELECT * FROM h""", "manifest")  # fmt: skip
_EXT = "['md','CSV','html','png','zip','log','typ'][1 + doc_id % 7]"
register("p10_dispatch_mode", lambda s, d: V.table(s, d, "documents").select("doc_id", P.dispatch_mode(F.expr("concat('a.b/x.', element_at(array('md','CSV','html','png','zip','log','typ'), cast(1 + doc_id % 7 as int)))"), ["zip"]).alias("m")),
         f"SELECT doc_id, CASE {_EXT} WHEN 'md' THEN 'markdown' WHEN 'CSV' THEN 'tabular' WHEN 'html' THEN 'html' WHEN 'png' THEN 'asset' WHEN 'zip' THEN 'text' WHEN 'log' THEN 'text' ELSE 'typst' END AS m FROM documents")
register("p11_content_type", lambda s, d: V.table(s, d, "documents").select("doc_id", P.content_type(F.expr("concat('a.b/x.', element_at(array('md','CSV','html','png','zip','log','typ'), cast(1 + doc_id % 7 as int)))")).alias("m")),
         f"SELECT doc_id, CASE {_EXT} WHEN 'md' THEN 'text/markdown; charset=utf-8' WHEN 'html' THEN 'text/html; charset=utf-8' WHEN 'png' THEN 'image/png' ELSE 'application/octet-stream' END AS m FROM documents")
register("p12_is_text", lambda s, d: V.table(s, d, "documents").select("doc_id", P.is_text(F.expr("cast(concat(text, CASE WHEN doc_id % 3 = 0 THEN unhex('ff') ELSE unhex('00') END) as string)")).alias("t"), P.looks_binary(F.expr("cast(concat(CASE WHEN doc_id % 3 = 0 THEN unhex('00') ELSE unhex('61') END, cast(text as binary)) as binary)")).alias("b")),
         "SELECT doc_id, doc_id % 3 <> 0 AS t, doc_id % 3 = 0 AS b FROM documents")
register("p14_has_conflict_marker", lambda s, d: V.table(s, d, "documents").select("doc_id", P.has_conflict_marker(F.concat("text", F.when(F.col("doc_id") % 2 == 0, "\n> [!conflict] x").otherwise("\n >>>>>>> y"))).alias("c")),
         "SELECT doc_id, doc_id % 2 = 0 AS c FROM documents")
register("p15_conflict_format", lambda s, d: V.table(s, d, "documents").select("doc_id", P.conflict_format(F.expr("concat('a/x.', element_at(array('md','py','png','txt','html','log','unknown'), cast(1 + doc_id % 7 as int)))")).alias("f")),
         "SELECT doc_id, ['callout','comment','sidecar','marker','comment','marker','sidecar'][1 + doc_id % 7] AS f FROM documents")
register("p16_valid_names", lambda s, d: V.table(s, d, "customer").select("c_custkey", P.valid_tag(F.replace("c_name", F.lit("#"), F.lit("."))).alias("tag"), P.valid_token(F.col("c_name")).alias("token"), P.valid_request_id(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("request")),
         "SELECT c_custkey, true AS tag, false AS token, true AS request FROM customer")
register("p19_min_query_len", lambda s, d: V.table(s, d, "part").select("p_partkey", P.long_enough(F.expr("substring(p_name, 1, cast(p_partkey % 4 as int))")).alias("ok")), "SELECT p_partkey, p_partkey % 4 >= 2 AS ok FROM part")
