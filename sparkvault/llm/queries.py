"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvault.llm import bloomlm, bpe, langid, lexsearch, licenses, lloyd, neardup, packing, pii, quality_classifier, quality_rules, topk, warc
from sparkvault.llm._common import fold_bucket

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.codec_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold_bucket(F.col("doc_id"), 4) == 2
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    trees = langid.fit(docs.filter(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), trees).select("doc_id", "held_out", "lang_pred", "score")


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return scored.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


#: The surrogates' key in the queries; a user passes their own.
PII_KEY = b"sparkvault registered queries"


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.classify(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda doc_id: fold_bucket(doc_id, 5) != 0
    )
    return scored.select("doc_id", (fold_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    joined = {c: F.array_join(c, ",").alias(c) for c in ("sentence_ids", "licenses")}
    return found.select("doc_id", "n_sentences", *joined.values())


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexsearch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.clusters(table(spark, sf_dir, "embeddings"))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = fold_bucket(F.col("doc_id"), 7)
    scored = bloomlm.language_model_scores(table(spark, sf_dir, "documents"), fold != 2)
    return scored.select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_language_id": op5_language_id,
    "op6_warc_round_trip": op6_warc_round_trip,
    "op7_quality_rules": op7_quality_rules,
    "op8_pii_surrogates": op8_pii_surrogates,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_license_scan": op10_license_scan,
    "op11_lexical_search": op11_lexical_search,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_lm_scores": op13_lm_scores,
}


def _clusters_sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    """Lloyd's rounds in DuckDB SQL, one after the other; a rounded-down mean from the remainder."""
    parts = [
        f"""v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS INTEGER) AS cluster, v
            FROM (SELECT * FROM v ORDER BY sha256('{seed}:' || vec_id), v LIMIT {k})
        )"""
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (
            SELECT r, vec_id, v, min(d) AS distance, arg_min(cluster, (d, cluster)) AS cluster FROM (
                SELECT v.*, cluster, CAST(list_sum(list_transform(list_zip(v.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{i}
            ) GROUP BY r, vec_id, v
        )"""
        )
        if i < rounds:
            parts.append(
                f"""s{i} AS MATERIALIZED (
            SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY cluster, i
        ), n{i} AS MATERIALIZED (
            SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{i} GROUP BY cluster
        ), c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(n{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN n{i} USING (cluster))"""
            )
    return f"""
        WITH {", ".join(parts)}
        SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (cluster)"""


def _license_sql() -> str:
    """The licence scan in DuckDB SQL, its tables written out from the operator's.

    Every run of pieces of a sentence that begins with a known first word is
    looked up; of each beginning the longest counts, and a recursion goes from
    each found one to the next that begins behind it.
    """
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(i)})" for i, group in licenses.SENTENCES.items() for s in group)
    rules = ", ".join(f"({quote(name)}, {quote(' ' + ' '.join(seq) + ' ')})" for name, seq in licenses.RULES)
    every = [s for group in licenses.SENTENCES.values() for s in group]
    first = "|".join(sorted({s.split()[0] for s in every} - {"under"} | set(licenses.STARTS)))
    most = max(len(s.split()) for s in every) + 10
    # DuckDB's patterns cannot look ahead: what goes on with "or", "and" or "either" is hidden from the mark and shown again.
    shown = "regexp_replace(lower(replace(w, '|', ' ')), '(?:[ \t][-\u2013\u2014][ \t]|[(,;])(\\s*\\(?(?:or|and|either)(?:[^a-z0-9]|$))', ' \\1', 'g')"
    marked = f"trim(regexp_replace(regexp_replace({shown}, '[ \t][-\u2013\u2014][ \t]|[(,;]', ' | ', 'g'), '[^a-z0-9|]+', ' ', 'g'))"
    return f"""
        WITH RECURSIVE known(sentence, sentence_id) AS (VALUES {known}), rules(name, sequence) AS (VALUES {rules}),
        units AS (SELECT doc_id, unnest(u) AS u, generate_subscripts(u, 1) AS n FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.!?]+(?:[ \t\r\x0B\f\n]|$)') AS u FROM documents)),
        pieces AS (SELECT doc_id, n, list_filter(string_split_regex(u, '\n|[;:][ \t\r\x0B\f]'), lambda s: regexp_matches(s, '[A-Za-z0-9]')) AS p FROM units),
        begins AS (SELECT * FROM (SELECT doc_id, n, p, unnest(range(1, len(p) + 1)) AS i FROM pieces) WHERE regexp_matches(lower(p[i]), '^[^a-z0-9]*(?:{first})(?:[^a-z0-9]|$)')),
        spans AS (SELECT doc_id, n, i, j, array_to_string(p[i:j], chr(10)) AS w FROM (SELECT *, unnest(range(i, least(len(p), i + {most} - 1) + 1)) AS j FROM begins)),
        marks AS (SELECT doc_id, n, i, j, {marked} AS w FROM spans),
        parted AS (SELECT *, coalesce(lag(len(x)) OVER (PARTITION BY doc_id, n, i ORDER BY j), 1) AS least FROM (SELECT *, string_split(w, '|') AS x FROM marks)),
        cuts AS (SELECT *, unnest(range(least, len(x) + 1)) AS c FROM parted),
        keyed AS (SELECT doc_id, n, i, j, c, c = len(x) AS whole, regexp_replace(trim(regexp_replace(array_to_string(x[1:c], ' '), '[ ]+', ' ', 'g')), '{licenses.REFERENCE}', 'under ') AS k FROM cuts),
        hits AS (SELECT doc_id, n, i, max(j) + 1 AS stop, arg_max(sentence_id, (j, c)) AS id FROM keyed JOIN known ON k = sentence AND (whole OR starts_with(k, 'under ')) GROUP BY doc_id, n, i),
        nexts AS (SELECT h.doc_id, h.n, h.i, any_value(h.id) AS id, min(o.i) AS next FROM hits h LEFT JOIN hits o ON o.doc_id = h.doc_id AND o.n = h.n AND o.i >= h.stop GROUP BY h.doc_id, h.n, h.i),
        found AS (SELECT * FROM nexts QUALIFY i = min(i) OVER (PARTITION BY doc_id, n) UNION SELECT x.* FROM found f JOIN nexts x ON x.doc_id = f.doc_id AND x.n = f.n AND x.i = f.next),
        ids AS (SELECT doc_id, string_agg(id, ' ' ORDER BY n, i) AS ids FROM found GROUP BY doc_id),
        named AS (
            SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses
            FROM ids JOIN rules ON contains(' ' || ids || ' ', sequence) GROUP BY doc_id
        ),
        counted AS (SELECT doc_id, CAST(sum(len(p)) AS BIGINT) AS n_sentences FROM pieces GROUP BY doc_id)
        SELECT doc_id, n_sentences, coalesce(replace(ids, ' ', ','), '') AS sentence_ids, coalesce(licenses, '') AS licenses
        FROM counted LEFT JOIN ids USING (doc_id) LEFT JOIN named USING (doc_id)"""


ORACLE: dict[str, str] = {
    # All pairs that share a shingle, and the closure of the links.
    "op3_minhash_near_dedup": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) END AS s FROM w
        ), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s), u AS (SELECT doc_id, unnest(s) AS g FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
        m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)""",
    # Base 32 of the SHA-1: the hexadecimal digits as bits, five bits a letter.
    "op6_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
        b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', substr(h, i, 1)) - 1), 4, '0')), '') AS bits FROM p),
        d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + list_sum(list_transform(range(0, 5), lambda k: CASE WHEN substr(bits, 5 * i + k + 1, 1) = '1' THEN 16 >> CAST(k AS INTEGER) ELSE 0 END))::INTEGER, 1)), '') AS digest FROM b),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM d)
        SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first THEN first END AS refers_to, true AS digest_ok FROM f""",
    "op7_quality_rules": """
        WITH d AS (
            SELECT doc_id, source, coalesce(text, '') AS t FROM documents
        ), w AS (
            SELECT doc_id, source, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
                   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
            FROM d
        ), x AS (
            SELECT doc_id, w, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g
            FROM w
        ), u AS (
            SELECT doc_id, unnest(g) AS g, generate_subscripts(g, 1) AS i FROM x
        ), r AS (
            SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM u) WHERE n > 1
        ), p AS (
            SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id
        ), c AS (
            SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
                   CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
                   CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
                   CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
            FROM w LEFT JOIN p ON w.doc_id = p.doc_id
        ), b AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
        ), h AS (
            SELECT source, count(*) AS n, count_if(base_failed) AS f FROM b WHERE source IS NOT NULL GROUP BY source
        ), m AS (
            SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM h
        ), z AS (
            SELECT m, greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 0 END, 1) AS s FROM m
        ), j AS (
            SELECT source FROM h, z WHERE (f + m * s) / (n + s) > 0.5
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND j_source IS NULL AS kept
        FROM (SELECT b.*, j.source AS j_source FROM b LEFT JOIN j ON b.source = j.source)""",
    "op10_license_scan": _license_sql(),
    "op11_lexical_search": """
        WITH t AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
        ), q AS (
            SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> ''))) AS term FROM benchmark
        ), s AS (SELECT count_if(len(w) > 0) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM t),
        f AS (SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM t) GROUP BY doc_id, term),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s WHERE term IN (SELECT term FROM q) GROUP BY term, big_n),
        x AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
            FROM q JOIN w USING (term) JOIN f USING (term), s GROUP BY item_id, doc_id
        ), r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
    "op12_centroid_clusters": _clusters_sql(),
    "op1_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                   vec_id, score
            FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
