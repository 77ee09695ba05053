"""Every registered query with SQL against DuckDB on the small tables, and properties of the operators."""

import datetime
import decimal
import os

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkvault import plans
from sparkvault.functions import exprs, predicates
from sparkvault.operators import changes, history, merge, oplog, search
from sparkvault.operators import text as texts
from sparkvault.plans import views
from sparkvault.sources import files
from sparkvault.streaming import streams

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS FROM '{path + '/*' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and np.isnan(v):
        return None
    if isinstance(v, (bool, np.bool_, int, np.integer, float, np.floating, decimal.Decimal)):
        return round(float(v), 6)
    return str(v) if isinstance(v, (pd.Timestamp, datetime.date)) else v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = plans.QUERIES[name](spark, sf).toPandas(), duck.sql(plans.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_fanout_counts_equal_the_pairs(spark):
    ops = spark.createDataFrame([("v1", "a", "x.md"), ("v1", "a", ".vault/config.toml"), ("v1", "b", ".vault/access"), ("v1", None, "y"), ("v2", "c", None), (None, "d", "z"), ("v3", "e", "z")], "vault_id string, client_id string, path string")
    clients = spark.createDataFrame([("v1", "a", True), ("v1", "b", False), ("v1", "f", None), ("v1", "b", False), ("v1", None, True), ("v2", "c", True), ("v2", "g", False), (None, "h", True)], "vault_id string, client_id string, admin boolean")
    want = oplog.fanout_ops(ops, clients).groupBy("vault_id", "recipient").count().toPandas()
    got = oplog.fanout_counts(oplog.sent_ops(ops), clients).groupBy("vault_id", "recipient").agg(F.sum("ops").alias("count")).toPandas()
    assert rows(got) == rows(want) and len(want) > 3
    plan = plans.QUERIES["j22_fanout_ops"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1)" in plan[plan.index("Join"):]  # ops are counted below the joins


def test_histories_join_once_and_sort_no_structs(spark, sf):
    plan = views.history(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    odd = spark.createDataFrame([("v", "p", 1, "M", "a", "x", 1), ("v", "p", 2, "M", "b", "y", 2), ("v", "p", 2, "M", "c", "y", 2), ("v", "q", 1, "M", "d", "x", 1), ("v", "q", 3, "D", "e", "x", 3), (None, "r", None, "M", "f", None, None), ("v", None, 1, "M", "g", "x", 1)], "vault_id string, path string, ordinal long, action string, hash string, author string, author_ts long")
    got = {(r.vault_id, r.path, r.hash) for r in history.snapshot_at(odd).collect()}
    assert got == {("v", "p", "c"), (None, "r", "f"), ("v", None, "g")}
    newest = history.at_newest(odd)
    assert newest.count() == 5 and "SortAggregate" not in newest._jdf.queryExecution().executedPlan().toString()


def test_search_in_blocks_makes_no_row_for_each_pair(spark, sf, duck, monkeypatch):
    for name, value in (("QUERY_ROWS", 3), ("BLOCK_QUERIES", 2), ("BLOCK_DOCS", 7)):
        monkeypatch.setattr(search, name, value)
    assert rows(plans.QUERIES["x7_search"](spark, sf).toPandas()) == rows(duck.sql(plans.ORACLE["x7_search"]).df())
    docs = spark.createDataFrame([("v", f"{i:03}.md", ["t"], f"the title {i}", "the and of") for i in range(300)], "vault_id string, path string, tags array<string>, title string, body string")
    asked = spark.createDataFrame([(i, "the and") for i in range(6)], "qid long, q string")
    found = search.search(search.build_index(docs), asked, docs, 2)
    assert [(r.qid, r.rank, r.path, r.truncated) for r in found.orderBy("qid", "rank").collect()] == [(i, n, f"{n - 1:03}.md", True) for i in range(6) for n in (1, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # of three queries each, and nothing else makes rows


def test_base_by_hash_takes_dated_changes_as_they_are(spark, sf):
    plan = plans.QUERIES["j20_find_base_by_hash"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3  # of the wanted, of the history, and of both


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_diff_applied_gives_the_other_side(spark, sf):
    a, b = views.manifest(spark, sf), views.disk(spark, sf)
    ops = changes.reconcile(b, a).withColumn("seq", F.lit(1))
    state = oplog.apply_ops(a.select("vault_id", "path", "hash"), ops)
    assert state.exceptAll(b.select("vault_id", "path", "hash")).count() == 0 and state.count() == b.count()


def test_coalesce_is_idempotent(spark, sf):
    once = oplog.coalesce_writes(views.ops(spark, sf))
    assert oplog.coalesce_writes(once).count() == once.count()


OP = "vault_id string, id int, seq int, type string, path string, `from` string, `to` string, binary boolean"


@pytest.mark.parametrize(
    ("incoming", "staged", "want"),
    [
        (("write", "a.md", None, None), None, ("apply", None, None)),
        (("delete", "a.md", None, None), None, ("apply_delete", None, None)),
        (("rename", None, "a.md", "b.md"), None, ("apply_rename", None, None)),
        (("write", "a.md", None, None), ("write", "a.md", None, None), ("merge", None, None)),
        (("write", "a.md", None, None), ("delete", "a.md", None, None), ("write_sidecar", "edit_vs_delete", "sidecar")),
        (("write", "b.md", None, None), ("rename", None, "a.md", "b.md"), ("apply", "rename_collision", "sidecar")),
        (("delete", "a.md", None, None), ("write", "a.md", None, None), ("write_conflict", "delete_vs_edit", "callout")),
        (("delete", "a.py", None, None), ("write", "a.py", None, None), ("write_conflict", "delete_vs_edit", "comment")),
        (("delete", "a.png", None, None), ("write", "a.png", None, None), ("write_sidecar", "delete_vs_edit", "sidecar")),
        (("delete", "a.md", None, None), ("delete", "a.md", None, None), ("noop", None, None)),
        (("delete", "a.md", None, None), ("rename", None, "a.md", "b.md"), ("noop", "rename_collision", None)),
        (("rename", None, "a.md", "b.md"), ("write", "b.md", None, None), ("apply_rename", "rename_collision", "sidecar")),
        (("rename", None, "a.md", "b.md"), ("write", "a.md", None, None), ("apply_rename", None, None)),
        (("rename", None, "a.md", "b.md"), ("rename", None, "a.md", "c.md"), ("apply_rename", "rename_collision", None)),
        (("rename", None, "a.md", "b.md"), ("rename", None, "a.md", "b.md"), ("apply_rename", None, None)),
        (("rename", None, "a.md", "b.md"), ("delete", "a.md", None, None), ("apply_rename", None, None)),
    ],
)
def test_classify(spark, incoming, staged, want):
    row = lambda op: [("v", 1, 1, *op, False)] if op else []
    out = oplog.classify(spark.createDataFrame(row(incoming), OP), spark.createDataFrame(row(staged), OP)).collect()
    assert [(r.action, r.kind, r.format) for r in out] == [want]


def test_three_way_merge(spark):
    base = "a\nb\nc\nd\ne"
    cases = [
        ("one", base, "A\nb\nc\nd\ne", "a\nb\nc\nd\nE", "A\nb\nc\nd\nE", 0),
        ("same", base, "a\nX\nc\nd\ne", "a\nX\nc\nd\ne", "a\nX\nc\nd\ne", 0),
        ("both", base, "a\nb\nO\nd\ne", "a\nb\nT\nd\ne", "a\nb\n<<<<<<< ours\nO\n=======\nT\n>>>>>>> theirs\nd\ne", 1),
        ("tail", base + "\n", base + "\nf\n", "z\n" + base + "\n", "z\n" + base + "\nf\n", 0),
    ]
    data = spark.createDataFrame([("v", n, b, o, t) for n, b, o, t, _, _ in cases], "vault_id string, path string, base_text string, our_text string, their_text string")
    out = {r.path: (r.merged, r.conflicts) for r in merge.merge_texts(data).collect()}
    assert out == {n: (m, c) for n, _, _, _, m, c in cases}


def test_line_hunks_rebuild_the_other_text(spark):
    r = np.random.default_rng(3)
    cases = [("", ""), ("a", ""), ("", "a\nb"), ("a\nb\na\nb", "b\na\nb\na"), ("1\n2\n3\n4", "3\n4\n1\n2"), (None, "x")]
    for _ in range(150):
        base = [str(x) for x in r.integers(0, 25, r.integers(0, 20))]
        other = [x for x in base if r.random() > 0.2]
        for _ in range(r.integers(0, 4)):
            other.insert(r.integers(0, len(other) + 1), str(r.integers(0, 30)))
        if r.random() < 0.3:
            other = other[len(other) // 2 :] + other[: len(other) // 2]
        cases.append(("\n".join(base), "\n".join(other)))
    rows = spark.createDataFrame([("v", str(i), a, b) for i, (a, b) in enumerate(cases)], "vault_id string, path string, base string, other string")
    hunks = {}
    for h in merge.line_hunks(rows, "base", "other", "ours").collect():
        hunks.setdefault(int(h.path), []).append((h.start, h.end, list(h.lines)))
    for i, (a, b) in enumerate(cases):
        lines, out, at = (a or "").split("\n"), [], 0
        for start, end, new in sorted(hunks.get(i, [])):
            assert start >= at
            out += lines[at:start] + new
            at = end
        assert "\n".join(out + lines[at:]) == (b or "")
        assert (i in hunks) == ((a or "") != (b or ""))


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).collect()[0].x
    assert value(exprs.sidecar_path(F.lit("Foo.md"), F.lit("2026-05-15T14:23:11Z"))) == "Foo.conflict.20260515T142311Z.md"
    assert value(exprs.parse_size(F.lit("10mb"))) == 10 << 20 and value(exprs.parse_size(F.lit("x"))) is None
    assert value(exprs.parse_duration(F.lit("1h30m"))) == 5400 and value(exprs.parse_duration(F.lit("2w"))) == 1_209_600
    assert value(exprs.compare_versions(F.lit("v1.10"), F.lit("1.9.9"))) == 1 and value(exprs.compare_versions(F.lit("1.0"), F.lit("1"))) == 0
    assert value(exprs.backtick_fence(F.lit("a ```` b"))) == "`````"
    assert value(exprs.humanize_ago(F.lit(None).cast("long"))) == "—"
    assert value(predicates.invalid_path(F.lit("\u00e9.md"))) is None and value(predicates.invalid_path(F.lit("e\u0301.md"))) == "not_normal"
    assert value(predicates.ignored(F.lit("a/b.tmp"), ["*.tmp", "!b.tmp"])) is False
    assert value(texts.extract_frontmatter(F.lit("--\ntitle: X\n")))["title"] is None


def test_search_ranks(spark):
    docs = spark.createDataFrame([("v", "a.md", "Alpha", [], "alpha text"), ("v", "b.md", "Beta", ["t"], "other alpha"), ("v", "c.txt", "", [], "nothing")],
                                 "vault_id string, path string, title string, tags array<string>, body string")
    queries = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "xyzzy")], "qid int, q string")
    out = search.search(search.build_index(docs), queries, docs).collect()
    first = {r.qid: r.path for r in out if r.rank == 1}
    assert first == {1: "a.md", 2: "b.md"}
    shown = search.snippets(search.search(search.build_index(docs), queries, docs), queries, docs).collect()
    s = next(r for r in shown if r.qid == 1 and r.path == "a.md")
    assert s.snippet == "alpha text" and [tuple(h) for h in s.highlights] == [(0, 5)]


def test_search_in_a_saved_index_and_with_many_grams(spark, tmp_path):
    long = " ".join(f"word{i}x{i * 7}" for i in range(60))
    docs = spark.createDataFrame([("v", f"{i}.md", f"T{i}", ["t"], long if i % 2 else long[: 20 * i]) for i in range(12)], "vault_id string, path string, title string, tags array<string>, body string")
    queries = spark.createDataFrame([(1, long), (2, "word1x7 word2x14")], "qid int, q string")
    index = search.build_index(docs)
    files.save_index(index, str(tmp_path / "i"))
    want = search.search(index, queries, docs).collect()
    assert len([r for r in want if r.qid == 1 and r.score == 1]) == 6
    assert sorted(map(tuple, want)) == sorted(map(tuple, search.search(files.load_index(spark, str(tmp_path / "i")), queries, docs).collect()))


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿x;y\n"a;b";2,5\nlone\n')
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "c.tsv").write_text("x\ty\n")
    out = files.read_delimited(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv", "c.tsv")])
    got = sorted((r.path[-5:], r.row, tuple(r.cells)) for r in out.collect())
    assert got == [("a.csv", 0, ("x", "y")), ("a.csv", 1, ("a;b", "2,5")), ("a.csv", 2, ("lone",)), ("b.csv", 0, ("x", "y")), ("b.csv", 1, ("1", "2")), ("c.tsv", 0, ("x", "y"))]


def test_quoted_cells_over_lines_and_blocks(spark, tmp_path):
    r = np.random.default_rng(5)
    pool = ["", "a", "b,c", 'say "hi"', "two\nlines", "x;y", '"', "\n\n", "été", " lead"]
    table = [[pool[i] for i in r.integers(0, len(pool), r.integers(1, 5))] for _ in range(400)]
    quoted = lambda c: '"' + c.replace('"', '""') + '"' if c == "" or set(c) & set(',"\n;') or r.random() < 0.2 else c
    text = "".join(",".join(map(quoted, row)) + ["\n", "\r\n", "\n\n"][r.integers(0, 3)] for row in table)
    (tmp_path / "a.csv").write_bytes(text.encode())
    (tmp_path / "b.csv").write_bytes(('1,"open' + "x" * 50 + "\n" * 40 + "y").encode())
    want = [("a.csv", i, tuple(row)) for i, row in enumerate(table)] + [("b.csv", 0, ("1", "open" + "x" * 50 + "\n" * 40 + "y"))]
    for size in (7, 64, 1 << 20):
        out = files.read_delimited(spark, [str(tmp_path)], block_bytes=size)
        assert sorted((r.path[-5:], r.row, tuple(r.cells)) for r in out.collect()) == want, size
    wide = [[*row, *[""] * (5 - len(row))] for row in table]
    (tmp_path / "c.csv").write_text("".join(",".join('"' + c.replace('"', '""') + '"' for c in row) + "\n" for row in wide))
    duck = duckdb.sql(f"SELECT * FROM read_csv('{tmp_path / 'c.csv'}', header=false, all_varchar=true, quote='\"', escape='\"', delim=',', nullstr='none')").fetchall()
    assert [tuple(r.cells) for r in files.read_delimited(spark, [str(tmp_path / "c.csv")], block_bytes=100).orderBy("row").collect()] == duck


def test_stray_quotes_and_sniffing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a"b,"c"d,"e""f"\nx;1,"\n')
    (tmp_path / "b.csv").write_text('"a,,,,\n";b;c\n1;2,3;4\n')
    (tmp_path / "c.csv").write_text("\ufeff\n\na\n")
    got = sorted((r.path[-5:], r.row, tuple(r.cells)) for r in files.read_delimited(spark, [str(tmp_path)]).collect())
    assert got == [
        ("a.csv", 0, ('a"b', 'c"d,"e"f')), ("a.csv", 1, ("x;1", "\n")), ("b.csv", 0, ("a,,,,\n", "b", "c")), ("b.csv", 1, ("1", "2,3", "4")), ("c.csv", 0, ("a",)),
    ]


def test_scan_tree(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("hi")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "x.md").write_text("no")
    (tmp_path / "bin").write_bytes(b"\xff\x00")
    out = {r.path: (r.size, r.is_text) for r in files.scan_tree(spark, str(tmp_path)).collect()}
    assert out == {"d/a.md": (2, True), "bin": (2, False)}


def test_stream_upserts(spark, tmp_path):
    schema = "vault_id string, path string, type string, hash string, seq long"
    put = streams.upsert_manifest(str(tmp_path / "m"))
    put(spark.createDataFrame([("v", "a", "write", "1", 1), ("v", "b", "write", "1", 2)], schema), 0)
    put(spark.createDataFrame([("v", "a", "delete", None, 3), ("v", "b", "write", "2", 4)], schema), 1)
    put(spark.createDataFrame([("v", "a", "delete", None, 3), ("v", "b", "write", "2", 4)], schema), 1)  # a batch that runs again
    live = streams.read_manifest(spark, str(tmp_path / "m")).collect()
    assert [(r.path, r.hash) for r in live] == [("b", "2")]


LIVE = "vault_id string, path string, hash string, title string, tags array<string>, body string, removed boolean"


def test_live_index_replaces_removes_and_returns(spark, tmp_path):
    root = str(tmp_path / "p")
    put = streams.live_index(root)
    assert streams.read_live_index(spark, root).count() == 0
    put(spark.createDataFrame([("v", "a", "1", "", [], "alpha"), ("v", "b", "1", "", [], "beta"), ("w", "a", "1", "", [], "other")], LIVE.replace(", removed boolean", "")), 0)
    put(spark.createDataFrame([("v", "a", "2", "", [], "gamma", None), ("v", "b", "1", None, None, None, True)], LIVE), 3)
    live = lambda: {(r.vault_id, r.path, r.gram) for r in streams.read_live_index(spark, root).collect()}
    assert ("v", "a", "gam") in live() and ("v", "a", "alp") not in live() and ("w", "a", "oth") in live() and not any(p == "b" for _, p, _ in live())
    put(spark.createDataFrame([("v", "b", "3", "", [], "delta", False)], LIVE), 4)
    assert ("v", "b", "del") in live() and ("v", "b", "bet") not in live()


def test_live_index_is_merged_by_levels(spark, tmp_path):
    from sparkvault.streaming import live

    root, state = str(tmp_path / "p"), {}
    put = streams.live_index(root, fan=3)
    for n in range(14):
        batch = [("v", f"p{(n * 5 + i) % 17}", str(n), "", [], f"word{n}x{i}", (n + i) % 4 == 0) for i in range(4)]
        state.update({r[1]: None if r[6] else r[5] for r in batch})
        for _ in range(2 if n in (5, 8) else 1):  # a batch that runs again, before and after it was merged
            put(spark.createDataFrame(batch, LIVE), n)
    found = live.segments(spark, root)
    assert found == [(0, 8), (9, 11), (12, 12), (13, 13)]
    assert sum(1 for _ in (tmp_path / "p" / "postings").glob("low=*/high=*")) == len(found)  # merged ones are gone
    grams = {}
    for r in streams.read_live_index(spark, root).collect():
        grams.setdefault(r.path, set()).add(r.gram)
    windows = lambda w: {f" {w} "[i : i + 3] for i in range(len(w))}
    assert grams == {p: windows(w) for p, w in state.items() if w}
    oldest = spark.read.parquet(f"{root}/documents/low=0/high=8")
    assert oldest.filter("removed").count() == 0  # nothing older is left to hide


def test_collision_names_have_no_cap(spark):
    local = spark.createDataFrame([("v", "d/a.md", "1", "k"), ("v", "b", "1", "k"), ("v", "c.md", "1", "k"), ("v", "same.md", "2", "k")], "vault_id string, path string, hash string, client_id string")
    incoming = spark.createDataFrame([("v", p, "2") for p in ("d/a.md", "b", "c.md", "same.md")], "vault_id string, path string, hash string")
    names = ["d/a.k.md"] + [f"d/a.k.{i}.md" for i in range(1, 200)] + ["d/a.k.300.md", "b.k", "b.k.2", "c.k.1.md", "b.k.99999999999999999999"]
    out = oplog.resolve_collisions(local, incoming, spark.createDataFrame([("v", n) for n in names], "vault_id string, path string")).collect()
    assert {r.path: r.new_path for r in out} == {"d/a.md": "d/a.k.200.md", "b": "b.k.1", "c.md": "c.k.md"}


def test_trigrams_equal_windows_over_padded_words(spark):
    text = "a ab abc 𝒳𝒴𝒵 été ab abcdef x1"
    words = text.split()
    want = {g for w in words for g in ([" " + w] if len(w) < 3 else [f" {w} "[i : i + 3] for i in range(len(w))])}
    row = spark.createDataFrame([(text,)], "t string").select(texts.trigrams(F.split("t", " ")).alias("g")).first()
    assert set(row.g) == want and len(row.g) == len(want)


def test_refused_files_are_told(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n" * 10)
    (tmp_path / "b.csv").write_text("x,y\n")
    out = files.read_delimited(spark, [str(tmp_path)], limit=10).collect()
    assert sorted((r.path[-5:], r.row) for r in out) == [("a.csv", None), ("b.csv", 0)]
    assert files.read_delimited(spark, [str(tmp_path)]).count() == 11
    assert files.load_index(spark, str(tmp_path / "none")) is None


def test_grams_are_handed_on_as_short_lists(spark, monkeypatch):
    monkeypatch.setattr(search, "GRAM_ROWS", 3)
    batch = pa.record_batch({"vault_id": ["v"] * 10, "path": [f"p{i}" for i in range(10)], "field": ["body"] * 10, "words": ["alpha beta alphabet"] * 9 + [""]})
    out = list(search._grams(iter([batch])))
    assert [b.num_rows for b in out] == [3, 3, 3, 1]
    want = {g for w in ("alpha", "beta", "alphabet") for g in search.word_grams(w)}
    lists = [x for b in out for x in b.column("grams").to_pylist()]
    assert all(sorted(x) == sorted(want) for x in lists[:9]) and lists[9] == []


def test_an_index_is_updated_without_a_sort_of_its_postings(spark):
    docs = spark.createDataFrame([("v", f"p{i}", f"h{i}", "t", ["g"], "alpha beta") for i in range(20)], "vault_id string, path string, hash string, title string, tags array<string>, body string")
    new = docs.withColumn("hash", F.when(F.col("path") == "p3", "new").otherwise(F.col("hash"))).withColumn("body", F.when(F.col("path") == "p3", "gamma").otherwise(F.col("body")))
    updated = search.update_index(search.build_index(docs), docs, new)
    assert sorted(map(tuple, updated.collect())) == sorted(map(tuple, search.build_index(new).collect()))
    plan = updated._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2


def test_live_postings_are_one_row_for_a_field(spark, tmp_path):
    docs = spark.createDataFrame([("v", "a", "h", "t", ["g"], "alpha beta")], "vault_id string, path string, hash string, title string, tags array<string>, body string")
    streams.live_index(str(tmp_path / "live"))(docs, 0)
    assert spark.read.parquet(str(tmp_path / "live" / "postings")).count() == 3
    assert sorted(map(tuple, streams.read_live_index(spark, str(tmp_path / "live")).collect())) == sorted(map(tuple, search.build_index(docs).collect()))
