"""Hash trees, navigation, URLs at tags and metrics on small golden inputs."""

import random

import pytest
from pyspark.sql import functions as F

from sparkvault.operators import access, changes, history, links
from sparkvault.sources import files

FILES = "vault_id string, path string, hash string"


def test_digest_trees_tell_the_changed_directories(spark):
    r = random.Random(1)
    files = {f"{'/'.join(r.choice('abc') for _ in range(r.randrange(0, 4)))}/f{i}".lstrip("/"): str(i) for i in range(120)}
    other = dict(files)
    gone, new, edited = "a/b/only/x", "new/deep/y", next(p for p in files if p.startswith("b/"))
    files[gone], other[new], other[edited] = "1", "2", "edited"
    frame = lambda f: spark.createDataFrame([("v", p, h) for p, h in f.items()] + [("w", "same/z", "1")], FILES)
    left, right = changes.digest_tree(frame(files)), changes.digest_tree(frame(other))
    up = lambda p: {p.rsplit("/", n)[0] if n <= p.count("/") else "" for n in range(1, p.count("/") + 2)}
    want = {d: "changed" for p in (gone, new, edited) for d in up(p)}
    of = lambda f: {d for p in f for d in up(p)}
    want |= {d: "removed" for d in of(files) - of(other)} | {d: "added" for d in of(other) - of(files)}
    assert {r.dir: r.state for r in changes.changed_dirs(left, right).collect()} == want
    root = left.filter("vault_id = 'v' and depth = 0").first()
    assert root.files == len(files) and root.parent is None
    assert changes.changed_dirs(left, left).count() == 0
    assert changes.digest_tree(frame({}).filter("vault_id = 'v'")).count() == 0


def test_a_file_and_a_directory_of_one_name_differ(spark):
    a = changes.digest_tree(spark.createDataFrame([("v", "x", "1"), ("v", "y/z", "1")], FILES))
    b = changes.digest_tree(spark.createDataFrame([("v", "y", "1"), ("v", "x/z", "1")], FILES))
    assert {r.dir: r.state for r in changes.changed_dirs(a, b).collect()} == {"": "changed", "y": "removed", "x": "added"}


def test_navigation_in_order_with_titles_and_counts(spark):
    rows = [
        ("b/z.md", None), ("b/a.md", "Zebra"), ("b/README.md", "Beta Docs"), ("b/index.md", ""), ("Apple.md", None), ("zoo/pic.png", None), ("c/d/e.md", "E"), ("c/readme.md", "readme"), (".git/x.md", None),
        ("index.md", "Root"), ("only/README.md", "Alone"),
    ]
    files = spark.createDataFrame([("v", p, t) for p, t in rows], "vault_id string, path string, title string")
    out = links.nav_tree(files, "/m/").orderBy("vault_id", "key").collect()
    assert [(r.path, r.title, r.url, r.src_path, r.children, r.leaves, r.depth) for r in out] == [
        ("only", "Alone", "/m/only", "only/README.md", 0, 0, 1),
        ("b", "b", "/m/b", "b/index.md", 2, 2, 1), ("b/z.md", "z", "/m/b/z", "b/z.md", 0, 0, 2), ("b/a.md", "Zebra", "/m/b/a", "b/a.md", 0, 0, 2),
        ("c", "c", "/m/c", "c/readme.md", 1, 1, 1), ("c/d", "d", None, None, 1, 1, 2), ("c/d/e.md", "E", "/m/c/d/e", "c/d/e.md", 0, 0, 3),
        ("zoo", "zoo", None, None, 1, 1, 1), ("zoo/pic.png", "pic.png", "/m/zoo/pic.png", "zoo/pic.png", 0, 0, 2), ("Apple.md", "Apple", "/m/Apple", "Apple.md", 0, 0, 1),
    ]


def test_sitemap_has_the_landing_at_the_prefix(spark):
    files = spark.createDataFrame([("v", "README.md"), ("v", "d/index.md"), ("v", "d/x.md"), ("v", "p.png"), ("w", "index.md"), ("w", "README.md"), ("s", "a.md")], "vault_id string, path string")
    files = files.withColumn("mtime", F.lit("2024-01-02").cast("timestamp"))
    vaults = spark.createDataFrame([("v", "/v", True), ("w", "/", True), ("s", "/s", False)], "vault_id string, prefix string, public boolean")
    assert sorted(r.loc for r in links.sitemap_rows(files, vaults).collect()) == ["/", "/v", "/v/d", "/v/d/x"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("/a", ("serve", "a.md")), ("/@t2/a", ("serve", "a.md")), ("/@t1/a", ("not_found", None)), ("/@t3/a", ("not_found", None)), ("/@head/a", ("serve", "a.md")), ("/@none/a", ("not_found", None)),
        ("/@t1/d", ("redirect", "d/index.md")), ("/@t1/d/", ("serve", "d/index.md")), ("/@t3/d/", ("serve", "d/README.md")), ("/@-x/a", ("not_found", None)), ("/@t1", ("serve", "index.md")), ("/@t1/", ("serve", "index.md")),
        ("", ("serve", "index.md")), (None, ("not_found", None)),
    ],
)
def test_urls_at_tags(spark, url, want):
    rows = [(1, "index.md", "M"), (1, "d/index.md", "M"), (2, "a.md", "M"), (3, "a.md", "D"), (3, "d/index.md", "D"), (3, "d/README.md", "M"), (4, "a.md", "M")]
    log = spark.createDataFrame([("v", o, p, a, f"h{o}") for o, p, a in rows], "vault_id string, ordinal long, path string, action string, hash string")
    tags = spark.createDataFrame([("v", f"t{i}", i) for i in (1, 2, 3)], "vault_id string, name string, ordinal long")
    asked = spark.createDataFrame([("v", url, None), ("v", url, None)], "vault_id string, url string, note string")
    out = links.resolve_urls(asked, history.snapshot_at(log), tags, history.path_spans(log)).collect()
    assert [(r.outcome, r.path) for r in out] == [want, want]


def test_routes_with_nulls_beside_them(spark):
    urls = spark.createDataFrame([("/a/b/c", None), ("/a/b/c", None), ("/ab", "x"), ("/", None), (None, None)], "url string, note string")
    mounts = spark.createDataFrame([("root", "/"), ("a", "/a/"), ("ab", "/a/b")], "id string, prefix string")
    out = sorted(((r.url, r.note, r.id) for r in links.route_longest_prefix(urls, mounts).collect()), key=repr)
    assert out == sorted([("/a/b/c", None, "ab"), ("/a/b/c", None, "ab"), ("/ab", "x", "root"), ("/", None, "root"), (None, None, None)], key=repr)
    assert [r.id for r in links.route_longest_prefix(urls, mounts.filter("id = 'a'")).filter("url = '/ab'").collect()] == [None]


def test_quantiles_of_merged_sketches(spark):
    log = spark.range(60_000).select((F.col("id") % 30).alias("day"), (F.col("id") % 2).cast("string").alias("route"), F.lit(200).alias("status"), F.lit(1).cast("long").alias("bytes"), (F.pow(F.pmod(F.xxhash64("id"), F.lit(10_007)) / 10_007, 3) * 1e6).alias("dur_ms"))
    daily = access.latency_sketches(log, ["day", "route"])
    for r in access.sketch_summary(access.merged_sketches(daily, ["route"])).collect():
        own = log.filter(F.col("route") == r.route)
        assert r.requests == own.count()
        for p, q in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
            assert abs(own.filter(F.col("dur_ms") <= q).count() / r.requests - p) < 0.012
    assert max(len(r.sketch) for r in daily.collect()) < 20_000


def test_a_tree_is_written_by_tasks_of_some_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "TASK_FILES", 5)
    rows = spark.range(40).coalesce(1).select((F.col("id") % 3).alias("of"), F.concat(F.lit("text "), "id").alias("value"))
    files.write_tree(rows, "of", str(tmp_path / "tree"))
    found = files.scan_tree(spark, str(tmp_path / "tree")).select("path", F.decode("content", "UTF-8").alias("text")).collect()
    assert sorted((r.path.split("/")[0], r.text) for r in found) == sorted((f"of={i % 3}", f"text {i}\n") for i in range(40))
    assert len({r.path.split("/")[1].split("-")[1] for r in found}) > 3  # tasks
