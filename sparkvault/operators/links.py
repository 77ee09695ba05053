"""Links and URLs: resolution with precedence, mounts, routes, navigation, sitemaps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkvault.functions.exprs import case_fold
from sparkvault.functions.predicates import basename, valid_tag


def _stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def resolve_links(links: DataFrame, files: DataFrame, normalizer: Callable[[Column], Column] = case_fold) -> DataFrame:
    """``links`` (vault_id, target) with dst_path and how: exact, basename, folded, or null.

    The exact path (with or without .md) wins over the basename, that over
    the basename after ``normalizer``, by default case-folded; the smallest
    path answers for several.
    """
    lookup = lambda key, name: files.groupBy("vault_id", key.alias("__key")).agg(F.min("path").alias(name))
    exact = files.select("vault_id", F.regexp_replace("path", r"\.md$", "").alias("__key"), F.col("path").alias("exact"))
    exact = exact.groupBy("vault_id", "__key").agg(F.min("exact").alias("exact"))
    target = F.regexp_replace(F.regexp_replace("target", "^/+", ""), r"\.md$", "")
    rows = links.withColumn("__key", target).join(exact, ["vault_id", "__key"], "left")
    rows = rows.withColumn("__key", F.regexp_extract("__key", "[^/]*$", 0)).join(lookup(_stem(F.col("path")), "by_name"), ["vault_id", "__key"], "left")
    rows = rows.withColumn("__key", normalizer(F.col("__key"))).join(lookup(normalizer(_stem(F.col("path"))), "by_fold"), ["vault_id", "__key"], "left")
    bare = ~F.contains(target, F.lit("/"))
    name, fold = F.when(bare, F.col("by_name")), F.when(bare, F.col("by_fold"))
    how = F.when(F.col("exact").isNotNull(), "exact").when(name.isNotNull(), "basename").when(fold.isNotNull(), "folded")
    return rows.withColumn("dst_path", F.coalesce("exact", name, fold)).withColumn("how", how).select(*links.columns, "dst_path", "how")


def ambiguous_basenames(files: DataFrame) -> DataFrame:
    """(vault_id, name, folded, candidates): basenames, as written and case-folded, that several paths have."""
    each = files.select("vault_id", "path", F.explode(F.array(
        F.struct(_stem(F.col("path")).alias("name"), F.lit(False).alias("folded")), F.struct(case_fold(_stem(F.col("path"))).alias("name"), F.lit(True).alias("folded")),
    )).alias("n"))
    grouped = each.groupBy("vault_id", "n.name", "n.folded").agg(F.array_sort(F.collect_set("path")).alias("candidates"))
    return grouped.filter(F.size("candidates") > 1)


def resolve_cross_vault(links: DataFrame, mounts: DataFrame) -> DataFrame:
    """``links`` (vault_id, target ``@id/path``) with href and state: same, other, unknown or plain.

    ``mounts`` has (id, prefix); the first prefix of an id counts.
    """
    target = F.col("target")
    parts = r"^@([a-z0-9][a-z0-9-]*)/([^#]+)(#.*)?$"
    ident, path, fragment = (F.regexp_extract(target, parts, i) for i in (1, 2, 3))
    first = mounts.groupBy("id").agg(F.min("prefix").alias("prefix"))
    joined = links.withColumn("id", F.when(target.rlike(parts), ident)).join(first, "id", "left")
    state = F.when(F.col("id").isNull(), "plain").when(F.col("id") == F.col("vault_id"), "same").when(F.col("prefix").isNull(), "unknown").otherwise("other")
    href = F.when(state == "plain", target).when(state == "same", F.concat(path, fragment)).when(state == "other", F.concat(F.regexp_replace("prefix", "/+$", ""), F.lit("/"), path, fragment))
    return joined.withColumn("state", state).withColumn("href", href).select(*links.columns, "state", "href")


def _numbered(rows: DataFrame, *more: Column) -> DataFrame:
    """(r, n, ...): each row as a struct with a number of its own, and ``more`` of it."""
    return rows.select(F.struct(*rows.columns).alias("r"), F.monotonically_increasing_id().alias("n"), *more)


def route_longest_prefix(urls: DataFrame, mounts: DataFrame) -> DataFrame:
    """``urls`` (url) with the id and prefix of the longest mount that ends at a slash of the URL; null where there is none.

    The URL's own prefixes are listed, so that the join is on equality. Rows
    keep a number of their own on the way, so that nulls in other columns and
    repeated rows stay.
    """
    parts = F.filter(F.split("url", "/"), lambda p: p != "")
    own = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    each = _numbered(urls, own.alias("own")).select("r", "n", F.explode_outer("own").alias("own"))
    known = mounts.select("id", F.when(F.col("prefix") == "/", F.col("prefix")).otherwise(F.regexp_replace("prefix", "/+$", "")).alias("prefix"))
    hit = each.join(known, F.col("own") == F.col("prefix"), "left")
    best = hit.groupBy("n").agg(F.any_value("r").alias("r"), F.max_by(F.struct("id", "prefix"), F.when(F.col("prefix").isNotNull(), F.struct(F.length("prefix"), "id"))).alias("m"))
    return best.select(*(F.col(f"r.`{c}`").alias(c) for c in urls.columns), "m.id", "m.prefix")


def resolve_urls(urls: DataFrame, files: DataFrame, tags: DataFrame | None = None, spans: DataFrame | None = None) -> DataFrame:
    """``urls`` (vault_id, url) with tag, outcome serve, redirect or not_found, and the path.

    A page is its path without .md; a directory serves its index or README; a
    directory without the last slash is redirected. A first segment ``@tag``
    asks for the tree at that tag, ``@head`` for ``files``: ``tags`` has
    (vault_id, name, ordinal), and ``spans`` (vault_id, path, start, until),
    the ordinals from which and before which a path is there (see
    ``history.path_spans``); an unknown or invalid tag is not found. Candidates
    meet spans on vault and path, so that no tree of a tag is made.
    """
    asked = F.regexp_extract("url", "^/*@([^/]*)", 1)
    versioned = F.col("url").rlike("^/*@")
    tag = F.when(versioned & valid_tag(asked), asked)
    rest = F.when(versioned, F.regexp_replace("url", "^/*@[^/]*/?", "")).otherwise(F.regexp_replace("url", "^/+", ""))
    bare = F.regexp_replace(rest, "/+$", "")
    slash = rest.endswith("/") | (bare == "")
    inside = lambda name: F.when(bare == "", F.lit(name)).otherwise(F.concat(bare, F.lit(f"/{name}")))
    to_dir = F.when(slash, "serve").otherwise("redirect")
    cand = F.array(*(F.struct(F.lit(o).alias("o"), p.alias("p"), F.lit(w).alias("w") if isinstance(w, str) else w.alias("w")) for o, (p, w) in enumerate(
        [(bare, "serve"), (F.concat(bare, F.lit(".md")), "serve"), (inside("index.md"), to_dir), (inside("README.md"), to_dir)]
    )))
    live = ~versioned | F.coalesce(tag == "head", F.lit(False))
    each = _numbered(urls, F.col("vault_id").alias("v"), tag.alias("tag"), live.alias("live"), cand.alias("c")).select("r", "n", "v", "tag", "live", F.explode_outer("c").alias("c"))
    there = files.select(F.col("vault_id").alias("v"), F.col("path").alias("p"), F.lit(True).alias("there")).distinct()
    met = each.withColumn("p", F.when(F.col("live"), F.col("c.p"))).join(there, ["v", "p"], "left").drop("p")
    if tags is not None and spans is not None:
        named = tags.select(F.col("vault_id").alias("v"), F.col("name").alias("tag"), F.col("ordinal").alias("at"))
        of = spans.select(F.col("vault_id").alias("sv"), F.col("path").alias("sp"), "start", "until")
        met = met.join(named, ["v", "tag"], "left")
        during = (F.col("start") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
        met = met.join(of, ~F.col("live") & (F.col("v") == F.col("sv")) & (F.col("c.p") == F.col("sp")) & during, "left").withColumn("there", F.col("there") | F.col("sp").isNotNull())
    best = met.groupBy("n").agg(F.any_value("r").alias("r"), F.any_value("tag").alias("tag"), F.min_by("c", F.when(F.col("there"), F.col("c.o"))).alias("c"))
    return best.select(*(F.col(f"r.`{c}`").alias(c) for c in urls.columns), "tag", F.coalesce("c.w", F.lit("not_found")).alias("outcome"), F.col("c.p").alias("path"))


def nav_tree(files: DataFrame, prefix: Column | str = "") -> DataFrame:
    """(vault_id, key, depth, is_dir, path, parent, title, url, src_path, children, leaves): the navigation of each vault.

    ``files`` has (vault_id, path, title), the title of a page's frontmatter or
    null. Hidden names are left out. A directory's landing page, index.md or
    else README.md in any case, gives it its URL and, if it has a title of its
    own, that title, and is no node itself; the loser neither. Directories come
    first, each kind by its lower-case title. ``key`` has an entry for each
    level; sorted by vault and key, the rows are the tree in pre-order, by a
    distributed sort. ``leaves`` counts the nodes without children below.
    """
    name, low = basename(F.col("path")), F.lower(basename(F.col("path")))
    page = low.endswith(".md")
    parts = F.split("path", "/")
    up_to = lambda a, n: F.array_join(F.slice(a, F.lit(1), n), "/")
    title = F.when(page, F.coalesce(F.nullif("title", F.lit("")), F.regexp_replace(name, r"\.[^.]*$", ""))).otherwise(name)
    visible = files.filter(~F.exists(parts, lambda x: x.startswith("."))).select(
        "vault_id", "path", up_to(parts, F.size(parts) - 1).alias("parent"), name.alias("name"), low.alias("low"), title.alias("title"), (F.size(parts) - 1).alias("above")
    )
    is_landing = F.col("low").isin("index.md", "readme.md")
    landing = visible.filter(is_landing).groupBy("vault_id", F.col("parent").alias("path")).agg(F.min_by(F.struct("path", "title", "low"), F.struct("low", "path")).alias("l"))
    pages = visible.filter(~is_landing)
    folders = lambda of, depth: F.transform(F.sequence(F.lit(1), depth), lambda n: up_to(F.split(of, "/"), n))
    dirs = visible.filter("above > 0").select("vault_id", F.explode(folders("path", F.col("above"))).alias("path")).distinct().join(landing, ["vault_id", "path"], "left")
    own = (F.col("l.title") != "") & (F.lower("l.title") != F.regexp_replace("l.low", r"\.[^.]*$", ""))
    dirs = dirs.withColumn("title", F.when(own, F.col("l.title")).otherwise(basename(F.col("path")))).withColumn("depth", F.size(F.split("path", "/")))
    entry = lambda kind: F.concat(F.lit(kind), F.lower("title"), F.lit("\x00"), basename(F.col("path")))
    dirs = dirs.withColumn("entry", entry("0"))

    start = prefix if isinstance(prefix, Column) else F.lit(prefix)
    url = lambda stem: F.concat(F.regexp_replace(start, "/+$", ""), F.lit("/"), stem)
    nodes = dirs.select(
        "vault_id", "path", "depth", F.lit(True).alias("is_dir"), "title", F.when(F.col("l").isNotNull(), url(F.col("path"))).alias("url"), F.col("l.path").alias("src_path"), F.lit(None).cast("string").alias("last")
    ).unionByName(
        pages.select(
            "vault_id", "path", (F.col("above") + 1).alias("depth"), F.lit(False).alias("is_dir"), "title",
            url(F.when(F.col("low").endswith(".md"), F.regexp_replace("path", r"\.[^./]*$", "")).otherwise(F.col("path"))).alias("url"), F.col("path").alias("src_path"), entry("1").alias("last"),
        )
    )
    nodes = nodes.withColumn("parent", F.when(F.col("depth") > 1, up_to(F.split("path", "/"), F.col("depth") - 1)).otherwise(F.lit("")))
    # Each node with all directories it lies in, itself among them if it is one.
    within = F.col("depth") - F.when(F.col("is_dir"), 0).otherwise(1)
    chain = nodes.filter(within > 0).select("vault_id", "path", "is_dir", F.explode(folders("path", within)).alias("dir"))
    named = chain.join(dirs.select("vault_id", F.col("path").alias("dir"), "depth", "entry"), ["vault_id", "dir"])
    keys = named.groupBy("vault_id", "path", "is_dir").agg(F.array_sort(F.collect_list(F.struct("depth", "entry"))).alias("k"))
    children = nodes.groupBy("vault_id", F.col("parent").alias("path")).agg(F.count("*").alias("children")).withColumn("is_dir", F.lit(True))
    full = nodes.join(keys, ["vault_id", "path", "is_dir"], "left").join(children, ["vault_id", "path", "is_dir"], "left")
    full = full.withColumn("children", F.coalesce("children", F.lit(0)))
    leaves = full.filter("children = 0").select("vault_id", F.explode(F.filter(folders("path", F.col("depth")), lambda x: x != F.col("path"))).alias("path"))
    leaves = leaves.groupBy("vault_id", "path").agg(F.count("*").alias("leaves")).withColumn("is_dir", F.lit(True))
    key = F.concat(F.coalesce(F.transform("k", lambda x: x["entry"]), F.array().cast("array<string>")), F.array_compact(F.array("last")))
    return full.join(leaves, ["vault_id", "path", "is_dir"], "left").select(
        "vault_id", key.alias("key"), "depth", "is_dir", "path", "parent", "title", "url", "src_path", "children", F.coalesce("leaves", F.lit(0)).alias("leaves")
    )


def sitemap_rows(files: DataFrame, vaults: DataFrame) -> DataFrame:
    """(loc, lastmod): the Markdown pages of public vaults at their URLs in the navigation, and each vault's landing page.

    ``files`` has (vault_id, path, mtime), ``vaults`` (vault_id, prefix,
    public). The landing page is index.md at the root, else README.md, at the
    vault's prefix; those of directories stand for these.
    """
    public = vaults.filter("public").select("vault_id", "prefix")
    title = F.col("title") if "title" in files.columns else F.lit(None).cast("string")
    own = files.select("vault_id", "path", "mtime", title.alias("title")).join(public, "vault_id")
    nodes = nav_tree(own).filter(F.col("src_path").endswith(".md")).select("vault_id", "src_path", "url")
    pages = nodes.join(own.select("vault_id", F.col("path").alias("src_path"), "mtime", "prefix"), ["vault_id", "src_path"])
    root = own.filter(F.col("path").isin("index.md", "README.md")).groupBy("vault_id", "prefix").agg(F.min_by("mtime", F.col("path") != "index.md").alias("mtime"))
    loc = F.concat(F.regexp_replace("prefix", "/+$", ""), "url")
    day = F.date_format("mtime", "yyyy-MM-dd").alias("lastmod")
    return pages.select(loc.alias("loc"), day).unionByName(root.select(F.col("prefix").alias("loc"), day))


def sidecar_presence(files: DataFrame) -> DataFrame:
    """Files that have a ``.conflict.`` or ``.casecollision.`` sibling: the sibling's name tells its owner."""
    pattern = r"^(.*)\.(?:conflict|casecollision)\.[0-9TZ]+(\.[^./]*)?$"
    owners = files.filter(F.col("path").rlike(pattern)).select("vault_id", F.concat(F.regexp_extract("path", pattern, 1), F.regexp_extract("path", pattern, 2)).alias("path"))
    return files.join(owners.distinct(), ["vault_id", "path"], "left_semi")


def disambiguate_ids(servers: DataFrame) -> DataFrame:
    """``servers`` (server, id) with shown: ``server/id`` where an id repeats."""
    n = F.count("*").over(Window.partitionBy("id"))
    return servers.withColumn("shown", F.when(n > 1, F.concat_ws("/", "server", "id")).otherwise(F.col("id")))
