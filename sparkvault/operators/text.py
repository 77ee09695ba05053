"""Texts to tables: words, trigrams, frontmatter, plain text, links, headings, callouts, navigation, cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkvault.functions.frontmatter import frontmatter_paths
from sparkvault.functions.predicates import dispatch_mode


def tokenize(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def tokenize_ascii(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def trigrams(words: Column) -> Column:
    """Distinct grams of words: windows of three over the padded word; a shorter word is one gram, padded in front.

    One scan over the words joined by single spaces: a window with no space in
    its middle lies within one padded word. A window begins at no half of a
    surrogate pair.
    """
    distinct = F.array_distinct(words)
    joined = F.concat(F.lit(" "), F.array_join(F.filter(distinct, lambda w: F.length(w) > 2), " "), F.lit(" "))
    windows = F.regexp_extract_all(joined, F.lit(r"(?=(?![\uDC00-\uDFFF])(.[^ ].))"), F.lit(1))
    short = F.transform(F.filter(distinct, lambda w: F.length(w) < 3), lambda w: F.concat(F.lit(" "), w))
    return F.array_distinct(F.concat(windows, short))


def split_frontmatter(text: Column) -> Column:
    """struct(head, body): the block between a line of dashes at the start and the next line of dashes; an unclosed fence is none."""
    pattern = r"(?s)^-+\r?\n(.*?)(?<=\n)-+\r?\n(.*)$"
    found = text.rlike(pattern)
    head = F.regexp_replace(F.regexp_extract(text, pattern, 1), r"\r?\n$", "")
    return F.struct(F.when(found, head).alias("head"), F.when(found, F.regexp_extract(text, pattern, 2)).otherwise(text).alias("body"))


def extract_frontmatter(text: Column) -> Column:
    """struct(title, aliases, tags, raw): raw has all texts by dotted path; aliases and tags are lists, in whichever form these are written."""
    head = split_frontmatter(text)["head"]
    raw = frontmatter_paths(head)

    def listed(key: str) -> Column:
        items = F.filter(F.map_entries(raw), lambda e: e["key"].rlike(rf"^{key}\.[0-9]+$") & (F.coalesce(e["value"], F.lit("")) != ""))
        placed = F.array_sort(F.transform(items, lambda e: F.struct(F.substring_index(e["key"], ".", -1).cast("int").alias("n"), e["value"].alias("v"))))
        return F.coalesce(F.transform(placed, lambda x: x["v"]), F.array().cast("array<string>"))

    return F.struct(F.try_element_at(raw, F.lit("title")).alias("title"), listed("aliases").alias("aliases"), listed("tags").alias("tags"), raw.alias("raw"))


def strip_markdown(text: Column) -> Column:
    """Without fences, images, wikilinks, links, headings and emphasis, in that order; labels stay."""
    for pattern, to in (
        (r"(?m)^```[^\n]*$", ""), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"!?\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), (r"!?\[\[([^\]]*)\]\]", "$1"),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}[ \t]+", ""), (r"[*_~`]+", ""),
    ):
        text = F.regexp_replace(text, pattern, to)
    return text


def strip_html(html: Column) -> Column:
    """Without script, style, comments and tags; the common entities decoded; white space collapsed."""
    for pattern, to in ((r"(?is)<(script|style)\b[^>]*>.*?</\1>", " "), (r"(?s)<!--.*?-->", " "), (r"<[^>]*>", " ")):
        html = F.regexp_replace(html, pattern, to)
    for entity, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        html = F.replace(html, F.lit(entity), F.lit(to))
    return F.trim(F.regexp_replace(html, r"[ \t\n\r]+", " "))


def extract_text(path: Column, text: Column) -> Column:
    """Plain text by mode; null where there is none."""
    mode = dispatch_mode(path)
    body = split_frontmatter(text)["body"]
    return F.when(mode == "markdown", strip_markdown(body)).when(mode == "text", text).when(mode == "html", strip_html(text))


def strip_comments(text: Column) -> Column:
    """Without ``%%`` comments: blocks of whole lines, then inline ones."""
    return F.regexp_replace(F.regexp_replace(text, r"(?ms)^%%[ \t]*\n.*?^%%[ \t]*(?:\n|\z)", ""), "%%[^\n]*?%%", "")


def extract_links(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, kind, target, fragment, label): wikilinks, embeds and Markdown links in order."""
    token = r"!?\[\[[^\]\n]+\]\]|!?\[[^\]\n]*\]\([^)\s]+\)"
    rows = docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(token), F.lit(0))).alias("pos", "t"))
    wiki = F.col("t").rlike(r"^!?\[\[")
    inner = F.regexp_extract("t", r"\[\[([^\]|]+)", 1)
    dest = F.when(wiki, inner).otherwise(F.regexp_extract("t", r"\]\(([^)\s]+)\)", 1))
    label = F.when(wiki, F.regexp_extract("t", r"\|([^\]]*)\]\]", 1)).otherwise(F.regexp_extract("t", r"^!?\[([^\]]*)\]", 1))
    embed = F.col("t").startswith("!")
    kind = F.when(wiki & embed, "embed").when(wiki & dest.startswith("@"), "cross").when(wiki, "wiki").when(embed, "image").otherwise("link")
    return rows.select(
        key, "pos", kind.alias("kind"), F.regexp_replace(dest, "#.*$", "").alias("target"),
        F.nullif(F.regexp_extract(dest, "#(.*)$", 1), F.lit("")).alias("fragment"), F.nullif(label, F.lit("")).alias("label"),
    )


def extract_hrefs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, href) of all anchors."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))).alias("pos", "href"))


def extract_headings(pages: DataFrame, key: str, html: str, levels: str = "23") -> DataFrame:
    """(key, pos, level, id, text) of the headings of a page in order."""
    token = rf"(?s)<h([{levels}])(?:\s[^>]*)?>.*?</h\1>"
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(token), F.lit(0))).alias("pos", "t"))
    return rows.select(
        key, "pos", F.substring("t", 3, 1).cast("int").alias("level"),
        F.nullif(F.regexp_extract("t", r'^<h\d[^>]*?\sid="([^"]*)"', 1), F.lit("")).alias("id"),
        F.trim(F.regexp_replace("t", "<[^>]*>", "")).alias("text"),
    )


def extract_callouts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, type, foldable, open, title): the title is the type's name where none is given."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "t"))
    pattern = r"^> ?\[!([A-Za-z]+)\]([+-]?)[ \t]*(.*)$"
    kind, sign, title = (F.regexp_extract("t", pattern, i) for i in (1, 2, 3))
    return rows.filter(F.col("t").rlike(pattern)).select(
        key, "line", F.lower(kind).alias("type"), (sign != "").alias("foldable"), (sign != "-").alias("open"),
        F.when(F.trim(title) == "", F.initcap(F.lower(kind))).otherwise(F.trim(title)).alias("title"),
    )


def parse_nav_file(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, depth, title, target, parent, ok): ``"title": "target"`` lines, children after a dash; bad lines are marked."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "t")).filter(F.trim("t") != "").filter(~F.col("t").rlike("^[ \t]*#"))
    pattern = r'^[ \t]*(-?)[ \t]*"([^"]+)"[ \t]*:[ \t]*"([^"]*)"[ \t]*$'
    ok = F.col("t").rlike(pattern)
    depth = F.when(F.regexp_extract("t", pattern, 1) == "-", 1).otherwise(0)
    title = F.regexp_extract("t", pattern, 2)
    out = rows.select(key, "line", F.when(ok, depth).alias("depth"), F.when(ok, title).alias("title"), F.when(ok, F.regexp_extract("t", pattern, 3)).alias("target"), ok.alias("ok"))
    above = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("parent", F.when(F.col("depth") == 1, F.last(F.when(F.col("depth") == 0, F.col("title")), ignorenulls=True).over(above)))


def table_cells(rows: DataFrame, key: str, cells: str) -> DataFrame:
    """(key, row, col, value) of arrays of cells; ``rows`` has key, row and the array."""
    return rows.select(key, "row", F.posexplode(cells).alias("col", "value"))
