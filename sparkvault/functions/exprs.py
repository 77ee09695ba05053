"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REVIEW_PREFIX = "reviewed-"


# What conflict blocks and callouts begin and end with; other programs look for them.
OURS, BETWEEN, THEIRS = "<<<<<<< ", "=======\n", ">>>>>>> "
QUOTE, CALLOUT, CONFLICT_HEAD = "> ", "> [!", "> [!conflict] "


def content_hash(content: Column) -> Column:
    """Hex SHA-256."""
    return F.sha2(content, 256)


def parse_hash_hex(text: Column) -> Column:
    """The hash if ``text`` is 64 hex digits, in lower case, else null."""
    return F.when(text.rlike("^[0-9A-Fa-f]{64}$"), F.lower(text))


def token_hash(token: Column) -> Column:
    """The first 24 hex digits of SHA-256."""
    return F.substring(F.sha2(token, 256), 1, 24)


def format_review_tag(ts: Column) -> Column:
    return F.concat(F.lit(REVIEW_PREFIX), F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss"), F.lit("Z"))


def parse_review_tag(name: Column) -> Column:
    """The time of a review tag, else null."""
    body = F.regexp_extract(name, rf"^{REVIEW_PREFIX}(\d{{4}}-\d\d-\d\dT\d\d-\d\d-\d\dZ)$", 1)
    return F.try_to_timestamp(F.nullif(body, F.lit("")), F.lit("yyyy-MM-dd'T'HH-mm-ss'Z'"))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by dotted numbers; a leading v is dropped, what is not a number counts as 0."""
    parts = lambda v: F.transform(
        F.split(F.regexp_replace(v, "^v", ""), r"\."), lambda p: F.coalesce(F.when(p.rlike("^[0-9]{1,9}$"), p.cast("int")), F.lit(0))
    )
    padded = lambda v, n: F.slice(F.concat(parts(v), F.array_repeat(F.lit(0), n)), F.lit(1), n)
    n = F.greatest(F.size(F.split(a, r"\.")), F.size(F.split(b, r"\.")))
    return F.when(padded(a, n) < padded(b, n), -1).when(padded(a, n) > padded(b, n), 1).otherwise(0)


def parse_size(text: Column) -> Column:
    """Bytes of ``10mb``, ``5 KB``, ``1gb`` or plain numbers; null if malformed."""
    m = F.lower(F.trim(text))
    number = F.regexp_extract(m, r"^([0-9]+)\s*(b|kb|mb|gb)?$", 1)
    unit = F.regexp_extract(m, r"^([0-9]+)\s*(b|kb|mb|gb)?$", 2)
    factor = F.when(unit == "kb", 1 << 10).when(unit == "mb", 1 << 20).when(unit == "gb", 1 << 30).otherwise(1).cast("long")
    return F.when(number != "", number.cast("long") * factor)


_SECONDS = {"w": 604_800.0, "d": 86_400.0, "h": 3_600.0, "m": 60.0, "s": 1.0, "ms": 1e-3}


def parse_duration(text: Column) -> Column:
    """Seconds (double) of ``1h30m``, ``2w``, ``3d`` or ``250ms``; null if malformed."""
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)(ms|[wdhms])"), F.lit(0))
    amount = lambda p: F.regexp_extract(p, r"^[0-9.]+", 0).cast("double")
    unit = lambda p: F.regexp_extract(p, r"[a-z]+$", 0)
    factor = lambda p: F.try_element_at(F.create_map(*(F.lit(x) for kv in _SECONDS.items() for x in kv)), unit(p))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + amount(p) * factor(p))
    return F.when(text.rlike(r"^(?:[0-9]+(?:\.[0-9]+)?(?:ms|[wdhms]))+$"), total)


def humanize_ago(seconds: Column) -> Column:
    """``5s ago`` to ``3d ago``; an em dash for null or future."""
    unit = lambda n, u: F.concat(F.floor(seconds / n).cast("string"), F.lit(f"{u} ago"))
    return (
        F.when(seconds.isNull() | (seconds < 0), F.lit("—"))
        .when(seconds < 60, unit(1, "s")).when(seconds < 3600, unit(60, "m")).when(seconds < 86_400, unit(3600, "h")).otherwise(unit(86_400, "d"))
    )


def parse_vault_address(address: Column) -> Column:
    """struct(host, vault_id): the scheme, query, fragment and last slash are dropped; null parts if absent."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(address), "^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), "[?#].*$", ""), "/+$", "")
    return F.struct(
        F.nullif(F.lower(F.split_part(bare, F.lit("/"), F.lit(1))), F.lit("")).alias("host"),
        F.nullif(F.element_at(F.split(F.concat(F.lit("/"), F.regexp_replace(bare, "^[^/]*/?", "")), "/"), -1), F.lit("")).alias("vault_id"),
    )


def escape_segment(segment: Column) -> Column:
    """Percent-encoding of one path segment; the space is %20, the tilde stays."""
    return F.replace(F.replace(F.replace(F.url_encode(segment), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def escape_segments(path: Column) -> Column:
    return F.array_join(F.transform(F.split(path, "/"), escape_segment), "/")


def page_url(prefix: Column, path: Column) -> Column:
    """The prefix and the escaped path without its Markdown extension; an index page is its directory."""
    stem = F.regexp_replace(path, r"\.md$", "")
    collapsed = F.regexp_replace(stem, r"(^|/)(?:index|README)$", "$1")
    return F.concat(F.regexp_replace(prefix, "/+$", ""), F.lit("/"), escape_segments(collapsed))


def asset_url(prefix: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(prefix, "/+$", ""), F.lit("/"), escape_segments(path))


def rewrite_link(dest: Column, prefix: Column) -> Column:
    """Relative destinations get the prefix; absolute ones, fragments and those with a scheme stay."""
    stays = (dest == "") | dest.rlike(r"^(?:/|#|\?|[A-Za-z][A-Za-z0-9+.-]*:)")
    return F.when(stays, dest).otherwise(F.concat(prefix, F.regexp_replace(dest, r"^\./", "")))


def set_query_param(url: Column, name: str, value: Column) -> Column:
    """``url`` with one query parameter set or replaced; the fragment stays last."""
    base = F.regexp_replace(url, r"[?#].*$", "")
    fragment = F.regexp_extract(url, r"#.*$", 0)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    others = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^{name}(?:=|$)"))
    return F.concat(base, F.lit("?"), F.array_join(F.concat(others, F.array(F.concat(F.lit(f"{name}="), value))), "&"), fragment)


def versioned_url(prefix: Column, tag: Column, path: Column) -> Column:
    """``prefix/@tag/path``."""
    return F.concat(F.regexp_replace(prefix, "/+$", ""), F.lit("/@"), tag, F.lit("/"), F.regexp_replace(path, "^/+", ""))


def parse_versioned_url(path: Column) -> Column:
    """struct(tag, rest): the first segment if it is ``@tag`` with a valid tag, else null and the path."""
    tag = F.regexp_extract(path, r"^/?@([A-Za-z0-9][A-Za-z0-9._-]{0,127})(?:/|$)", 1)
    found = tag != ""
    rest = F.regexp_replace(path, r"^/?@[^/]*/?", "")
    return F.struct(F.when(found, tag).alias("tag"), F.when(found, rest).otherwise(F.regexp_replace(path, "^/+", "")).alias("rest"))


def normalize_nav_url(url: Column) -> Column:
    """Without a last slash and a last ``/index``."""
    return F.regexp_replace(F.regexp_replace(url, "/+$", ""), "/index$", "")


def case_fold(text: Column) -> Column:
    """Lower case; the caller folds what is not ASCII where it matters."""
    return F.lower(text)


def _stem_and_ext(path: Column) -> tuple[Column, Column]:
    ext = F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)
    return F.substring(path, F.lit(1), F.length(path) - F.length(ext)), ext


def sidecar_path(path: Column, ts: Column) -> Column:
    """``stem.conflict.20260515T142311Z.ext`` from a path and an ISO time text."""
    stem, ext = _stem_and_ext(path)
    return F.concat(stem, F.lit(".conflict."), F.regexp_replace(ts, "[:-]", ""), ext)


def case_collision_path(path: Column, ts: Column) -> Column:
    stem, ext = _stem_and_ext(path)
    return F.concat(stem, F.lit(".casecollision."), F.regexp_replace(ts, "[:-]", ""), ext)


def git_marker_text(ours: Column, theirs: Column, our_name: Column, their_name: Column) -> Column:
    """Both sides between conflict markers, each ended by a line end."""
    ended = lambda c: F.when((c == "") | c.endswith("\n"), c).otherwise(F.concat(c, F.lit("\n")))
    return F.concat(F.lit(OURS), our_name, F.lit("\n"), ended(ours), F.lit(BETWEEN), ended(theirs), F.lit(THEIRS), their_name, F.lit("\n"))


def comment_block_text(header: Column, text: Column, opening: Column, closing: Column) -> Column:
    """Header and text as a comment: every line prefixed, or one block whose close delimiter is broken up inside."""
    lines = F.concat(F.array(header), F.split(F.regexp_replace(text, "\n$", ""), "\n"))
    line_form = F.array_join(F.transform(lines, lambda x: F.when(x == "", opening).otherwise(F.concat(opening, F.lit(" "), x))), "\n")
    safe = F.replace(text, closing, F.concat(F.substring(closing, 1, 1), F.lit(" "), F.substring(closing, F.lit(2), F.length(closing))))
    block_form = F.concat(opening, F.lit(" "), header, F.lit("\n"), F.regexp_replace(safe, "\n$", ""), F.lit("\n"), closing)
    return F.concat(F.when(F.coalesce(closing, F.lit("")) == "", line_form).otherwise(block_form), F.lit("\n"))


def backtick_fence(text: Column) -> Column:
    """A fence one longer than the longest run of backticks, three at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def callout_text(kind: Column, title: Column, text: Column) -> Column:
    """A quoted callout that holds the text in a fence."""
    fence = backtick_fence(text)
    lines = F.concat(F.array(fence), F.split(F.regexp_replace(text, "\n$", ""), "\n"), F.array(fence))
    quoted = F.transform(lines, lambda x: F.when(x == "", F.lit(">")).otherwise(F.concat(F.lit(QUOTE), x)))
    return F.concat(F.lit(CALLOUT), kind, F.lit("] "), title, F.lit("\n"), F.array_join(quoted, "\n"), F.lit("\n"))


def delete_vs_edit_text(fmt: Column, header: Column, text: Column) -> Column:
    """A header above the surviving text, by format: callout, comment, or marker."""
    head = (
        F.when(fmt == "callout", F.concat(F.lit(CONFLICT_HEAD), header, F.lit("\n\n")))
        .when(fmt == "comment", F.concat(F.lit("# "), header, F.lit("\n")))
        .otherwise(F.concat(F.lit(OURS), header, F.lit("\n")))
    )
    return F.concat(head, text)


def parse_embed_label(label: Column) -> Column:
    """struct(width, height, variant, alt) of a ``|``-separated label; the first of each kind wins."""
    parts = F.transform(F.split(label, r"\|"), lambda p: F.trim(p))
    size = F.get(F.filter(parts, lambda p: p.rlike(r"^[0-9]{1,5}(?:x[0-9]{1,5})?$")), 0)
    variant = F.get(F.filter(parts, lambda p: p.isin("light", "dark")), 0)
    alt = F.get(F.filter(parts, lambda p: (p != "") & ~p.rlike(r"^[0-9]{1,5}(?:x[0-9]{1,5})?$") & ~p.isin("light", "dark")), 0)
    number = lambda group: F.nullif(F.regexp_extract(size, r"^([0-9]+)(?:x([0-9]+))?$", group), F.lit("")).cast("int")
    return F.struct(number(1).alias("width"), number(2).alias("height"), variant.alias("variant"), alt.alias("alt"))


def excerpt(text: Column, limit: int = 160) -> Column:
    """White space collapsed, cut at the last space within ``limit`` characters, with an ellipsis if cut."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(flat, 1, limit)
    cut = F.regexp_replace(head, r" [^ ]*$", "")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(cut, F.lit("…")))


def primary_path(kind: Column, path: Column, source: Column) -> Column:
    """The path an op takes from: ``from`` of a rename, else ``path``."""
    return F.when(kind == "rename", source).otherwise(path)


def target_path(kind: Column, path: Column, to: Column) -> Column:
    """The path an op ends at: ``to`` of a rename, else ``path``."""
    return F.when(kind == "rename", to).otherwise(path)
