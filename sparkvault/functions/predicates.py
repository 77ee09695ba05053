"""Predicates and classifications as column functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Hidden first component that holds a tree's own settings.
CONTROL = ".vault"
#: Files of the control tree that everyone may read, and those that configure the tree.
PUBLIC_CONTROL = ("README.md",)
CONFIG_CONTROL = ("access", "roles", "config")

# Device names that a path component must not have as its stem.
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]

# Extensions by how a page is shown, and media types.
MODES = {
    "markdown": ["md", "markdown"], "typst": ["typ"], "tabular": ["csv", "tsv", "psv"], "html": ["html", "htm"],
    "asset": ["png", "jpg", "jpeg", "gif", "svg", "webp", "pdf", "mp3", "mp4"], "text": ["txt", "json", "yaml", "yml", "toml", "log"],
}
MEDIA_TYPES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp",
    "pdf": "application/pdf", "mp3": "audio/mpeg", "mp4": "video/mp4", "html": "text/html; charset=utf-8", "css": "text/css; charset=utf-8",
    "txt": "text/plain; charset=utf-8", "md": "text/markdown; charset=utf-8", "json": "application/json",
}
# Comment delimiters by extension.
COMMENTS = {
    **dict.fromkeys(["py", "rb", "sh", "pl", "r", "yaml", "yml", "toml", "ini", "conf"], ("#", "")),
    **dict.fromkeys(["js", "ts", "jsx", "tsx", "go", "rs", "java", "kt", "swift", "c", "h", "cc", "cpp", "cs", "scala", "php"], ("//", "")),
    **dict.fromkeys(["sql", "lua", "hs"], ("--", "")),
    **dict.fromkeys(["css", "scss", "less"], ("/*", "*/")),
    **dict.fromkeys(["html", "htm", "xml", "svg", "vue"], ("<!--", "-->")),
    **dict.fromkeys(["tex"], ("%", "")),
}

#: Characters of a component's begin or end by which an ignore pattern is looked up.
KEY_LENGTH = 64


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def invalid_op(kind: Column, seq: Column, ts: Column, path: Column, source: Column, to: Column, data: Column, binary: Column, pre_hash: Column) -> Column:
    """Why an op breaks the rules of its type, or null."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    loaded = data.isNotNull() | F.coalesce(binary, F.lit(False))
    ends = ~blank(source) | ~blank(to)
    rules = {
        "write": [("no_path", blank(path)), ("no_data", data.isNull()), ("has_ends", ends)],
        "delete": [("no_path", blank(path)), ("no_pre_hash", pre_hash.isNull()), ("has_data", loaded), ("has_ends", ends)],
        "rename": [("no_ends", blank(source) | blank(to)), ("no_pre_hash", pre_hash.isNull()), ("has_path", ~blank(path)), ("has_data", loaded)],
    }
    broken = [F.when((kind == k) & test, code) for k, tests in rules.items() for code, test in tests]
    numbered = [F.when(F.coalesce(c, F.lit(0)) <= 0, code) for code, c in (("bad_seq", seq), ("bad_ts", ts))]
    return F.coalesce(*numbered, *broken, F.when(~F.coalesce(kind.isin(*rules), F.lit(False)), "bad_type"))


@F.pandas_udf(BooleanType())
def _is_nfc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import unicodedata

    for s in parts:
        yield s.map(lambda x: x is None or unicodedata.is_normalized("NFC", x)).astype("boolean")


def invalid_path(path: Column, control: str = CONTROL, check_nfc: bool = True) -> Column:
    """The code of the first rule that a path breaks, or null. Only paths outside ASCII are asked for their normal form."""
    parts = F.split(path, "/")
    some = lambda test: F.exists(parts, test)
    hidden = F.exists(F.transform(parts, lambda p, i: p.startswith(".") & ~((i == 0) & (p == control))), lambda x: x)
    stem = lambda p: F.upper(F.substring_index(p, ".", 1))
    nfc = F.when(path.rlike(r"[^\x00-\x7F]"), _is_nfc(path)).otherwise(True) if check_nfc else F.lit(True)
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "empty")
        .when(~nfc, "not_normal")
        .when(F.instr(path, "\0") > 0, "nul")
        .when(F.contains(path, F.lit("\\")), "backslash")
        .when(path.startswith("/"), "absolute")
        .when(F.octet_length(path) > 4096, "length")
        .when(some(lambda p: (p == "") | (p == ".")) | (some(lambda p: p == "..") & ~path.rlike(r"^(?:\.\./)*\.\.(?:/|$)")), "unclean")
        .when(some(lambda p: p == ".."), "parent")
        .when(some(lambda p: F.octet_length(p) > 255), "component_length")
        .when(some(lambda p: p.endswith(".")), "ends_in_dot")
        .when(some(lambda p: p.endswith(" ")), "ends_in_space")
        .when(hidden, "hidden")
        .when(some(lambda p: stem(p).isin(RESERVED)), "reserved")
    )


def valid_vault_id(vault_id: Column) -> Column:
    return F.coalesce(vault_id.rlike("^[a-z0-9][a-z0-9-]*$") & (F.length(vault_id) <= 64), F.lit(False))


def is_hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.startswith("."))


def is_control(path: Column, control: str = CONTROL) -> Column:
    return (path == control) | path.startswith(f"{control}/")


def path_class(path: Column, control: str = CONTROL) -> Column:
    """public_control, config, control, hidden or plain."""
    rest = F.substring(path, len(control) + 2, 1 << 20)
    return (
        F.when(is_control(path, control) & rest.isin(*PUBLIC_CONTROL), "public_control")
        .when(is_control(path, control) & rest.isin(*CONFIG_CONTROL), "config")
        .when(is_control(path, control), "control")
        .when(is_hidden(path), "hidden")
        .otherwise("plain")
    )


def globs_regex(globs: list[str]) -> str:
    """One anchored expression for globs on a basename: ``*`` any, ``?`` one, ``[..]`` a set."""
    def one(glob: str) -> str:
        out = re.escape(glob).replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        return re.sub(r"\\\[(.*?)\\\]", lambda m: "[" + m[1].replace("\\", "") + "]", out)
    return "^(?:" + "|".join(map(one, globs)) + ")$" if globs else r"^\b$"


def allowlist_reason(path: Column, size: Column, globs: list[str], limit: int) -> Column:
    """``type`` or ``size`` if a file is refused, else null."""
    return F.when(~basename(path).rlike(globs_regex(globs)), "type").when(size > limit, "size")


def control_reason(path: Column, size: Column, globs: list[str], limit: int, control: str = CONTROL) -> Column:
    """As :func:`allowlist_reason`; control paths skip the type but not the size."""
    return F.when(is_control(path, control), F.when(size > limit, "size")).otherwise(allowlist_reason(path, size, globs, limit))


def _component(glob: str) -> str | None:
    """The expression of a pattern for one component: ``*``, ``?``, ``[a-z]``, ``[^a]`` and ``\\`` before what is meant as such; None if malformed."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            if i == len(glob):
                return None
            out, i = out + re.escape(glob[i]), i + 1
        elif c == "[":
            opened = i
            i += glob.startswith("^", i)
            chosen, first = "", i
            while True:
                ends = []
                if i < len(glob) and glob[i] == "]" and i > first:
                    break
                for _ in range(2):  # a character, or the two ends of a range
                    if i < len(glob) and glob[i] == "\\":
                        i += 1
                    if i >= len(glob) or glob[i] in "-]" and glob[i - 1] != "\\":
                        return None
                    ends.append(glob[i])
                    i += 1
                    if not glob.startswith("-", i):
                        break
                    if len(ends) == 1:
                        i += 1
                if ends[0] > ends[-1]:
                    return None
                chosen += "-".join(re.escape(e) if e in "\\]^-[&" else e for e in ends)
            out, i = out + "[" + ("^" if glob[opened] == "^" else "") + chosen + ("/" if glob[opened] == "^" else "") + "]", i + 1
        else:
            out += re.escape(c)
    return out


def _body(pattern: str) -> tuple[str, bool]:
    """A pattern without its negation, last spaces and last slash, and whether it had that slash."""
    body = pattern.removeprefix("!")
    body = body if body.endswith("\\ ") else body.rstrip(" ")
    return body.removesuffix("/"), body.endswith("/")


def ignore_regex(pattern: str) -> tuple[str | None, bool]:
    """(expression, negated) of one ignore pattern; no expression if it can match nothing.

    ``!`` negates, a last slash asks for something below. Without another slash
    a pattern is for a component at any depth, else for the components from
    the top, with all that lies below; ``**`` stands for any number of
    components, up to the first that fits what follows it.
    """
    negated, (body, tree) = pattern.startswith("!"), _body(pattern)
    end = "/.+$" if tree else "(?:/.*)?$"
    if "/" not in body:
        own = _component(body)
        return (None if own is None else f"^(?:.*/)?{own}{end}"), negated
    out, skips, begun = "^", False, False
    parts = body.split("/")
    for i, part in enumerate(parts):
        if part == "":
            skips = False
        elif part == "**":
            if i == len(parts) - 1:
                break
            skips = True
        else:
            own = None if "**" in part else _component(part)
            if own is None:
                return None, negated
            out += "/" if begun else ""
            out += f"(?:(?!{own}(?:/|$))[^/]+/)*+" if skips else ""
            out, skips, begun = out + own, False, True
    return (out + end if begun else None), negated


def ignore_keys(pattern: str) -> list[str]:
    """What a path must have for the pattern to match, all of it: components ``=name``, and components that begin (``^pre``) or end (``$post``) so."""
    keys = []
    for part in _body(pattern)[0].split("/"):
        if part in ("", "**"):
            continue
        if not set(part) & set("*?[\\"):
            keys.append(f"={part}")
            continue
        head, *_, tail = re.split(r"[*?\[\]\\]", part)
        keys += [f"^{head[:KEY_LENGTH]}"] if head else []
        keys += [f"${tail[-KEY_LENGTH:]}"] if tail else []
    return keys


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches ``path`` is not a negation."""
    out = F.lit(False)
    for expression, negated in map(ignore_regex, patterns):
        if expression is None:
            continue
        out = F.when(path.rlike(expression), F.lit(not negated)).otherwise(out)
    return out


def excluded(path: Column, patterns: list[str], control: str = CONTROL) -> Column:
    """Refused for a sync: the control tree but its public part, hidden components, then the ignore patterns."""
    kind = path_class(path, control)
    return F.when(kind == "public_control", False).when(kind != "plain", True).otherwise(ignored(path, patterns))


def dispatch_mode(path: Column, more_text: list[str] | None = None) -> Column:
    table = {e: mode for mode, group in MODES.items() for e in group}
    return F.coalesce(lookup({e: "text" for e in more_text or []} | table, extension(path)), F.lit("asset"))


def content_type(path: Column) -> Column:
    return F.coalesce(lookup(MEDIA_TYPES, extension(path)), F.lit("application/octet-stream"))


def is_text(content: Column) -> Column:
    return F.is_valid_utf8(content)


def looks_binary(content: Column) -> Column:
    """A NUL among the first 8192 bytes."""
    return F.contains(F.substring(content, 1, 8192), F.lit(b"\0"))


def has_conflict_marker(text: Column) -> Column:
    """A callout, comment or merge marker that is not resolved."""
    return text.rlike(r"(?m)^> \[!conflict\]|^(?:#|//|--|/\*|<!--|%) conflict:|^<{7} |^>{7} ")


def conflict_format(path: Column, diff_mode: str = "inline") -> Column:
    """callout for Markdown, comment or sidecar by extension, marker for other text; sidecar throughout if asked."""
    if diff_mode == "sidecar":
        return F.lit("sidecar")
    mode = dispatch_mode(path)
    return (
        F.when(mode == "markdown", "callout")
        .when(lookup({e: "y" for e in COMMENTS}, extension(path)).isNotNull(), "comment")
        .when((mode == "asset") & (extension(path) != ""), "sidecar")
        .otherwise("marker")
    )


def valid_tag(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$") & ~F.contains(name, F.lit("..")), F.lit(False))


def valid_token(token: Column) -> Column:
    return F.coalesce(token.rlike(r"^[A-Za-z0-9_-]{16,256}$"), F.lit(False))


def valid_request_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[A-Za-z0-9._-]{1,64}$"), F.lit(False))


def long_enough(query: Column, n: int = 2) -> Column:
    return F.coalesce(F.length(F.trim(query)) >= n, F.lit(False))
