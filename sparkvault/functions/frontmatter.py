"""The lines of a frontmatter block as a map of dotted paths, in Arrow batches.

Reads what frontmatter is written in: nested keys and lists by indent, maps in
list items, quoted and plain texts over lines, block texts (``|`` and ``>``),
lists and maps in brackets, anchors, aliases and merged maps. A line that makes
no sense is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

_QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"|' + r"'(?:[^']|'')*'", re.S)
_KEY = re.compile(r"""((?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'\[\]{}#&*!|>%@`,-][^#]*?|-[^\s#][^#]*?))\s*:(?:\s+(.*))?$""", re.S)
_BLOCK = re.compile(r"([|>])([+-]?)([1-9]?)([+-]?)(?:\s+#.*)?$")
#: What escapes in double quotes stand for.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", " ": " "}


class _Open(Exception):
    """Brackets or quotes go on in the next line."""


def _scalar(text: str) -> str | None:
    """A plain or quoted text; null for nothing, ``~`` and ``null``."""
    text = text.strip()
    if text[:1] == '"' and _QUOTED.fullmatch(text):
        full = re.sub(r"\\u([0-9a-fA-F]{4})|\\(.)", lambda m: chr(int(m[1], 16)) if m[1] else _ESCAPES.get(m[2], m[2]), text[1:-1], flags=re.S)
        return full
    if text[:1] == "'" and _QUOTED.fullmatch(text):
        return text[1:-1].replace("''", "'")
    return None if text in ("", "~", "null", "Null", "NULL") else text


class _Machine:
    def __init__(self, head: str):
        self.lines, self.at = head.replace("\r\n", "\n").split("\n"), 0
        self.out: dict[str, str | None] = {}
        self.anchors: dict[str, str] = {}

    def next(self) -> tuple[int, str] | None:
        """The indent and text of the next line that has one; empty lines and comments are passed."""
        while self.at < len(self.lines):
            text = self.lines[self.at].strip()
            if text and not text.startswith("#"):
                return len(self.lines[self.at]) - len(self.lines[self.at].lstrip()), text
            self.at += 1
        return None

    def block(self, indent: int, path: str) -> None:
        """The lines of one indent: a list if the first is an item, else a map."""
        listed, n = self.item(), 0
        while (here := self.next()) and here[0] >= indent:
            text, key = here[1], _KEY.match(here[1])
            if here[0] > indent or self.item() != listed or not (listed or key):
                if listed != self.item() and here[0] == indent:
                    return
                self.at += 1
            elif listed:
                rest = text[1:].lstrip()
                inner, own = here[0] + len(text) - len(rest), f"{path}.{n}".lstrip(".")
                plain = re.sub(r"^[&!]\S*\s+", "", rest)
                if rest and (plain == "-" or plain.startswith("- ") or plain[:1] not in ("[", "{") and _KEY.match(plain)):
                    self.named(rest, own)
                    self.lines[self.at] = " " * inner + plain
                    self.block(inner, own)
                else:
                    self.at += 1
                    self.node(rest, indent, own, False)
                n += 1
            else:
                self.at += 1
                name = _scalar(key[1]) or ""
                self.node(key[2] or "", indent, path if name == "<<" else f"{path}.{name}".lstrip("."), True)

    def item(self) -> bool:
        text = self.next()[1]
        return text == "-" or text.startswith("- ")

    def named(self, rest: str, path: str) -> None:
        if m := re.match(r"&(\S+)", rest):
            self.anchors[m[1]] = path

    def node(self, rest: str, indent: int, path: str, of_map: bool) -> None:
        """What stands behind a key or a dash, or in the lines below it."""
        while m := re.match(r"([&!])(\S*)(?:\s+|$)", rest):
            self.named(rest, path)
            rest = rest[m.end() :]
        if rest.startswith("#"):
            rest = ""
        if rest == "":
            here = self.next()
            if here and (here[0] > indent or of_map and here[0] == indent and self.item()):
                self.block(here[0], path)
            else:
                self.out[path] = None
        elif rest.startswith("*"):
            self.copied(rest[1:].split()[0], path)
        elif m := _BLOCK.match(rest):
            self.out[path] = self.text_block(m[1], m[2] or m[4], int(m[3] or 0), indent)
        elif rest[0] in "[{" or rest[0] in "\"'":
            self.over_lines(rest, path)
        else:
            parts = [re.split(r"\s#", rest)[0].strip()]
            while self.at < len(self.lines) and self.lines[self.at].strip() and len(self.lines[self.at]) - len(self.lines[self.at].lstrip()) > indent:
                more = self.lines[self.at].strip()
                if more.startswith(("#", "- ")) or _KEY.match(more):
                    break
                parts.append(re.split(r"\s#", more)[0].strip())
                self.at += 1
            self.out[path] = _scalar(" ".join(parts))

    def copied(self, name: str, path: str) -> None:
        """An alias has all that its anchor has; what a map has itself stays where one is merged into it."""
        source = self.anchors.get(name)
        if source is not None:
            for k, v in list(self.out.items()):
                if k == source or k.startswith(f"{source}."):
                    to = (path + k[len(source) :]).lstrip(".")
                    self.out.setdefault(to, v)

    def text_block(self, kind: str, chomp: str, given: int, indent: int) -> str:
        rows: list[str] = []
        cut = indent + given if given else None
        while self.at < len(self.lines):
            line = self.lines[self.at]
            own = len(line) - len(line.lstrip())
            if line.strip() and (own <= indent or own < (cut or 0)):
                break
            cut = own if cut is None and line.strip() else cut
            rows.append(line)
            self.at += 1
        rows = [r[cut:] if r.strip() else "" for r in rows]
        kept = len(rows)
        while kept and not rows[kept - 1]:
            kept -= 1
        body = rows[:kept]
        if kind == "|":
            text = "\n".join(body)
        else:
            text, blank = "", 0
            for i, r in enumerate(body):
                if not r:
                    blank += 1
                    continue
                deep = r[:1] == " " or text and prior[:1] == " "
                text += ("\n" * (blank + 1) if deep else "\n" * blank if blank else " ") + r if i and text else "\n" * blank + r
                prior, blank = r, 0
        return text + ("" if chomp == "-" or not body and chomp != "+" else "\n" * (len(rows) - kept + 1) if chomp == "+" else "\n")

    def over_lines(self, text: str, path: str) -> None:
        """Brackets or quotes, with the lines that they go on in."""
        while True:
            before = dict(self.out)
            try:
                self.flow(text, 0, path)
                return
            except _Open:
                self.out = before
                if self.at == len(self.lines):
                    return
                text += " " + self.lines[self.at].strip()
                self.at += 1

    def flow(self, text: str, at: int, path: str) -> int:
        """What stands at a place of a bracketed text; the place behind it."""
        skip = lambda i: i + len(text[i:]) - len(text[i:].lstrip())
        at = skip(at)
        if at >= len(text):
            raise _Open
        if text[at] in "[{":
            closing, n, is_map = "]}"[text[at] == "{"], 0, text[at] == "{"
            at = skip(at + 1)
            while True:
                if at >= len(text):
                    raise _Open
                if text[at] == closing:
                    return skip(at + 1)
                if text[at] == ",":
                    at = skip(at + 1)
                    continue
                name = str(n)
                if is_map:
                    m = _QUOTED.match(text, at) or re.compile(r"[^:,{}\[\]]+").match(text, at)
                    if not m:
                        raise _Open
                    name, at = _scalar(m[0]) or "", skip(m.end())
                    if text[at : at + 1] != ":":
                        self.out[f"{path}.{name}".lstrip(".")] = None
                        continue
                    at += 1
                at, n = skip(self.flow(text, at, f"{path}.{name}".lstrip("."))), n + 1
        if text[at] in "\"'":
            m = _QUOTED.match(text, at)
            if not m:
                raise _Open
            self.out[path] = _scalar(m[0])
            return m.end()
        m = re.compile(r"[^,\[\]{}]*" if path else ".*").match(text, at)
        plain = m[0].strip()
        if plain.startswith("*"):
            self.copied(plain[1:], path)
        else:
            self.out[path] = _scalar(plain)
        return m.end()


def paths(head: str | None) -> dict[str, str | None] | None:
    """The map of dotted path to text of a block; of equal paths the last, null where a key has no value."""
    if head is None:
        return None
    machine = _Machine(head)
    while here := machine.next():
        before = machine.at
        machine.block(here[0], "")
        if machine.at == before:
            machine.at += 1
    return machine.out


@F.pandas_udf(MapType(StringType(), StringType()))
def frontmatter_paths(heads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in heads:
        yield s.map(lambda head: None if head is None or head is pd.NA else paths(head))
