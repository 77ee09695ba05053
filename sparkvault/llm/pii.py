"""Personal data replaced by surrogates (operator 8).

Detected entities (addresses, numbers, secrets, titled names) are listed
once each over all documents. Every distinct entity draws a surrogate from a
keyed hash: of its type, gender, script and form. Draws that collide, with
another entity's surrogate or with an entity that occurs itself, are drawn
again, until all surrogates are distinct. The same entity has the same
surrogate everywhere, in the form in which each mention is written.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import string
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkvault.llm._common import materialize, trimmed, unused

# Titles by gender, and given and family names by gender and script.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Señora", "Sra", "Signora", "Госпожа", "Κυρία"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Κύριος"],
    "n": ["Dr", "Prof", "Mx"],
}
NAMES = {
    ("f", "LATIN"): ["Anna", "Maria", "Clara", "Julia", "Laura", "Elena", "Sofia", "Nora", "Irene", "Helena", "Emma", "Alice"],
    ("m", "LATIN"): ["Paul", "Martin", "Daniel", "Simon", "Oscar", "Victor", "Hugo", "Leon", "Felix", "Robert", "Adam", "Thomas"],
    ("n", "LATIN"): ["Robin", "Alex", "Kim", "Sascha", "Noa", "Jules", "Charlie", "Andrea", "Dominique", "Sam", "Kay", "Toni"],
    ("f", "CYRILLIC"): ["Анна", "Мария", "Елена", "Ольга", "Ирина", "Вера"],
    ("m", "CYRILLIC"): ["Павел", "Иван", "Андрей", "Сергей", "Олег", "Борис"],
    ("n", "CYRILLIC"): ["Саша", "Женя", "Валя", "Шура"],
    ("f", "GREEK"): ["Μαρία", "Ελένη", "Άννα", "Σοφία"],
    ("m", "GREEK"): ["Νίκος", "Γιώργος", "Πέτρος", "Παύλος"],
    ("n", "GREEK"): ["Αλέξης", "Στάθης"],
}
# What family names are put together from, by script.
STEMS = {
    "LATIN": ["Berg", "Stein", "Lind", "Hart", "Ros", "Wald", "Feld", "Dal", "Mor", "Cast", "Nav", "Bran", "Hol", "Win", "Kel", "Fal", "Gar", "Mal", "Sand", "Thorn"],
    "CYRILLIC": ["Шевч", "Ковал", "Бондар", "Марч", "Литвин", "Гончар", "Ткач", "Мельнич"],
    "GREEK": ["Παπαδ", "Βλαχ", "Κοντ", "Μαυρ", "Οικονομ", "Νικολ"],
}
ENDS = {"LATIN": ["er", "ow", "ard", "ini", "eau", "ells", "inger", "ano", "ley", "ström", "ova", "ley", "ius"], "CYRILLIC": ["енко", "ук", "як", "ыш"], "GREEK": ["άκης", "ίδης", "όπουλος", "έας"]}
FAMILY = {script: sorted({a + b for a in stems for b in ENDS[script]}) for script, stems in STEMS.items()}
#: Words after which a name follows as after a title, but of no gender.
INTRODUCTIONS = ["name is", "Name ist", "heiße", "m'appelle", "llamo", "nombre es", "зовут"]

_ALL_TITLES = sorted((t for group in TITLES.values() for t in group), key=lambda t: (-len(t), t))
_GENDER = {t: g for g, group in TITLES.items() for t in group}
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: What is looked for, in order of precedence. Group 1, where there is one, is the part that is replaced.
PATTERNS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}",
    "secret": r"(?ai:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?)(?![*•●xX.#_-]*[\"',;]*(?:\s|$))(\S{5,}[^\s\"',;])",
    "ipv6": r"(?<![\w:.])(?=[0-9A-Fa-f:]{0,39}[0-9])(?:[0-9A-Fa-f]{3,4}(?::[0-9A-Fa-f]{1,4}){7}|[0-9A-Fa-f]{3,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:])",
    "aws_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ipv4": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9-])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?:[0-9]{3})?(?![0-9-])|(?<![0-9-])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
    r"|(?<![\w.+-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-])",
    "hex": r"\b(?=[0-9a-f]{0,63}[0-9])(?=[0-9a-f]{0,63}[a-f])[0-9a-f]{32,64}\b",
    "name": r"\b(?:(?:" + "|".join(_ALL_TITLES) + r")\.?|" + "|".join(INTRODUCTIONS) + r")[ \u00a0](\p{Lu}[\p{Ll}\p{M}'-]{1,30}(?:[ \u00a0]\p{Lu}[\p{Ll}\p{M}'-]{1,30}){0,2})",
}
#: A text without any of these has no entity; class by class, so that few positions try the longer parts.
CANDIDATE = (
    r"[0-9@]|(?=[" + "".join(sorted({t[0] for t in [*_ALL_TITLES, *INTRODUCTIONS]})) + r"])(?:(?:" + "|".join(_ALL_TITLES) + r")\.?|" + "|".join(INTRODUCTIONS) + r")[ \u00a0]|A[KS]IA[A-Z0-9]"
    r"|[pP](?:[aA][sS][sS][wW]|[wW][dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[kK][eE][yY]"
)

ENTITY = "array<struct<start:int,end:int,kind:string,norm:string>>"


@lru_cache(maxsize=1)
def _scanners() -> list[tuple[str, Callable[[str], bool], regex.Pattern | re.Pattern]]:
    """For every kind: its name, a quick test of the texts that can have one, its pattern."""
    number, title = re.compile("[0-9]").search, regex.compile("(?:(?:" + "|".join(_ALL_TITLES) + r")\.?|" + "|".join(INTRODUCTIONS) + r")[ \u00a0]").search
    word = re.compile("passw|pwd|secret|token|key").search
    tests = {"email": lambda t: "@" in t, "secret": lambda t: word(t.lower()), "name": lambda t: any(x in t for x in (*_ALL_TITLES, *INTRODUCTIONS)) and title(t)}
    tests |= {"aws_key": lambda t: "AKIA" in t or "ASIA" in t, "ipv6": lambda t: "::" in t or t.count(":") > 6}
    return [(kind, tests.get(kind, number), (regex if kind == "name" else re).compile(pattern)) for kind, pattern in PATTERNS.items()]


def _matches(text: str) -> Iterator[tuple[str, regex.Match | re.Match]]:
    """(kind, match) in order and apart: always the next one by its start, and of equal starts the first by kind."""
    ahead = []
    for place, (kind, may, pattern) in enumerate(_scanners()):
        if may(text) and (m := pattern.search(text)):
            ahead.append((m.start(), place, kind, pattern, m))
    while ahead:
        _, _, kind, _, m = first = min(ahead, key=lambda x: x[:2])
        yield kind, m
        left = [x for x in ahead if x is not first and x[0] >= m.end()]
        for _, place, kind, pattern, _ in (x for x in ahead if x is first or x[0] < m.end()):
            if later := pattern.search(text, m.end()):
                left.append((later.start(), place, kind, pattern, later))
        ahead = left


def _address(surface: str) -> str:
    """An IPv6 address in full; what only looks like one in lower case."""
    try:
        return ipaddress.ip_address(surface).exploded
    except ValueError:
        return surface.lower()


def _script(name: str) -> str:
    first = unicodedata.name(name[0], "LATIN").split()[0]
    return first if first in FAMILY else "LATIN"


def _part(words: list[str], name: list[str]) -> int:
    """Where ``words`` stand in ``name``, one after the other; -1 if nowhere."""
    return next((i for i in range(len(name) - len(words) + 1) if name[i : i + len(words)] == words), -1)


def _persons(text: str, found: list[dict]) -> list[dict]:
    """``found`` with the names of one text tied together.

    A name has one gender, that of its first title that tells one. A shorter
    mention goes with the only longer name it is a part of. Full names without
    a title, outside the other entities, are added.
    """
    named = [e for e in found if e["kind"].startswith("name_")]
    if not named:
        return found
    names = {e["norm"]: e["norm"].split(" ") for e in named}
    whole, having = {}, {}
    for n, words in names.items():
        for word in set(words):
            having.setdefault(word, []).append(n)
    for n, words in names.items():
        longer = [m for m in having[words[0]] if len(names[m]) > len(words) and _part(words, names[m]) >= 0]
        longest = [m for m in longer if all(_part(names[o], names[m]) >= 0 for o in longer)]
        whole[n] = longest[0] if longest else n
    kinds = {}
    for e in named:
        e["norm"] = whole[e["norm"]]
        if kinds.get(e["norm"], "name_n") == "name_n":
            kinds[e["norm"]] = e["kind"]
    for e in named:
        e["kind"] = kinds[e["norm"]]
    full = sorted((n for n in kinds if " " in n), key=lambda n: (-len(n), n))
    if not full:
        return found
    untitled = regex.compile(r"(?<![\w'-])(?:" + "|".join(r"[ \u00a0]".join(map(regex.escape, n.split(" "))) for n in full) + r")(?!\w)")
    out, end = [], 0
    for e in [*found, None]:
        for m in untitled.finditer(text, end, e["start"] if e else len(text)):
            norm = m.group().replace("\u00a0", " ")
            out.append({"start": m.start(), "end": m.end(), "kind": kinds[norm], "norm": norm})
        if e:
            out.append(e)
            end = e["end"]
    return out


def find(text: str | None) -> list[dict]:
    """The entities of a text, in order and apart: start, end (characters), kind, norm.

    The norm is what the mentions of one entity share: digits of numbers,
    lower case of addresses, the full name of persons. Secrets that are masked
    already are none.
    """
    found = []
    for kind, m in _matches(text or ""):
        start, end = m.span(1) if kind in ("secret", "name") else m.span()
        surface = text[start:end]
        if kind in ("phone", "card", "ssn"):
            norm = "".join(c for c in surface if c.isdigit())
        elif kind == "email":
            norm = surface.lower()
        elif kind == "iban":
            norm = surface.replace(" ", "")
        elif kind == "ipv6":
            norm = _address(surface)
        elif kind == "name":
            title = text[m.start() : start].rstrip(" \u00a0").rstrip(".")
            kind, norm = f"name_{_GENDER.get(title, 'n')}", " ".join(surface.replace("\u00a0", " ").split(" "))
        else:
            norm = surface
        found.append({"start": start, "end": end, "kind": kind, "norm": norm})
    return _persons(text, found) if found else found


#: What letters beyond ASCII are drawn from, by script; others by Latin letters.
LETTERS = {"CYRILLIC": "абвгдежзиклмнопрстуфхцчшэюя", "GREEK": "αβγδεζηθικλμνξοπρστυφχψω"}
#: What other characters of secrets are drawn from; none ends a secret.
MARKS = "!#$%&*+-./:=?@^_~"


class _Draw:
    """A stream of numbers from a keyed hash."""

    def __init__(self, key: bytes, *parts: str):
        self.seed, self.n, self.pool = hmac.new(key, "\x1f".join(parts).encode(), hashlib.sha256).digest(), 0, 0

    def below(self, n: int) -> int:
        if self.pool < 1 << 64:
            block = hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest()
            self.pool, self.n = int.from_bytes(block, "big") | 1 << 256, self.n + 1
        self.pool, out = divmod(self.pool, n)
        return out


def _luhn(digits: str) -> int:
    odd = digits[-1::-2]
    even = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, odd)) + sum(even)) % 10


def _mod97(iban: str) -> int:
    """The remainder of an IBAN's check; 1 if it is valid."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def surrogate(key: bytes, kind: str, norm: str, attempt: int = 0) -> str:
    """A replacement of the same kind and form; another one for every attempt.

    Check digits are right where the original's are. The first group of an IPv6
    address stays, and so do its groups of zeros but the last.
    """
    draw = _Draw(key, kind, norm, str(attempt))
    if kind == "ipv6":
        groups = norm.split(":")
        zeros = 0 if attempt < 8 else -1  # later attempts draw all groups
        drawn = [g if g == "" or int(g, 16) == zeros and i < len(groups) - 1 else f"{1 + draw.below(0xFFFF):04x}" for i, g in enumerate(groups) if i]
        return ":".join([groups[0], *drawn])
    if kind.startswith("name_"):
        script, parts = _script(norm), norm.split(" ")
        given, family = NAMES[kind[5:], script], FAMILY[script]
        out = [given[draw.below(len(given))]] if len(parts) > 1 else []
        out += [family[draw.below(len(family))] for _ in range(len(parts) - len(out))]
        # The lists are short: later attempts lengthen the last name, so that there is always a free one.
        vowel = {"LATIN": "aeiou", "CYRILLIC": "аеиоу", "GREEK": "αεηιο"}[script]
        low = {"LATIN": "bdlmnrst", "CYRILLIC": "бдлмнрст", "GREEK": "βδλμνρστ"}[script]
        return " ".join(out) + "".join(low[draw.below(len(low))] + vowel[draw.below(len(vowel))] for _ in range(attempt))
    if kind == "ipv4":
        private = ipaddress.ip_address(norm).is_private
        return f"10.{draw.below(256)}.{draw.below(256)}.{1 + draw.below(254)}" if private else ".".join(
            [str(11 + draw.below(80)), str(draw.below(256)), str(draw.below(256)), str(1 + draw.below(254))]
        )
    fixed = {"aws_key": 4, "iban": 2, "phone": max(0, len(norm) - 10)}.get(kind, 0)
    if kind == "email":
        fixed_from = norm.rindex(".")
    hexadecimal = bool(norm) and all(c in "0123456789abcdefABCDEF" for c in norm) and kind in ("secret", "hex")
    out = []
    for i, c in enumerate(norm):
        if i < fixed or kind == "email" and i >= fixed_from:
            out.append(c)
        elif hexadecimal:
            out.append("0123456789abcdef"[draw.below(16)].upper() if c.isupper() else "0123456789abcdef"[draw.below(16)])
        elif c.isdigit():
            out.append(str(1 + draw.below(9) if i == fixed else draw.below(10)))
        elif c.isalpha() and c.isascii():
            letters = string.ascii_uppercase if c.isupper() else string.ascii_lowercase
            out.append(letters[draw.below(26)])
        elif c.isalpha():
            letters = LETTERS.get(unicodedata.name(c, "").split(" ")[0], string.ascii_lowercase)
            drawn = letters[draw.below(len(letters))]
            out.append(drawn.upper() if c.isupper() else drawn)
        elif kind == "secret":
            out.append(MARKS[draw.below(len(MARKS))])
        else:
            out.append(c)
    if kind == "card":
        # The last digit counts once, so it alone sets the check sum: the original's, valid or not.
        out[-1] = str((int(out[-1]) - _luhn("".join(out)) + _luhn(norm)) % 10)
    if kind == "iban" and _mod97(norm) == 1:
        body = "".join(out)
        out[2:4] = f"{98 - _mod97(body[:2] + '00' + body[4:]):02d}"
    if kind in ("secret", "email"):
        # Short forms run out: later attempts are longer.
        out[:0] = [string.ascii_lowercase[draw.below(26)] for _ in range(attempt // 4)]
    return "".join(out)


def render(surface: str, kind: str, drawn: str, norm: str = "") -> str:
    """The surrogate in the form of a mention: its separators and its capitals, and of a part of a name that part."""
    if kind.startswith("name_"):
        words, name = surface.replace("\u00a0", " ").split(" "), norm.split(" ")
        at = _part(words, name) if len(words) < len(name) else -1
        return drawn if at < 0 else " ".join(drawn.split(" ")[at : at + len(words)])
    if kind == "ipv4":
        return drawn
    if kind == "ipv6":
        full = norm == _address(surface) and norm.count(":") == 7 and "" not in norm.split(":")
        shown = str(ipaddress.ip_address(drawn)) if full and "::" in surface else drawn
        return shown.upper() if surface.isupper() else shown
    if kind in ("phone", "card", "ssn", "iban"):
        rest = iter(drawn)
        return "".join(next(rest, "") if c.isalnum() else c for c in surface)
    if kind == "email":
        more = len(drawn) - len(surface)
        return drawn[:more] + "".join(d.upper() if s.isupper() else d for s, d in zip(surface, drawn[more:], strict=True))
    return drawn


def entities(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with a column of the entities found in ``text``."""
    columns, at = docs.columns, docs.columns.index(text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("norm", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([find(t) for t in batch.column(at).to_pylist()], spans)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*columns, name])

    return docs.mapInArrow(trimmed(run), f"{kinds}, `{name}` {ENTITY}")


def surrogates(distinct: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, surrogate) of every (kind, norm): distinct within a kind, names of any gender together, and none an entity itself.

    Of entities that draw the same surrogate the first by name keeps it; the
    others, and those that drew an occurring entity, draw again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "norm", "attempt")), strict=True)
            drawn = [surrogate(key, *row) for row in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, pa.string())], ["kind", "norm", "attempt", "surrogate"])

    space = F.when(F.startswith("kind", F.lit("name_")), "name").otherwise(F.col("kind")).alias("space")
    real = distinct.select(space, F.col("norm").alias("surrogate"))
    todo, done = distinct.select("kind", "norm", F.lit(0).alias("attempt")), None
    while True:
        drawn = materialize(todo.mapInArrow(trimmed(run), "kind string, norm string, attempt int, surrogate string").withColumn("space", space), "drawn")
        taken = real if done is None else real.union(done.select(space, "surrogate"))
        clash = drawn.join(taken.withColumn("taken", F.lit(True)).dropDuplicates(["space", "surrogate"]), ["space", "surrogate"], "left")
        first = F.row_number().over(Window.partitionBy("space", "surrogate").orderBy("norm", "kind")) == 1
        judged = materialize(clash.withColumn("free", F.col("taken").isNull() & first), "judged")
        accepted = judged.filter("free").select("kind", "norm", "surrogate")
        done = accepted if done is None else done.union(accepted)
        todo = judged.filter("not free").select("kind", "norm", (F.col("attempt") + 1).alias("attempt"))
        if not todo.limit(1).count():
            return done


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text`` and n_entities int, how many were replaced.

    Rows without an entity are returned as they are, null texts too; repeated
    rows get the same replacements; an n_entities column that is there
    already is replaced; all others stay, whatever their names; an empty table
    gives an empty table. Only texts that have an entity are moved.
    """
    docs = docs.drop("n_entities")
    columns = docs.columns
    p = unused(columns, "__pii_")
    row, found_, drawn_ = f"{p}row", f"{p}found", f"{p}drawn"
    may = F.coalesce(F.col(text).rlike(CANDIDATE), F.lit(False))
    seen = materialize(entities(docs.filter(may), text, found_).withColumn(row, F.monotonically_increasing_id()), "seen")
    mentions = seen.select(F.col(row).alias("__row"), F.explode(found_).alias("e")).select("__row", "e.kind", "e.norm").distinct()
    drawn = surrogates(materialize(mentions.select("kind", "norm").distinct(), "entities"), key)
    of_row = mentions.join(drawn, ["kind", "norm"]).groupBy(F.col("__row").alias(row)).agg(F.collect_list(F.struct("kind", "norm", "surrogate")).alias(drawn_))
    joined = seen.filter(F.size(found_) > 0).join(of_row, row).drop(row)
    at, order = columns.index(text), [*columns, found_, drawn_]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for t, found, drawn in zip(*(batch.column(i).to_pylist() for i in (at, len(columns), len(columns) + 1)), strict=True):
                of = {(d["kind"], d["norm"]): d["surrogate"] for d in drawn}
                parts, end = [], 0
                for e in found:
                    parts += [t[end : e["start"]], render(t[e["start"] : e["end"]], e["kind"], of[e["kind"], e["norm"]], e["norm"])]
                    end = e["end"]
                texts.append("".join(parts) + t[end:])
                counts.append(len(found))
            arrays = list(batch.columns[: len(columns)])
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int32())], [*columns, "n_entities"])

    replaced = joined.select(*order).mapInArrow(trimmed(run), f"{kinds}, n_entities int")
    none = F.lit(0).alias("n_entities")
    return docs.filter(~may).select(*columns, none).unionByName(seen.filter(F.size(found_) == 0).select(*columns, none)).unionByName(replaced)
