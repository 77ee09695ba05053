"""Ignore rules against a plain matcher."""

import random

import pytest

from sparkvault.functions import predicates
from sparkvault.operators import rules


def component(glob, name):
    """Whether a component matches, character by character; None for a malformed pattern that is reached."""
    if not glob:
        return not name
    c = glob[0]
    if c == "*":
        return any(component(glob[1:], name[i:]) for i in range(len(name) + 1))
    if c == "[":
        i, inverse = 1, glob[1:2] == "^"
        i += inverse
        members = []
        while glob[i] != "]" or not members:
            low = glob[i + 1] if glob[i] == "\\" else glob[i]
            i += 2 if glob[i] == "\\" else 1
            high = low
            if glob[i] == "-":
                high = glob[i + 2] if glob[i + 1] == "\\" else glob[i + 1]
                i += 3 if glob[i + 1] == "\\" else 2
            members.append((low, high))
        return bool(name) and any(a <= name[0] <= b for a, b in members) != inverse and component(glob[i + 1 :], name[1:])
    if c == "?":
        return bool(name) and component(glob[1:], name[1:])
    if c == "\\":
        glob = glob[1:]
    return name[:1] == glob[0] and component(glob[1:], name[1:])


def matches(pattern, path):
    parts, body = path.split("/"), pattern.removeprefix("!").rstrip(" ")
    tree = body.endswith("/")
    body = body[:-1] if tree else body
    if "/" not in body:
        at = next((i for i, p in enumerate(parts) if component(body, p)), None)
        return at is not None and not (tree and at == len(parts) - 1)
    matched = skips = False
    globs = body.split("/")
    for i, g in enumerate(globs):
        if g == "":
            skips = False
        elif g == "**":
            if i == len(globs) - 1:
                break
            skips = True
        elif "**" in g or not parts:
            return False
        else:
            while skips and len(parts) > 1 and not component(g, parts[0]):
                parts = parts[1:]
            skips = False
            if not component(g, parts[0]):
                return False
            matched, parts = True, parts[1:]
    return matched and not (tree and not parts)


PATTERNS = ["*.tmp", "a[0-9].tmp", r"\#x", r"\!keep", "!a/b", "/a", "a/", "a/b/", "**/b", "a/**", "a/**/c", "**/a/b", "[^a]x", "[a-c]?", r"[\]x]y", r"a\*b", "x**y/z", "**", "/**", "b", "*", "!*.md", "c/*.md", "[a-", "a\\", "[]", "[b-a]", "d.e/*", "a//b", "é[à-ö]", " lead", "trail  "]
NAMES = ["a", "b", "c", "ab", "a1.tmp", "x.tmp", "#x", "!keep", "ax", "bx", "b1", "]y", "xy", "a*b", "x.md", "d.e", "éâ", "z", " lead", "trail"]


def random_paths(seed, n):
    r = random.Random(seed)
    return sorted({"/".join(r.choice(NAMES) for _ in range(r.randrange(1, 5))) for _ in range(n)})


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns_equal_the_plain_matcher(spark, pattern):
    expression, negated = predicates.ignore_regex(pattern)
    assert negated == pattern.startswith("!")
    malformed = pattern in ("[a-", "a\\", "[]", "[b-a]")
    paths = random_paths(1, 600)
    found = set() if expression is None else {r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").filter(f"p rlike r'{expression}'" if "'" not in expression else "false").collect()}
    assert (expression is None) >= malformed
    assert found == (set() if malformed else {p for p in paths if matches(pattern, p)})


def test_rule_table_takes_the_last_match_of_each_vault_and_section(spark):
    r, good = random.Random(2), [p for p in PATTERNS if p not in ("[a-", "a\\", "[]", "[b-a]")]
    table = [(v, s, i, r.choice(PATTERNS)) for v in ("v", "w") for s in ("view", "edit") for i in range(12)] + [("v", "view", 99, None), ("u", "view", 1, "*")]
    paths = [(v, p) for v in ("v", "w", "none") for p in random_paths(3, 200)]
    want = set()
    for v, p in paths:
        for s in ("view", "edit"):
            hit = [x for tv, ts, _, x in table if tv == v and ts == s and x in good and matches(x, p)]
            want |= {(v, p, s, not hit[-1].startswith("!"))} if hit else set()
    out = rules.match_rules(spark.createDataFrame(paths + paths[:5], "vault_id string, path string"), spark.createDataFrame(table, "vault_id string, section string, ordinal int, pattern string"))
    got = [tuple(x) for x in out.collect()]
    assert set(got) == want and len(got) == len(want)


def test_rules_of_one_regex_meet_paths_once(spark):
    table = spark.createDataFrame([("v", "view", i, "!*.md" if i % 3 == 0 else "*.md") for i in range(100)] + [("v", "edit", 1, "*.md"), ("w", "view", None, "*.md")], "vault_id string, section string, ordinal int, pattern string")
    kept = {(r.vault_id, r.section, r.ordinal, r.negated) for r in rules.last_rules(table).collect()}
    assert kept == {("v", "view", 99, True), ("v", "edit", 1, False), ("w", "view", None, None)}
    out = rules.match_rules(spark.createDataFrame([("v", "a.md"), ("v", "b/c.md")], "vault_id string, path string"), table)
    assert {tuple(r) for r in out.collect()} == {("v", p, s, s == "edit") for p in ("a.md", "b/c.md") for s in ("view", "edit")}


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_rules_of_names_with_wildcards_meet_only_the_paths_that_have_their_rarest_key(spark, monkeypatch, broadcast):
    monkeypatch.setattr(rules, "BROADCAST_RULES", broadcast)
    paths = spark.createDataFrame([("v", f"src/en/{i}.md") for i in range(400)], "vault_id string, path string")
    patterns = [(f"{i}.m?", f"src/{i}.m?", f"src/**/?{i}.md", "*[13579].md")[i % 4] for i in range(400)]
    table = spark.createDataFrame([("v", "view", i, p) for i, p in enumerate(patterns)], "vault_id string, section string, ordinal int, pattern string")
    assert rules.candidates(paths, table).count() < 2 * 400 + 400
    got = {(r.path, r.ignored) for r in rules.match_rules(paths, table).collect()}
    assert got == {(f"src/en/{i}.md", True) for i in range(400) if any(matches(p, f"src/en/{i}.md") for p in set(patterns))}


def test_keys_are_what_a_matching_path_has(spark):
    assert predicates.ignore_keys("!15.m?") == ["^15.m"]
    assert predicates.ignore_keys(r"/src/**/[0-4\5]*.md/  ") == ["=src", "$.md"]
    assert predicates.ignore_keys("a /") == ["=a "]
    table = spark.createDataFrame([("v", "view", 1, "a /")], "vault_id string, section string, ordinal int, pattern string")
    out = rules.match_rules(spark.createDataFrame([("v", "a /x"), ("v", "a/x")], "vault_id string, path string"), table)
    assert [tuple(r) for r in out.collect()] == [("v", "a /x", "view", True)]
