"""Frontmatter of random nesting in random forms of writing, and golden blocks."""

import random

import pytest

from sparkvault.functions.frontmatter import paths
from sparkvault.operators import text as texts

WORDS = ["a", "two words", "it's", 'say "x"', "x: y", "- dash", "# hash", "http://a.b/c:1", "1", "true", "", "[b", "{c", "*star", "&and", "é ü", "a, b", "| bar", "trail ", "a #b", "~", "null"]


def tree(r, depth=0):
    kind = r.random()
    if depth > 3 or kind < 0.45:
        return r.choice(WORDS) if r.random() < 0.85 else "\n".join(r.choice(["line", "  deep", "", "x: y"]) for _ in range(r.randrange(1, 4))).strip("\n")
    if kind < 0.75:
        return {r.choice(["k", "key two", "z-9", "q.r", "it's"]) + str(i): tree(r, depth + 1) for i in range(r.randrange(1, 4))}
    return [tree(r, depth + 1) for _ in range(r.randrange(1, 4))]


def quoted(r, text):
    if "\n" in text or r.random() < 0.5:
        return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    return "'" + text.replace("'", "''") + "'"


def plain(text):
    return "\n" not in text and text not in ("", "~", "null") and text == text.strip() and text[0] not in "[]{}#&*!|>'\"%@`-," and ": " not in text and " #" not in text


def flow(r, node):
    if isinstance(node, dict):
        return "{" + ", ".join(f"{quoted(r, k)}: {flow(r, v)}" for k, v in node.items()) + "}"
    if isinstance(node, list):
        return "[" + (",\n        " if r.random() < 0.3 else ", ").join(flow(r, v) for v in node) + "]"
    return quoted(r, node)


def value(r, node, indent):
    """What is written behind a key or a dash, with the lines below."""
    if isinstance(node, str):
        if node and "\n" in node and r.random() < 0.6 and not node.startswith(" ") and node.strip():
            pad = " " * (indent + 2)
            return "|-\n" + "\n".join(pad + line if line else "" for line in node.split("\n"))
        return node + (" # note" if r.random() < 0.2 else "") if plain(node) and r.random() < 0.6 else quoted(r, node)
    if r.random() < 0.25:
        return flow(r, node)
    deeper = indent + r.choice([1, 2, 4])
    if isinstance(node, list) and r.random() < 0.3:
        deeper = indent
    return "\n" + block(r, node, deeper)


def block(r, node, indent):
    pad, out = " " * indent, []
    if isinstance(node, dict):
        for k, v in node.items():
            out.append(f"{pad}{k if plain(k) and r.random() < 0.8 else quoted(r, k)}: {value(r, v, indent)}".rstrip(" "))
            if r.random() < 0.15:
                out.append(r.choice(["", "# a comment"]))
        return "\n".join(out)
    for v in node:
        if isinstance(v, (dict, list)) and r.random() < 0.5:
            out.append(pad + "- " + block(r, v, indent + 2)[indent + 2 :])
        elif isinstance(v, list):
            out.append(f"{pad}- {flow(r, v)}")
        elif isinstance(v, dict):
            out.append(f"{pad}-\n" + block(r, v, indent + 3))
        else:
            out.append(f"{pad}- {value(r, v, indent)}")
    return "\n".join(out)


def flat(node, path=""):
    if isinstance(node, str):
        return {path: node}
    items = node.items() if isinstance(node, dict) else enumerate(node)
    return {k: v for key, child in items for k, v in flat(child, f"{path}.{key}".lstrip(".")).items()}


def test_generated_blocks_give_their_paths():
    r = random.Random(1)
    for n in range(3000):
        node = {f"t{i}": tree(r) for i in range(r.randrange(1, 4))}
        text = block(r, node, 0)
        assert paths(text) == flat(node), (n, text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a: &x [1, 2]\nb: *x", {"a.0": "1", "a.1": "2", "b.0": "1", "b.1": "2"}), ("a: &x\n  k: v\nb:\n  <<: *x\n  l: w", {"a.k": "v", "b.k": "v", "b.l": "w"}),
        ("a: >\n  x\n  y\n\n  z\n    deep\n  w\nb: 1", {"a": "x y\nz\n  deep\nw\n", "b": "1"}), ("a: |+\n  x\n\nb: |2\n    y\n", {"a": "x\n\n", "b": "  y\n"}),
        ("a: !!str 5\nb: !x &y z\nc: *y", {"a": "5", "b": "z", "c": "z"}), ("a:\n\n# note\n- 1\n-   k: v\n    l: w", {"a.0": "1", "a.1.k": "v", "a.1.l": "w"}),
        ("a: 'two\n  lines'\nb: one\n  more # end\nc:", {"a": "two lines", "b": "one more", "c": None}), ("nonsense\na: 1\n\t- x\n: y", {"a": "1"}), ("", {}), ("a: [1, {b: 2", {}), ("a: \"\\u00e9\\t\"", {"a": "é\t"}),
    ],
)
def test_golden_blocks(text, want):
    assert paths(text) == want


def test_fences_and_lists(spark):
    cases = [
        "---\ntitle: T\ntags: [a, 'b c']\naliases:\n- x\n-- \ny: 1\n", "-\ntitle: 'It''s'\n-----\nbody", "---\ntitle: T\n---", "---\r\ntitle: T\r\n---\r\nbody", "---\n---\nbody", "--- \ntitle: T\n---\n", "text", None,
        "---\ntags: a, b\n---\n",
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = {r.i: r for r in df.select("i", texts.extract_frontmatter(df.t).alias("f"), texts.split_frontmatter(df.t)["body"].alias("body")).collect()}
    assert [(got[i].f.title, got[i].body) for i in range(9)] == [
        (None, cases[0]), ("It's", "body"), (None, cases[2]), ("T", "body"), (None, "body"), (None, cases[5]), (None, "text"), (None, None), (None, ""),
    ]
    assert got[8].f.tags == [] and got[8].f.raw == {"tags": "a, b"} and got[2].f.raw is None
