"""Ignore rules as a table: the rules of many vaults and sections against the paths of all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvault.functions.predicates import ignore_keys, ignore_regex

PARSED = "vault_id string, section string, ordinal long, regex string, negated boolean, keys array<string>"
#: Rules, by their keys, that are broadcast; more are joined by shuffle.
BROADCAST_RULES = 500_000


def parsed_rules(rules: DataFrame) -> DataFrame:
    """(vault_id, section, ordinal, regex, negated, keys array) of ``rules`` (vault_id, section, ordinal, pattern); malformed ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns = batch.column("pattern").to_pylist()
            found = [(*ignore_regex(p), ignore_keys(p)) if p else (None, False, []) for p in patterns]
            columns = {c: batch.column(c) for c in ("vault_id", "section", "ordinal")}
            columns |= {name: pa.array([f[i] for f in found], kind) for i, (name, kind) in enumerate((("regex", pa.string()), ("negated", pa.bool_()), ("keys", pa.list_(pa.string()))))}
            yield pa.record_batch(columns)

    rows = rules.select(F.col("vault_id").cast("string").alias("vault_id"), F.col("section").cast("string").alias("section"), F.col("ordinal").cast("long").alias("ordinal"), "pattern")
    return rows.mapInArrow(run, PARSED).filter("regex is not null")


def last_rules(rules: DataFrame) -> DataFrame:
    """:func:`parsed_rules`, of those with one regex in a section only the last: it has the last word wherever the others match."""
    last = parsed_rules(rules).groupBy("vault_id", "section", "regex").agg(F.max("ordinal").alias("ordinal"), F.max_by("negated", "ordinal").alias("negated"), F.max("keys").alias("keys"))
    return last.select("vault_id", "section", "ordinal", "regex", "negated", "keys")


def path_keys(path: Column, heads: Column, tails: Column) -> Column:
    """The keys under which a path can meet a rule: its components, their begins and ends of the lengths that rules have, and the key of rules without any."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")

    def cuts(lengths: Column, sign: str, cut: Callable[[Column, Column], Column]) -> Column:
        return F.flatten(F.transform(parts, lambda p: F.transform(F.filter(lengths, lambda n: n <= F.length(p)), lambda n: F.concat(F.lit(sign), cut(p, n)))))

    begins, ends = cuts(heads, "^", lambda p, n: F.substring(p, F.lit(1), n)), cuts(tails, "$", lambda p, n: F.substring(p, -n, n))
    return F.array_distinct(F.concat(F.transform(parts, lambda p: F.concat(F.lit("="), p)), begins, ends, F.array(F.lit(""))))


def candidates(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(vault_id, path, section, ordinal, regex, negated): each path, taken once, with the rules of its vault that can match it.

    A rule is joined on the vault and one key: a component that it names, or
    the begin or end of one, whichever the fewest paths have; those without any
    meet all paths of their vault. Rules are broadcast where they are few.
    """
    last = last_rules(rules).withColumn("rule", F.monotonically_increasing_id()).checkpoint()
    keyed = last.select("rule", "vault_id", F.explode(F.when(F.size("keys") > 0, F.col("keys")).otherwise(F.array(F.lit("")))).alias("key"))
    length = {c: F.collect_set(F.when(F.col("key").startswith(sign), F.length("key") - 1)).alias(c) for c, sign in (("heads", "^"), ("tails", "$"))}
    lengths = keyed.agg(*length.values())
    spread = F.broadcast if keyed.count() <= BROADCAST_RULES else lambda table: table

    def exploded(some: DataFrame) -> DataFrame:
        return some.crossJoin(F.broadcast(lengths)).select("vault_id", "path", F.explode(path_keys(F.col("path"), F.col("heads"), F.col("tails"))).alias("key"))

    counts = exploded(paths).join(spread(keyed.select("vault_id", "key").distinct()), ["vault_id", "key"]).groupBy("vault_id", "key").agg(F.count("*").alias("n"))
    rarest = keyed.join(counts, ["vault_id", "key"]).groupBy("rule").agg(F.min_by("key", "n").alias("key"))
    held = last.drop("keys").join(rarest, "rule")
    return exploded(paths.select("vault_id", "path").distinct()).join(spread(held), ["vault_id", "key"]).select("vault_id", "path", "section", "ordinal", "regex", "negated")


def match_rules(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(vault_id, path, section, ignored): of each path and section of its vault's rules that match, whether the last one ignores it.

    Rules of a section that match the same paths count as the last of them, and
    meet no path before. Of a path that no rule of a section matches there is
    no row. Repeated paths are one.
    """
    hits = candidates(paths, rules).filter(F.expr("path rlike regex"))
    best = hits.groupBy("vault_id", "path", "section").agg(F.max_by("negated", "ordinal").alias("negated"))
    return best.select("vault_id", "path", "section", (~F.col("negated")).alias("ignored"))
