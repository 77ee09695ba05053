"""Quality rules with host verdicts (operator 7); DataFrame functions only.

Each document gets word, symbol and repetition counts and a base verdict. The
base failures of a host give a rate, shrunk by a beta prior whose parameters
come from all hosts (method of moments). A host whose shrunk rate is above
the limit is rejected with all its documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvault.llm._common import BLANK, BLANKS, materialize, unused

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Shrunk failure rate above which a host is rejected.
HOST_LIMIT = 0.5
#: Most rejected hosts that are broadcast; beyond it they are joined by key.
BROADCAST_HOSTS = 100_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(column: Column, characters: str) -> Column:
    return F.translate(column, characters, "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it.

    A column of its own would not do: the optimiser may put its expression
    back inside the lambdas, and then every element computes it again.
    """
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(words: Column) -> Column:
    """How many words stand in three-word windows that occur twice or more.

    The windows' hashes are sorted with their places: equal neighbours are
    repeated windows, and the places that they cover count once. Only where
    there is a repeated window is anything sorted.
    """
    no = F.lit(0).cast("long")
    window = lambda w: lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
    same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    repeated = lambda s: F.transform(F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)), lambda x: x["i"])
    covered = lambda places: F.aggregate(
        F.sort_array(places),
        F.struct(no.alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    placed = lambda g: F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    of_windows = lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), _let(placed(g), lambda s: covered(repeated(s)))).otherwise(no)
    return _let(F.slice(F.transform(words, window(words)), 1, F.greatest(F.size(words) - 2, F.lit(0))), of_windows)


def counts(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the five counts and base_failed, each named ``prefix`` + name.

    Null texts have no words and fail. Columns of ``docs`` that are named as
    one of these, in any case, give way to it; all others stay as they are.
    """
    new = {f"{prefix}{name}".lower() for name in (*COUNTS, "base_failed")}
    rest, w = [c for c in docs.columns if c.lower() not in new], unused(docs.columns, "__words")
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, f"[{BLANK}]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda line: F.length(_without(line, BLANKS)) > 0)
    pair = lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("repeat"))
    failed = lambda c: (c["n"] < 50) | (c["repeat"] * 100 > c["n"] * 50)
    of_words = _let(_let(words, pair), lambda c: F.struct(c["n"].alias("n"), c["repeat"].alias("repeat"), failed(c).alias("failed")))
    return docs.withColumn(w, of_words).select(
        *rest,
        F.col(f"{w}.n").alias(f"{prefix}n_words"),
        F.length(_without(t, BLANKS)).cast("long").alias(f"{prefix}word_chars"),
        (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias(f"{prefix}n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias(f"{prefix}n_dup_lines"),
        F.col(f"{w}.repeat").alias(f"{prefix}n_repeat_words"),
        F.col(f"{w}.failed").alias(f"{prefix}base_failed"),
    )


def host_verdicts(hosts: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, n, failed, rate, rejected) from (host, n, failed) counts.

    The prior's mean is the hosts' mean rate, its strength what their
    variance leaves beside the binomial one; with one host, or no spread, the
    prior has the weight of one document. The two moments are all that
    reaches the driver.
    """
    rate = F.col("failed") / F.col("n")
    moments = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var")).first()
    mean, var = moments["mean"] or 0.0, moments["var"] or 0.0
    strength = max(1.0, mean * (1 - mean) / var - 1 if var > 0 else 0.0)
    shrunk = (F.col("failed") + F.lit(mean) * strength) / (F.col("n") + F.lit(strength))
    return hosts.select("host", "n", "failed", shrunk.alias("rate"), (shrunk > limit).alias("rejected"))


def judge(scored: DataFrame, host: str = "source", limit: float = HOST_LIMIT, prefix: str = "") -> DataFrame:
    """``scored`` (from :func:`counts`) with kept: the base verdict and the host's. A null host rejects nothing.

    The rejected hosts are written and counted; up to ``BROADCAST_HOSTS`` are
    broadcast, so that a host with many documents moves none of them. A kept
    column that is there already gives way.
    """
    bad_host = unused(scored.columns, "__bad_host")
    failed = F.col(f"{prefix}base_failed")
    hosts = scored.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.count_if(failed).alias("failed"))
    hosts = materialize(hosts, "hosts")
    bad = materialize(host_verdicts(hosts, limit).filter("rejected").select(F.col("host").alias(bad_host)), "bad_hosts")
    known = F.broadcast(bad) if bad.count() <= BROADCAST_HOSTS else bad
    joined = scored.join(known, F.col(host) == F.col(bad_host), "left")
    return joined.withColumn(f"{prefix}kept", ~failed & F.col(bad_host).isNull()).drop(bad_host)


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", limit: float = HOST_LIMIT, prefix: str = "") -> DataFrame:
    """``docs`` without its text, with counts, base_failed and kept.

    The counts are written once to the shared folder, as both the hosts and
    the documents need them. Repeated rows count each; an empty table gives
    an empty table. Columns of ``docs`` that are named as a result give way to
    it; ``host`` must not be one.
    """
    return judge(materialize(counts(docs, text, prefix).drop(text), "counts"), host, limit, prefix)


def passing(docs: DataFrame, text: str = "text", host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``, whatever their names.

    The rows are written once with their base verdict, as the hosts' rates and
    the result both need it.
    """
    prefix = unused(docs.columns, "__qr_")
    flagged = counts(docs, text, prefix).select(*docs.columns, f"{prefix}base_failed")
    return judge(materialize(flagged, "flagged"), host, limit, prefix).filter(f"{prefix}kept").select(*docs.columns)
