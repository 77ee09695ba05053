"""Language identification by prediction by partial matching (operator 5).

Every language has a tree of byte contexts of up to ``ORDER`` bytes with the
counts of what followed. A byte's probability is its share in the longest
known context; from a context that has not seen it the coder escapes to the
next shorter one, down to an even share of 256 (escape method C: the escape's
count is the number of distinct followers). The statistics stay frozen while
texts are scored, so a text's code length is the sum of one cost per position,
a function of the last ``ORDER`` + 1 bytes, and is exact.

Texts are lower-cased and their runs of non-letters become one space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkvault.llm._common import mix64, slices, trimmed

ORDER = 3
#: Most documents of a language that the trees learn from, those of the smallest hashes of id and text,
#: so that the model stays bounded. Every language with a text has a document among them.
SAMPLE_DOCS = 1_500
#: Most bytes of them; a first document alone may have more.
SAMPLE_BYTES = 64 << 20
#: Bytes of text scored at once.
CHUNK = 1 << 20

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """The text as the trees see it: lower-case letters, single spaces; empty if it has no letter."""
    if not text:
        return b""
    kept = _OTHER.sub(" ", text.lower()).strip()
    if not kept or not any(map(str.isalpha, kept[:1])) and not any(map(str.isalpha, kept)):
        return b""
    return kept.encode()


def _padded(docs: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the last order + 1 bytes at every position of all texts, and each text's number of positions.

    A text starts after ``order`` spaces and ends with one.
    """
    pad = b" " * order
    joined = np.frombuffer(b"".join(pad + d + b" " for d in docs), np.uint8).astype(np.uint32)
    n = np.fromiter(map(len, docs), np.int64, len(docs)) + 1
    code = joined.copy()
    for k in range(1, order + 1):
        code[k:] |= joined[:-k] << np.uint32(8 * k)
    ends = np.cumsum(n + order)
    inside = np.ones(len(joined), bool)
    for k in range(order):
        inside[ends - n - order + k] = False
    return code[inside], n


def counted(docs: DataFrame, text: str, label: str, order: int = ORDER) -> DataFrame:
    """(lang, gram long, n long): how often each run of order + 1 bytes occurs in each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if kept := letters(t):
                    by_lang.setdefault(lang, []).append(kept)
            for lang, texts in by_lang.items():
                for first, last in slices(list(map(len, texts)), 16 * CHUNK):
                    grams, n = np.unique(_padded(texts[first:last], order)[0], return_counts=True)
                    yield pa.record_batch({"lang": pa.array([lang] * len(grams)), "gram": pa.array(grams.astype(np.int64)), "n": pa.array(n)})

    rows = docs.select(F.col(label).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(trimmed(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Trees:
    """Frozen context trees of all languages, with the cost in bits of every known run of bytes."""

    def __init__(self, langs: list[str], lang_at: np.ndarray, grams: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.langs, self.order = langs, order
        self.nodes = []  # by context length: runs, their counts; contexts, totals, distinct followers; each per language
        for k in range(order + 1):
            mask = np.int64((1 << (8 * (k + 1))) - 1)
            runs, at = np.unique(grams & mask, return_inverse=True)
            seen = np.zeros((len(runs), len(langs)))
            np.add.at(seen, (at, lang_at), counts)
            contexts, under = np.unique(runs >> 8, return_inverse=True)
            total, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
            np.add.at(total, under, seen)
            np.add.at(kinds, under, seen > 0)
            self.nodes.append((runs, seen, contexts, total, kinds))
        self.known = self.nodes[order][0]
        bits = max(16, int(4 * max(1, len(self.known))).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot = np.full(1 << bits, -1, np.int32)
        self.slot[self._hash(self.known)] = np.arange(len(self.known), dtype=np.int32)
        self.cost = self.bits(self.known).astype(np.float32)

    def _hash(self, grams: np.ndarray) -> np.ndarray:
        return (mix64(grams.astype(np.uint64)) >> self.shift).astype(np.int64)

    @staticmethod
    def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_keys, keys), max(0, len(sorted_keys) - 1))
        return at, sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), bool)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """The cost of the last byte of each run after those before it, for each language."""
        grams = grams.astype(np.int64)
        cost = np.full((len(grams), len(self.langs)), 8.0)
        for k, (runs, seen, contexts, total, kinds) in enumerate(self.nodes):
            run = grams & np.int64((1 << (8 * (k + 1))) - 1)
            at, there = self._find(runs, run)
            under, reached = self._find(contexts, run >> 8)
            n = np.where(there[:, None], seen[at], 0.0)
            t = np.where(reached[:, None], total[under], 0.0)
            u = np.where(reached[:, None], kinds[under], 0.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                here, escape = -np.log2(n / (t + u)), -np.log2(u / (t + u))
            cost = np.where(n > 0, here, np.where(t > 0, escape + cost, cost))
        return cost

    def code_lengths(self, docs: list[bytes]) -> np.ndarray:
        """Bits that each language's tree needs for each text."""
        out = np.zeros((len(docs), len(self.langs)))
        for first, last in slices([len(d) + self.order + 1 for d in docs], CHUNK):
            grams, n = _padded(docs[first:last], self.order)
            at = self.slot[self._hash(grams)]
            miss = np.flatnonzero(self.known[at] != grams)  # at -1 a slot is free, and the last run does not equal
            for j in range(len(self.langs)):
                cost = self.cost[at, j].astype(np.float64)
                if j == 0 and len(miss):
                    rare, back = np.unique(grams[miss], return_inverse=True)
                    of_rare = self.bits(rare)
                if len(miss):
                    cost[miss] = of_rare[back, j]
                out[first:last, j] = np.add.reduceat(cost, np.concatenate([[0], np.cumsum(n)[:-1]]))
        return out


def sampled(docs: DataFrame, text: str, label: str, key: str | None, sample_docs: int) -> DataFrame:
    """(label, text) of at most ``sample_docs`` documents and ``SAMPLE_BYTES`` of each label, one document at least; repeated rows count once.

    The documents of the smallest hashes. A rough cut by the labels' sizes
    comes first, so that few hashes are sorted.
    """
    parts = [text] if key is None or key not in docs.columns else [key, text]
    rows = docs.filter(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("lang"), F.col(text).alias("text"), F.xxhash64(*parts).alias("h"))
    share = (F.col("h") / F.lit(2.0**64)) + 0.5
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    rough = F.lit(1.0)
    for lang, n in sizes.items():
        if n > 4 * sample_docs:
            rough = F.when(F.col("lang") == lang, F.lit(2 * sample_docs / n)).otherwise(rough)
    near = rows.filter(share <= rough)
    by_hash = Window.partitionBy("lang").orderBy("h")
    each = near.groupBy("lang", "h").agg(F.max(F.octet_length("text")).cast("long").alias("size"))
    each = each.withColumn("place", F.row_number().over(by_hash)).withColumn("bytes", F.sum("size").over(by_hash))
    cuts = each.filter((F.col("place") <= sample_docs) & ((F.col("bytes") <= SAMPLE_BYTES) | (F.col("place") == 1))).groupBy("lang").agg(F.max("h").alias("h"))
    cut = F.lit(None).cast("long")
    for r in cuts.collect():  # a row for each language
        cut = F.when(F.col("lang") == r["lang"], F.lit(r["h"])).otherwise(cut)
    return near.filter(F.col("h") <= cut).dropDuplicates(["lang", "h"]).select("lang", "text")


def fit(
    docs: DataFrame, text: str = "text", label: str = "lang", sample_docs: int = SAMPLE_DOCS, order: int = ORDER, key: str | None = "doc_id"
) -> Trees | None:
    """Trees of the languages of ``docs``; None if no row has both a text and a language.

    Learns from at most ``sample_docs`` documents of each language (see
    ``sampled``). The counts that reach the driver are those of that sample.
    """
    rows = counted(sampled(docs, text, label, key, sample_docs), "text", "lang", order).toPandas()
    if not len(rows):
        return None
    langs = sorted(rows["lang"].unique())
    lang_at = rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    return Trees(langs, lang_at, rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(np.float64), order)


def predict(docs: DataFrame, trees: Trees | None, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred string, score double and bits_per_byte double.

    The language whose tree needs the fewest bits for the whole text; ties go
    to the first by name. The score is that language's share of the
    languages' probabilities of the text. Null texts and texts without a
    letter, and all texts if there are no trees, are ``und`` with score 0.
    ``prefix`` goes before the three names; columns of these names that are
    there already are replaced.
    """
    names = [prefix + n for n in ("lang_pred", "score", "bits_per_byte")]
    kept = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    columns, at = kept.columns, kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            docs = [letters(t) for t in batch.column(at).to_pylist()]
            pred, score, per_byte = ["und"] * len(docs), [0.0] * len(docs), [None] * len(docs)
            rows = [i for i, d in enumerate(docs) if d and trees]
            if rows:
                bits = trees.code_lengths([docs[i] for i in rows])
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(rows)), best]
                share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                for i, b, s, n in zip(rows, best.tolist(), share.tolist(), least.tolist(), strict=True):
                    pred[i], score[i], per_byte[i] = trees.langs[b], s, n / (len(docs[i]) + 1)
            arrays = [*batch.columns, pa.array(pred), pa.array(score, pa.float64()), pa.array(per_byte, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, *names])

    extra = f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` double"
    return kept.mapInArrow(trimmed(run), f"{kinds}, {extra}")


def identify(docs: DataFrame, learn_from: Column, text: str = "text", label: str = "lang", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Fit on the rows of ``learn_from`` and predict every row."""
    return predict(docs, fit(docs.filter(learn_from), text, label, sample_docs), text)
