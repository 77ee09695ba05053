"""Near-duplicate documents by one-permutation MinHash (operator 3).

One hash of every five-word shingle serves all: its top bits choose one of
``bins`` bins, the smallest hash of a bin is its minimum, and empty bins take
the minimum of a bin drawn by optimal densification. Bands of the minima are
bucket keys. Documents with equal shingle sets are one class, of which one
representative goes on. In each bucket the members are tied to one centre
only, a star, so that candidates grow with the members and not with their
square; every candidate is confirmed on the full sets.

A star can miss a link between two members that are both unlike their centre.
Buckets where such members of different components are left have further
stars, each with another centre, while these still tie many; what is left then
goes through an exact join on rare shingles. So the number of stars costs time
only and no link. Components come from minimum labels with pointer jumping
over the labels of the turn before; no edge list reaches the driver.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkvault.llm._common import BLANKS, materialize, mix64, text_bytes, trimmed

#: Words of a shingle.
WIDTH = 5
#: 128 bins in 32 bands of 4: two sets of similarity 0.85 share no band once in 10^10 pairs.
BINS, ROWS = 128, 4
#: Most ids of documents that are broadcast; beyond it they are joined.
BROADCAST_IDS = 1_000_000
#: Stars go on while one more takes at least this share off the members that are left.
STAR_SHARE = 0.25
#: Groups that a bucket's members are dealt to where they meet its centre.
BUCKET_SALTS = 16
#: Rows of one shingle that meet in one group of the exact join.
SALT_ROWS = 512
#: Bytes of text hashed at once.
CHUNK = 1 << 18

_MULTIPLIER = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    inverse = pow(_MULTIPLIER, -1, 1 << 64)
    out = []
    for m in (_MULTIPLIER, inverse):
        x = np.full(n + 1, m, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """A mask of the first of every run of equal elements."""
    out = np.ones(len(ordered), bool)
    out[1:] = ordered[1:] != ordered[:-1]
    return out


class Shingler:
    """Distinct 64-bit hashes of the shingles of texts."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.blank = np.zeros(256, bool)
        self.blank[list(BLANKS.encode())] = True
        self.table = mix64(np.arange(1, 257, dtype=np.uint64))
        self.table[self.blank] = self.table[ord(" ")]
        self.next_blank = re.compile(b"[" + BLANKS.encode() + b"]")
        self.up, self.down = _powers(CHUNK + 64)

    def hashes(self, text: bytes | None) -> np.ndarray:
        """The sorted shingle hashes of a text.

        A-Z count as a-z, words stand between ASCII white space. Fewer words
        than the width make one shingle; no words make none. Long texts are
        hashed piece by piece, each piece from the first word that begins no
        shingle of the piece before.
        """
        text, found, at, size = (text or b"").lower(), [], 0, CHUNK
        while at < len(text):
            end = self.next_blank.search(text, min(len(text), at + size))
            stop = end.start() if end else len(text)
            spans, on = self._spans(text[at:stop], whole=not found and stop == len(text))
            if stop < len(text) and not len(spans):  # fewer words than a shingle has
                size *= 2
                continue
            found.append(spans)
            if stop == len(text):
                break
            at, size = at + on, CHUNK
        if not found:
            return np.empty(0, np.uint64)
        out = np.sort(found[0] if len(found) == 1 else np.concatenate(found))
        return out[_firsts(out)]

    def _spans(self, piece: bytes, whole: bool) -> tuple[np.ndarray, int]:
        """The hashes of a piece's shingles, and where the first word after their first words begins."""
        raw = np.frombuffer(piece, np.uint8)
        blank = self.blank[raw]
        again = np.concatenate([[True], blank[:-1]])
        first = np.flatnonzero(~blank & again)
        kept = ~(blank & again)  # one blank between words, none before the first
        joined, apart = raw[kept], blank[kept]
        n = len(first)
        k = min(self.width, n) if whole else self.width
        if not k or n < k:
            return np.empty(0, np.uint64), 0
        ends = np.flatnonzero(apart)
        if len(ends) < n:
            ends = np.append(ends, len(joined))
        starts = np.concatenate([[0], ends[: n - 1] + 1])
        if len(joined) + 1 > len(self.up):
            self.up, self.down = _powers(len(joined) + 1)
        prefix = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum(self.table[joined] * self.up[: len(joined)], out=prefix[1:])
        a, b = starts[: n - k + 1], ends[k - 1 : n]
        spans = (prefix[b] - prefix[a]) * self.down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix64(spans), int(first[n - k + 1]) if n - k + 1 < n else len(piece)


class Signer:
    """One-permutation minima with optimal densification, and their band keys."""

    def __init__(self, bins: int = BINS, rows: int = ROWS):
        self.bins, self.rows = bins, rows
        self.shift = np.uint64(64 - bins.bit_length() + 1)
        draws = mix64(np.arange(64 * bins, dtype=np.uint64) + np.uint64(1 << 40))
        self.draws = (draws % np.uint64(bins)).astype(np.int64).reshape(64, bins)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        """The bins' minima of a sorted, non-empty set of hashes."""
        bins = (hashes >> self.shift).astype(np.int64)
        first = _firsts(bins)
        filled = bins[first]
        minima, there = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        minima[filled], there[filled] = hashes[first], True
        empty = np.flatnonzero(~there)
        source = minima.copy()
        for draw in self.draws:
            if not len(empty):
                break
            got = there[draw[empty]]
            minima[empty[got]] = source[draw[empty[got]]]
            empty = empty[~got]
        if len(empty):  # sets of very few shingles: go by the order of the filled bins
            minima[empty] = source[filled[mix64(empty.astype(np.uint64)) % np.uint64(len(filled))]]
        return minima

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """Band keys of rows of minima."""
        key = np.arange(self.bins // self.rows, dtype=np.uint64)
        for column in np.moveaxis(minima.reshape(-1, self.bins // self.rows, self.rows), 2, 0):
            key = mix64(key ^ column) + column
        return mix64(key).view(np.int64)


def set_name(hashes: np.ndarray) -> bytes | None:
    """A digest that stands for a set of shingles; None for the empty set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def signatures(docs: DataFrame, key: str, text: str, width: int = WIDTH, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, set_id binary, keys array<long>) of every row; no keys without shingles."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(width), Signer(bins, rows)
        for batch in batches:
            n, names, minima = [], [], []
            for t in text_bytes(batch, "text"):
                found = shingler.hashes(t)
                n.append(len(found))
                names.append(set_name(found))
                if len(found):
                    minima.append(signer.minima(found))
            of = iter(signer.keys(np.array(minima, np.uint64).reshape(-1, bins)))
            keys = [next(of) if k else None for k in n]
            yield pa.record_batch(
                {
                    "id": batch.column("id"),
                    "n_shingles": pa.array(n, pa.int64()),
                    "set_id": pa.array(names, pa.binary()),
                    "keys": pa.array(keys, pa.list_(pa.int64())),
                }
            )

    rows_in = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows_in.mapInArrow(trimmed(run), f"id {kind}, n_shingles long, set_id binary, keys array<long>")


def shingled(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(sid, rep, n, hashes array<long>) of ``rows`` (sid, rep, set_id, text) whose text has the set ``set_id``."""
    kind = rows.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            at, found = [], []
            for i, (t, name) in enumerate(zip(text_bytes(batch, "text"), batch.column("set_id").to_pylist(), strict=True)):
                hashes = shingler.hashes(t)
                if set_name(hashes) == name:
                    at.append(i)
                    found.append(hashes.view(np.int64))
            those = {c: batch.column(c).take(pa.array(at, pa.int64())) for c in ("sid", "rep")}
            sizes = {"n": pa.array(map(len, found), pa.int64()), "hashes": pa.array(found, pa.list_(pa.int64()))}
            yield pa.record_batch(those | sizes)

    return rows.select("sid", "rep", "set_id", "text").mapInArrow(trimmed(run), f"sid long, rep {kind}, n long, hashes array<long>")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the representatives of the pairs (sid_a, sid_b) whose full sets have the similarity."""
    of = lambda x: sets.select(*(F.col(c).alias(f"{c}_{x}") for c in ("sid", "rep", "n", "hashes")))
    both = pairs.join(of("b"), "sid_b").join(of("a"), "sid_a")
    common = F.size(F.array_intersect("hashes_a", "hashes_b")).cast("long")
    return both.filter(common * 100 >= (F.col("n_a") + F.col("n_b") - common) * percent).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable, of every id in ``edges`` (a, b).

    Every round takes the least label among the neighbours and then the label
    of that label. Written to the shared folder each round.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        labels = materialize(stepped.join(far, "label", "left").select("id", "was", F.least("label", "far").alias("label")), "labels")
        moved = labels.filter(F.col("was") != F.col("label")).limit(1).count()
        labels = labels.select("id", "label")
        if not moved:
            return labels


def relabelled(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``labels`` (id, label) after further ``edges`` (a, b) of ids; only the labels that these tie are walked through."""
    if labels is None:
        return components(edges)
    of = lambda x: labels.select(F.col("id").alias(x), F.col("label").alias(f"label_{x}"))
    ends = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    tied = ends.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).filter("a <> b")
    now = components(tied)
    moved = labels.join(now.select(F.col("id").alias("label"), F.col("label").alias("now")), "label", "left")
    moved = moved.select("id", F.coalesce("now", "label").alias("label"))
    return materialize(moved.union(now.join(labels.select("id"), "id", "left_anti").select("id", "label")), "labels")


def rare_pairs(sets: DataFrame, percent: int, salt_rows: int = SALT_ROWS) -> DataFrame:
    """(sid_a, sid_b) of ``sets`` (sid, label, n, hashes): all pairs of two labels that can have the similarity.

    A join on prefixes: with the shingles of all sets in one order, rare ones
    first, two similar sets share one of the first few of each. Shingles of one
    label only come first of all, and make no pair. The smaller set of a pair
    has the shorter prefix. Shingles of many sets are dealt out by salt.
    """
    flat = sets.select("sid", "label", "n", F.explode("hashes").alias("hash"))
    shared = flat.groupBy("hash").agg(F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    shared = shared.filter(F.col("lo") != F.col("hi")).select("hash", "df")
    of_row = Window.partitionBy("sid")
    at = F.col("n") - F.count("*").over(of_row) + F.row_number().over(of_row.orderBy("df", "hash"))
    ranked = flat.join(shared, "hash").withColumn("at", at)
    # Overlaps needed: against any set at least percent of its own size, against a larger one 2p/(100+p) of it.
    ranked = ranked.filter(F.col("at") <= F.expr(f"n - (n * {percent} + 99) div 100 + 1"))
    ranked = materialize(ranked.withColumn("salts", F.expr(f"(df + {salt_rows} - 1) div {salt_rows}")), "prefixes")
    small = ranked.filter(F.col("at") <= F.expr(f"n - (2 * n * {percent} + {99 + percent}) div {100 + percent} + 1"))
    small = small.select("hash", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), *(F.col(c).alias(f"{c}_a") for c in ("sid", "label", "n", "at")))
    large = ranked.withColumn("salt", F.pmod(F.xxhash64("sid"), "salts"))
    fits = (F.col("n_a") * 100 >= F.col("n") * percent) & (F.struct("n_a", "sid_a") < F.struct("n", "sid")) & (F.col("label_a") != F.col("label"))
    reach = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n") - F.col("at"))
    both = small.join(large, ["hash", "salt"]).filter(fits & (reach * (100 + percent) >= (F.col("n_a") + F.col("n")) * percent))
    return both.select(F.least("sid_a", "sid").alias("sid_a"), F.greatest("sid_a", "sid").alias("sid_b")).distinct()


def _few(ids: DataFrame) -> DataFrame:
    """``ids``, to be broadcast where they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _meet(members: DataFrame, heads: DataFrame) -> DataFrame:
    """``members`` with their bucket's row of ``heads``: the one row goes to every salt, so that no task has a whole bucket of many."""
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BUCKET_SALTS - 1).cast("long"))).alias("salt")
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(BUCKET_SALTS)))
    return dealt.join(heads.select("*", salts), ["bucket", "salt"]).drop("salt")


def class_labels(docs: DataFrame, classes: DataFrame, key: str, text: str, percent: int, width: int = WIDTH) -> DataFrame | None:
    """(id, label) of the representatives in ``classes`` (sid, rep, set_id, n, keys) that have a link; None without any."""
    keyed = classes.select("sid", "rep", "n", F.explode("keys").alias("bucket"))
    heads = keyed.groupBy("bucket").agg(F.min(F.struct("rep", "sid", "n")).alias("c"), F.max("rep").alias("hi"))
    heads = heads.filter(F.col("c.rep") != F.col("hi")).select("bucket", *(F.col(f"c.{c}").alias(f"{c}_c") for c in ("rep", "sid", "n")))
    members = materialize(_meet(keyed, heads), "members")
    wanted = materialize(classes.select("sid", "rep", "set_id").join(members.select("sid").distinct(), "sid", "left_semi"), "wanted")
    texts = docs.select(F.col(key).alias("rep"), F.col(text).alias("text")).join(_few(wanted), "rep")
    sets = materialize(shingled(texts, width), "sets")

    def star(rows: DataFrame) -> DataFrame:
        fits = (F.least("n", "n_c") * 100 >= F.greatest("n", "n_c") * percent) & (F.col("label") != F.col("label_c"))
        return rows.filter(fits).select(F.least("sid", "sid_c").alias("sid_a"), F.greatest("sid", "sid_c").alias("sid_b")).distinct()

    labels, left = None, None
    rows, tried = members.withColumns({"label": F.col("rep"), "label_c": F.col("rep_c")}), None
    while True:
        pairs = star(rows) if tried is None else star(rows).join(tried, ["sid_a", "sid_b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        found = materialize(linked(pairs, sets, percent).distinct(), "links")
        if found.limit(1).count():
            labels = relabelled(labels, found)
        # The members that were no centre, of buckets where these have several labels.
        rest = rows.filter(F.col("sid") != F.col("sid_c")).select("bucket", "sid", "rep", "n")
        if labels is not None:
            rest = rest.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        else:
            rest = rest.withColumn("label", F.col("rep"))
        rest = materialize(rest, "rest")
        heads = rest.groupBy("bucket").agg(F.min(F.struct("label", "sid", "n")).alias("c"), F.max("label").alias("hi"))
        heads = heads.filter(F.col("c.label") != F.col("hi")).select("bucket", *(F.col(f"c.{c}").alias(f"{c}_c") for c in ("label", "sid", "n")))
        rows = materialize(_meet(rest, heads), "rows")
        before, left = left, rows.count()
        if not left:
            return labels
        if before is not None and left > (1 - STAR_SHARE) * before:
            break
    unmet = rows.select("sid", "label").distinct()
    pairs = rare_pairs(materialize(sets.join(unmet, "sid"), "unmet"), percent).join(tried, ["sid_a", "sid_b"], "left_anti")
    found = materialize(linked(materialize(pairs, "pairs"), sets, percent).distinct(), "links")
    return relabelled(labels, found) if found.limit(1).count() else labels


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, width: int = WIDTH, bins: int = BINS, rows: int = ROWS
) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row.

    Null and empty texts have no shingles and are linked with nothing. Rows of
    one key are one document of several texts: links of any of them count, and
    each row is returned. A null key is its own, kept component with a null
    component_id. An empty table gives an empty table.
    """
    signed = materialize(signatures(docs, key, text, width, bins, rows), "signed")
    usable = signed.filter(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    # Equal sets have equal keys, so any row's do. A class goes by the smallest id, which several classes of one id share.
    classes = usable.groupBy("set_id").agg(F.min("id").alias("rep"), F.min("n_shingles").alias("n"), F.any_value("keys").alias("keys"))
    classes = materialize(classes.withColumn("sid", F.monotonically_increasing_id()), "classes")
    labels = class_labels(docs, classes, key, text, percent, width)

    placed = materialize(usable.select("id", "n_shingles", "set_id").join(classes.select("set_id", "rep"), "set_id").drop("set_id"), "placed")
    several = placed.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).filter(F.col("a") != F.col("hi")).select("id", "a")
    ties = materialize(placed.join(several, "id").select("a", F.col("rep").alias("b")).filter("a <> b").distinct(), "ties")
    if ties.limit(1).count():
        labels = relabelled(labels, ties)
    component = F.col("rep")
    if labels is not None:
        placed, component = placed.join(labels.withColumnRenamed("id", "rep"), "rep", "left"), F.coalesce("label", "rep")
    alone = signed.filter(F.col("id").isNull() | (F.col("n_shingles") == 0)).select("id", "n_shingles", F.col("id").alias("component_id"))
    out = placed.select("id", "n_shingles", component.alias("component_id")).union(alone)
    return out.select(
        F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept")
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One row of each component of ``docs``, with its columns: that of the smallest key.

    Of rows with the same key one stays. Rows without a key all stay.
    """
    kept = near_duplicates(docs, key, text, percent).filter(F.col("kept") & F.col(key).isNotNull())
    kept = materialize(kept.groupBy(key).agg(F.count("*").alias("__times")), "kept")
    out = docs.filter(F.col(key).isNull()).unionByName(docs.join(_few(kept.filter("__times = 1").select(key)), key, "left_semi").select(*docs.columns))
    again = kept.filter("__times > 1").select(key)
    if again.limit(1).count():
        out = out.unionByName(docs.join(again, key, "left_semi").select(*docs.columns).dropDuplicates([key]))
    return out
