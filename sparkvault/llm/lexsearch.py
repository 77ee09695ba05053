"""Ranked lexical search by exact inner products over sparse ball trees (operator 11).

A document is a sparse vector of integers, one for each of its terms that some
item asks for; an item is a sparse vector of term weights; a score is their
inner product. Chunks of documents that share their rarest term become ball
trees: nodes halve their documents, grouped by the nearest of a few that are
far from each other, and have a centroid and a radius. An item's product with any document of a node is at most its
product with the centroid plus its norm times the radius. The search takes
nodes best-first and ends where no bound reaches the k-th best score; scores
themselves are 64-bit integers, computed at the leaves.

Bounds are doubles. Radii are enlarged by the largest error that their sums can
have, and bounds by a relative 1e-9, so that rounding prunes nothing; equal
scores are never pruned, as the smaller document id goes first.

Every chunk scores its most promising leaf for every item when it is built.
The k-th best of these scores over all chunks is a score that each item
reaches, and lets the search leave whole trees at their root.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkvault.llm._common import materialize, slices, text_bytes

#: What separates terms, and the bytes of a text with it as a space and A-Z folded.
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
#: Bytes of a text that are counted at once.
TURN_BYTES = 4 << 20
#: Terms (with repeats) of the items that are searched in one pass over the documents; they are broadcast.
ITEM_TERMS = 200_000
#: Documents that a node's own are grouped by.
PIVOTS = 8
#: Documents and vector entries of a tree, documents of a leaf, and documents of a task.
TREE_DOCS, TREE_ENTRIES, LEAF_DOCS, TASK_DOCS = 8_192, 2_000_000, 128, 16_384


def query_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(q long, item, terms array<string>) of the items with a term, written to the shared folder; q numbers the rows."""
    folded = F.translate(F.col(text), UPPER, LOWER)
    terms = F.array_distinct(F.filter(F.split(folded, SEPARATOR), lambda x: x != ""))
    asked = items.select(F.col(key).alias("item"), terms.alias("terms")).filter(F.size("terms") > 0)
    return materialize(asked.select(F.monotonically_increasing_id().alias("q"), "item", "terms"), "query_terms")


def _turns(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a few megabytes at once."""
    folded, first = text.translate(FOLDED), 0
    while first < len(folded):
        last = len(folded) if first + TURN_BYTES >= len(folded) else folded.find(b" ", first + TURN_BYTES)
        last = len(folded) if last < 0 else last
        yield folded[first:last].split()
        first = last


def term_vectors(docs: DataFrame, asked, key: str, text: str) -> DataFrame:
    """(doc long, n long, t array<int>, tf array<long>), written to the shared folder: n terms, and the counts of those asked for.

    ``asked`` is a broadcast dictionary from terms as bytes to their numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = asked.value
        for batch in batches:
            ns, ts, tfs = [], [], []
            for whole in text_bytes(batch, "text"):
                n, found = 0, Counter()
                for terms in _turns(whole or b""):
                    n += len(terms)
                    counted = Counter(terms)
                    for term in counted.keys() & number.keys() if len(counted) > len(number) else [x for x in counted if x in number]:
                        found[number[term]] += counted[term]
                ns.append(n)
                ts.append(sorted(found))
                tfs.append([found[t] for t in ts[-1]])
            yield pa.record_batch(
                {"doc": batch.column("doc"), "n": pa.array(ns, pa.int64()), "t": pa.array(ts, pa.list_(pa.int32())), "tf": pa.array(tfs, pa.list_(pa.int64()))}
            )

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, "doc long, n long, t array<int>, tf array<long>"), "term_vectors")


@dataclass
class Shape:
    """The nodes of a tree over ``n`` documents in tree order; node 0 is the root, parents come before children."""

    first: np.ndarray
    last: np.ndarray
    left: np.ndarray  # the left child; 0 for a leaf; the right one follows it
    level: np.ndarray


def shape(n: int, leaf_docs: int = LEAF_DOCS) -> Shape:
    first, last, left, level = [0], [n], [], [0]
    while (i := len(left)) < len(first):
        if last[i] - first[i] <= leaf_docs:
            left.append(0)
            continue
        left.append(len(first))
        middle = (first[i] + last[i]) // 2
        first += [first[i], middle]
        last += [middle, last[i]]
        level += [level[i] + 1] * 2
    return Shape(*(np.array(x, np.int64) for x in (first, last, left, level)))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run of ``sizes``, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Tree:
    """A chunk's documents in tree order: ids, entries (term, value) of each, the nodes, their centroids and radii."""

    def __init__(self, ids: list[int | None], ends: np.ndarray, terms: np.ndarray, values: np.ndarray, leaf_docs: int = LEAF_DOCS):
        self.ids, self.starts, self.values = ids, np.concatenate([[0], ends[:-1]]).astype(np.int64), values
        self.sizes = np.diff(ends, prepend=0)
        self.terms, self.local = np.unique(terms, return_inverse=True)
        self.nodes = shape(len(ids), leaf_docs)
        self.asked = np.zeros(len(self.terms), np.int64)  # an item's weights, while it is searched

    def order(self) -> np.ndarray:
        """An order of the documents for the nodes: each node's own are grouped by the nearest of a few far ones of them."""
        order, nodes = np.arange(len(self.ids)), self.nodes
        norms = np.add.reduceat(self.values.astype(np.float64) ** 2, self.starts)
        dense = np.zeros(len(self.terms))

        def distances(docs: np.ndarray, at: np.ndarray, firsts: np.ndarray, pivot: int) -> np.ndarray:
            own = slice(self.starts[pivot], self.starts[pivot] + self.sizes[pivot])
            dense[self.local[own]] = self.values[own]
            products = np.add.reduceat(self.values[at] * dense[self.local[at]], firsts)
            dense[self.local[own]] = 0
            return norms[docs] - 2 * products + norms[pivot]

        for node in np.flatnonzero(nodes.left):
            docs = order[nodes.first[node] : nodes.last[node]]
            at = _spread(self.starts[docs], self.sizes[docs])
            firsts = np.cumsum(self.sizes[docs]) - self.sizes[docs]
            near = distances(docs, at, firsts, docs[distances(docs, at, firsts, docs[0]).argmax()])
            group, spread = np.zeros(len(docs), np.int64), near.max()
            for g in range(1, PIVOTS):
                if 2 * near.max() <= spread:  # more would part what belongs together
                    break
                other = distances(docs, at, firsts, docs[near.argmax()])
                group[other < near] = g
                near = np.minimum(near, other)
            order[nodes.first[node] : nodes.last[node]] = docs[np.lexsort((near, group))]
        return order

    def open(self) -> Tree:
        """The centroids, kept by term, and the radii."""
        nodes, n_terms = self.nodes, max(1, len(self.terms))
        exact = self.values.astype(np.float64)
        norms = np.add.reduceat(exact**2, self.starts)
        self.radius = np.zeros(len(nodes.first))
        keys, means = [], []
        for level in range(int(nodes.level.max()) + 1):
            own = np.flatnonzero((nodes.level == level) | ((nodes.left == 0) & (nodes.level < level)))  # they cover all documents
            own = own[np.argsort(nodes.first[own])]
            count = nodes.last[own] - nodes.first[own]
            of_entry = np.repeat(np.repeat(own, count), self.sizes)
            key, place = np.unique(of_entry * n_terms + self.local, return_inverse=True)
            mean = np.bincount(place, weights=exact) / (nodes.last - nodes.first)[key // n_terms]
            centre = np.bincount(key // n_terms, weights=mean**2, minlength=len(nodes.first))
            products = np.add.reduceat(exact * mean[place], self.starts)
            of_doc = np.repeat(own, count)
            width = np.bincount(key // n_terms, minlength=len(nodes.first))[of_doc] + self.sizes + 8
            square = norms - 2 * products + centre[of_doc]
            wrong = width * 2.0**-52 * (norms + 2 * products + centre[of_doc])
            farthest = np.zeros(len(nodes.first))
            np.maximum.at(farthest, of_doc, np.maximum(square, 0) + wrong)
            new = nodes.level[own] == level
            self.radius[own[new]] = np.sqrt(farthest[own[new]]) * (1 + 1e-12)
            there = nodes.level[key // n_terms] == level
            keys.append(key[there])
            means.append(mean[there])
        key, mean = np.concatenate(keys), np.concatenate(means)
        by_term = np.argsort(key % n_terms, kind="stable")
        self.node_of, self.mean = (key // n_terms)[by_term], mean[by_term]
        self.term_ends = np.cumsum(np.bincount(key % n_terms, minlength=n_terms))
        return self

    def known(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places and weights of those terms of an item that this chunk has."""
        at = np.searchsorted(self.terms, terms)
        there = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)
        return at[there], weights[there]

    def bounds(self, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """An upper bound of the item's scores in every node."""
        starts = np.where(at > 0, self.term_ends[at - 1], 0)
        sizes = self.term_ends[at] - starts
        entries = _spread(starts, sizes)
        products = np.bincount(self.node_of[entries], weights=self.mean[entries] * np.repeat(weights, sizes), minlength=len(self.radius))
        norm = math.sqrt(float((weights.astype(np.float64) ** 2).sum()))
        return (products + norm * self.radius) * (1 + 1e-9)

    def scores(self, node: int) -> np.ndarray:
        """The exact scores of a leaf's documents, for the weights in ``asked``."""
        first, last = self.nodes.first[node], self.nodes.last[node]
        entries = slice(self.starts[first], self.starts[last - 1] + self.sizes[last - 1])
        return np.add.reduceat(self.values[entries] * self.asked[self.local[entries]], self.starts[first:last] - self.starts[first])

    def promising(self, at: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
        """The best scores of one leaf, reached by going to the better child each time."""
        bound, node = self.bounds(at, weights), 0
        while left := self.nodes.left[node]:
            node = left if bound[left] >= bound[left + 1] else left + 1
        self.asked[at] = weights
        scores = self.scores(node)
        self.asked[at] = 0
        return -np.sort(-scores[scores > 0])[:k]

    def best(self, at: np.ndarray, weights: np.ndarray, k: int, least: int) -> list[tuple[int, int | None]]:
        """The (score, id) of the k best documents from a score of ``least`` on, best first."""
        bound = self.bounds(at, weights)
        self.asked[at] = weights
        heap, found = [(-bound[0], 0)], []
        while heap and -heap[0][0] >= least:
            above, node = heapq.heappop(heap)
            if left := int(self.nodes.left[node]):
                for child in (left, left + 1):
                    heapq.heappush(heap, (max(above, -bound[child]), child))
                continue
            scores = self.scores(node)
            for i in np.flatnonzero(scores >= least).tolist():
                found.append((int(scores[i]), self.ids[self.nodes.first[node] + i]))
            if len(found) >= k:
                found = heapq.nsmallest(k, found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))
                least = max(least, found[-1][0])
        self.asked[at] = 0
        return sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))[:k]


def _weighted(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


Items = list[tuple[int, np.ndarray, np.ndarray]]  # (q, sorted term numbers, their weights)

TREES = "ids array<long>, ends array<int>, terms array<int>, values array<int>, seeds array<struct<q:long,score:long>>"


def _plant(items, n_docs: int, all_terms: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Trees of the documents of a partition, with the scores of their most promising leaves."""

    def planted(table: pa.Table) -> pa.RecordBatch:
        m = np.array([10 + 90 * n * n_docs // all_terms for n in table.column("n").to_pylist()], np.int64)
        t, tf = table.column("t").combine_chunks(), table.column("tf").combine_chunks()
        sizes = np.diff(t.offsets.to_numpy())
        terms, values = t.flatten().to_numpy(), _weighted(tf.flatten().to_numpy(), np.repeat(m, sizes))
        ids = table.column("doc").to_pylist()
        order = Tree(ids, np.cumsum(sizes), terms, values).order()
        at = _spread((np.cumsum(sizes) - sizes)[order], sizes[order])
        ends, terms, values = np.cumsum(sizes[order]), terms[at], values[at]
        tree = Tree([ids[i] for i in order.tolist()], ends, terms, values).open()
        seeds = []
        for q, asked, weights in items.value:
            known = tree.known(asked, weights)
            if len(known[0]):
                seeds += [{"q": q, "score": int(s)} for s in tree.promising(*known, k)]
        columns = {"ids": tree.ids, "ends": ends, "terms": terms, "values": values, "seeds": seeds}
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.struct([("q", pa.int64()), ("score", pa.int64())]))
        return pa.record_batch({c: pa.array([v], pa.list_(kind)) for (c, v), kind in zip(columns.items(), kinds, strict=True)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, entries = [], 0, 0
        for batch in batches:
            sizes = [n + TREE_ENTRIES // TREE_DOCS for n in np.diff(batch.column("t").offsets.to_numpy()).tolist()]
            for first, last in slices(sizes, TREE_ENTRIES // 4):
                if held and (docs + last - first > TREE_DOCS or entries + sum(sizes[first:last]) > 2 * TREE_ENTRIES):
                    yield planted(pa.Table.from_batches(held))
                    held, docs, entries = [], 0, 0
                held.append(batch.slice(first, last - first))
                docs, entries = docs + last - first, entries + sum(sizes[first:last])
        if held:
            yield planted(pa.Table.from_batches(held))

    return run


def _seek(items, least, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, ends, terms, values = (batch.column(c)[row].values for c in ("ids", "ends", "terms", "values"))
                tree = Tree(ids.to_pylist(), ends.to_numpy().astype(np.int64), terms.to_numpy(), values.to_numpy().astype(np.int64)).open()
                out: list[tuple[int, int | None, int]] = []
                for q, asked, weights in items.value:
                    at, own = tree.known(asked, weights)
                    if len(at):
                        out += [(q, doc, score) for score, doc in tree.best(at, own, k, least.value.get(q, 1))]
                if out:
                    columns = zip(("q", "doc", "score"), zip(*out, strict=True), strict=True)
                    yield pa.record_batch({name: pa.array(column, pa.int64()) for name, column in columns})

    return run


def _search_pass(docs: DataFrame, asked: list, k: int, key: str, text: str) -> DataFrame:
    """(q, doc, score): each tree's best documents for each of the ``asked`` items."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    number = {t: i for i, t in enumerate(sorted({t for r in asked for t in r["terms"]}))}
    vectors = term_vectors(docs, share({t.encode(): i for t, i in number.items()}), key, text)
    sums = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms"), F.count_if(F.size("t") > 0).alias("rows")).first()
    n_docs, all_terms, rows = sums["docs"], sums["terms"] or 0, sums["rows"]
    df = {r["t"]: r["df"] for r in vectors.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}  # as many rows as terms asked for
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    items: Items = []
    for r in asked:
        terms = sorted(number[t] for t in r["terms"] if number[t] in weight)
        items.append((r["q"], np.array(terms, np.int32), np.array([weight[t] for t in terms], np.int64)))
    rarest = share(np.array([weight.get(t, 0) for t in range(len(number))], np.int64))

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, weights = batch.column("t"), rarest.value
            terms = lists.flatten().to_numpy()
            starts = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
            lead = np.maximum.reduceat(weights[terms] * len(weights) + terms, starts) % len(weights) if len(starts) else starts
            yield batch.append_column("lead", pa.array(lead, pa.int32()))

    parts = max(1, math.ceil(rows / TASK_DOCS))
    near = vectors.filter(F.size("t") > 0).mapInArrow(led, "doc long, n long, t array<int>, tf array<long>, lead int")
    near = near.repartitionByRange(parts, "lead", F.xxhash64("doc"))
    shared = share(items)
    trees = materialize(near.mapInArrow(_plant(shared, n_docs, all_terms, k), TREES), "ball_trees")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    seeds = trees.select(F.explode("seeds").alias("s")).select("s.q", "s.score").withColumn("place", place)
    reached = {r["q"]: r["score"] for r in seeds.filter(F.col("place") <= k).filter(F.col("place") == k).collect()}  # a row for each of the items
    return trees.mapInArrow(_seek(shared, share(reached), k), "q long, doc long, score long")


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item_id, rank int from 1, doc_id, score): each item's k highest-scoring documents with a score above 0.

    Equal scores are ranked by document id, null ids last. Null and empty
    texts have no terms; an item without terms, or whose terms no document
    has, gives no row. Rows that repeat a document are documents each, rows
    that repeat an item are searched each. Other columns play no part, and an
    empty table gives an empty one.

    Items are searched in blocks of about ``ITEM_TERMS`` terms, with a pass
    over the documents for each block.
    """
    asked = query_terms(items, item_key, item_text)
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(total / ITEM_TERMS))
    found = None
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).select("q", "terms").collect()  # about ITEM_TERMS terms
        part = _search_pass(docs, own, k, key, text)
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    best = found.withColumn("rank", place).filter(F.col("rank") <= k)
    return best.join(asked.select("q", "item"), "q").select(F.col("item").alias(item_key), "rank", F.col("doc").alias(key), "score")
