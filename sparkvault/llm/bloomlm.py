"""Language-model scoring with a log-frequency Bloom filter (operator 13).

Texts are coded in blocks: the distinct words, and a code for every token.
Unigram counts are exact and come from a table of words in parts of bounded
size; blocks send a part their words as one message, and get their counts. The counts of longer
n-grams are quantised to powers of two and live in a Bloom filter alone: an
n-gram of level j (2^(j-1) to 2^j - 1 occurrences) is inserted as the items
(n-gram, 1) ... (n-gram, j), and read back by asking for level after level
until one is not there. A false positive makes a count larger, each further
level with a probability of the filter's error rate.

The filter is a row of shards, each with about the same number of training
tokens, so that it grows with the corpus and no shard does. Up to
``BROADCAST_BYTES`` it is broadcast and every task probes all of it; a larger
one stays in shards, the blocks send their distinct n-grams to them as
sorted fingerprints, and the levels come back. Where the blocks that are scored
are those that are learned from, each n-gram is sent once: with its count, and
a shard answers from the filter that it makes of these. All ways give the same
scores.

The probability of a token is interpolated from the exact add-one unigram over
two and three tokens: p = (count + mass * lower) / (context + mass), where a
count is never taken as more than its parts' counts. As counts are quantised,
the probabilities of all words add up to one only nearly.

N-grams are known by 48-bit fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkvault.llm._common import give_back, materialize, mix64, slices

#: Bytes of text and rows of a block.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 100_000
#: Training tokens for each shard of the filter.
SHARD_TOKENS = 1_500_000
#: Distinct words of all blocks for each part of the table of words.
PART_WORDS = 1_000_000
#: Size up to which the filter is broadcast.
BROADCAST_BYTES = 64 << 20
#: Hash functions of the filter: an item that is not there is found with a probability of 2^-HASHES.
HASHES = 8
#: Tokens that a context counts for the shorter n-gram.
MASS = 4.0
#: Bits of an n-gram's fingerprint.
FINGERPRINT = 48
#: Stand-ins for the begin of a text and its end, as words they cannot be.
BEGIN, END = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _squeezed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(numbers, "<u8").view(np.uint8).reshape(-1, 8).T
    used = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(planes[:used].tobytes())


def _unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def _sorted_squeezed(numbers: np.ndarray) -> bytes:
    return _squeezed(np.diff(numbers, prepend=np.uint64(0)))


def _sorted_unsqueezed(data: bytes) -> np.ndarray:
    return np.cumsum(_unsqueezed(data), dtype=np.uint64)


def _joined(words: list[bytes]) -> bytes:
    """Words, which have no line ends, as one compressed message."""
    return zstandard.ZstdCompressor(level=3).compress(b"\n".join(words))


def _split(data: bytes) -> list[bytes]:
    """The words of a message; none is empty."""
    whole = zstandard.ZstdDecompressor().decompress(data)
    return whole.split(b"\n") if whole else []


def _word_parts(words: list[bytes], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes by part, the parts there are, where each begins among the codes)."""
    part = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    return order, *np.unique(part[order], return_index=True)


def code_blocks(docs: DataFrame, learn: Column, key: str, text: str) -> DataFrame:
    """The coded blocks, written to the shared folder; null texts are empty.

    (block, keys array, learn array<boolean>, n_words, codes, n_distinct, words,
    seen): a block's words by code, as a message, and how often each occurs in
    the block's learning rows.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = pc.binary_length(batch.column("text")).to_pylist()
            for first, last in slices([n + BLOCK_BYTES // BLOCK_ROWS for n in lengths], BLOCK_BYTES):
                part = batch.slice(first, last - first)
                # Lowered before the cast: of a slice that was cast, pyarrow 23 lowers other bytes.
                split = pc.ascii_split_whitespace(pc.ascii_lower(part.column("text")).cast(pa.large_string()))
                tokens = split.flatten()
                there = pc.not_equal(tokens, "")
                owner = np.repeat(np.arange(last - first), pc.list_value_length(split).to_numpy())[there.to_numpy(zero_copy_only=False)]
                coded = tokens.filter(there).dictionary_encode()
                codes = coded.indices.to_numpy().astype(np.int64)
                learns = part.column("learn").to_numpy(zero_copy_only=False)
                seen = np.bincount(codes[learns[owner]], minlength=len(coded.dictionary))
                columns = {
                    "block": pa.array([block], pa.int64()),
                    "keys": pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), part.column("key")),
                    "learn": pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), part.column("learn")),
                    "n_words": pa.array([_squeezed(np.bincount(owner, minlength=last - first))], pa.binary()),
                    "codes": pa.array([_squeezed(codes)], pa.binary()),
                    "n_distinct": pa.array([len(seen)], pa.int64()),
                    "words": pa.array([_joined(coded.dictionary.cast(pa.large_binary()).to_pylist())], pa.binary()),
                    "seen": pa.array([_squeezed(seen)], pa.binary()),
                }
                yield pa.record_batch(columns)
                block += 1
                del split, tokens, coded, columns
            give_back()

    kind = rows.schema["key"].dataType.simpleString()
    schema = f"block long, keys array<{kind}>, learn array<boolean>, n_words binary, codes binary, n_distinct long, words binary, seen binary"
    return materialize(rows.mapInArrow(run, schema), "lm_blocks")


@dataclass
class Tokens:
    """A block's tokens, one after the other, each text ended by an end token."""

    code: np.ndarray  # the word's code; the number of words for an end
    first: np.ndarray  # where each text starts
    hashes: np.ndarray  # by code; the last two are the end's and the begin's
    before: np.ndarray  # the code before each token
    pair: np.ndarray  # 64-bit hash of each token and the one before it
    triple: np.ndarray  # and of the one before that; only where ``deep``
    deep: np.ndarray  # whether a token is not the first of its text

    def fingerprints(self, where: np.ndarray | None = None) -> np.ndarray:
        """Those of all pairs and of all triples, in this order, at the tokens ``where``."""
        pair, triple = (self.pair, self.triple[self.deep]) if where is None else (self.pair[where], self.triple[where & self.deep])
        return np.concatenate([pair, triple]) >> np.uint64(64 - FINGERPRINT)


def _tokens(words: list[bytes], n_words: np.ndarray, codes: np.ndarray) -> Tokens:
    end, begin = len(words), len(words) + 1
    last = np.cumsum(n_words.astype(np.int64) + 1) - 1  # of the end tokens
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    code = np.full(len(codes) + len(last), end, np.int64)
    inner = np.ones(len(code), bool)
    inner[last] = False
    code[inner] = codes
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    hashes = np.concatenate([hashes, np.array([END, BEGIN], np.uint64)])
    before = np.roll(code, 1)
    before[first] = begin
    of = hashes[code]
    pair = mix64(mix64(hashes[before]) + of)
    triple = mix64(np.roll(pair, 1) + of)
    deep = np.ones(len(code), bool)
    deep[first] = False
    return Tokens(code, first, hashes, before, pair, triple, deep)


def _shard(fingerprints: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each fingerprint; growing with it, so that sorted fingerprints are in the order of their shards."""
    return ((fingerprints >> np.uint64(FINGERPRINT - 31)) * np.uint64(shards)) >> np.uint64(31)


def _parts(fingerprints: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """(shard, run) of sorted fingerprints."""
    ends = np.searchsorted(_shard(fingerprints, shards), np.arange(shards), side="right")
    first = 0
    for shard, last in enumerate(ends.tolist()):
        if last > first:
            yield shard, slice(first, last)
        first = last


def _place(fingerprints: np.ndarray, level: int, j: int, bits: np.ndarray | np.uint64) -> np.ndarray:
    """Where hash function ``j`` puts the item (fingerprint, level) among ``bits``."""
    return mix64(fingerprints ^ np.uint64((level * 64 + j + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) % bits


def filter_bits(fingerprints: np.ndarray, counts: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """A shard's filter over distinct fingerprints, as bytes; half of its bits are set."""
    levels = np.frexp(counts.astype(np.float64))[1]
    size = max(64, -(-math.ceil(int(levels.sum()) * hashes / math.log(2)) // 64) * 64)
    bits = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        own = fingerprints[levels >= level]
        for j in range(hashes):
            bits[_place(own, level, j, np.uint64(size))] = True
    return np.packbits(bits)


@dataclass
class Filter:
    """Shards of a filter, one after the other."""

    bytes_: np.ndarray
    starts: np.ndarray  # the byte where each shard starts
    bits: np.ndarray  # the bits of each
    hashes: int = HASHES

    def levels(self, fingerprints: np.ndarray, shard: np.ndarray | int = 0) -> np.ndarray:
        """The level of each fingerprint: how many levels on end are found."""
        out, alive, level = np.zeros(len(fingerprints), np.uint8), np.arange(len(fingerprints)), 1
        shard = np.broadcast_to(shard, len(fingerprints))
        while len(alive) and level < 255:
            for j in range(self.hashes):
                own = shard[alive]
                at = _place(fingerprints[alive], level, j, self.bits[own]).astype(np.int64)
                alive = alive[(self.bytes_[self.starts[own] + (at >> 3)] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
            out[alive] = level
            level += 1
        return out


def _count_messages(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A block's n-gram counts of its learning texts, for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tokens, learn = _of_row(batch, row)
                sizes = np.diff(tokens.first, append=len(tokens.code))
                found, counts = np.unique(tokens.fingerprints(np.repeat(learn, sizes)), return_counts=True)
                sent = [(s, _sorted_squeezed(found[run_]), _squeezed(counts[run_])) for s, run_ in _parts(found, shards)]
                if sent:
                    shard, prints, numbers = zip(*sent, strict=True)
                    yield pa.record_batch({"shard": pa.array(shard, pa.int64()), "prints": pa.array(prints, pa.binary()), "counts": pa.array(numbers, pa.binary())})
                del tokens, found, counts, sent
            give_back()

    return run


def _of_row(batch: pa.RecordBatch, row: int) -> tuple[Tokens, np.ndarray]:
    words = _split(batch.column("words")[row].as_py())
    n_words, codes = (_unsqueezed(batch.column(c)[row].as_py()).astype(np.int64) for c in ("n_words", "codes"))
    return _tokens(words, n_words, codes), np.array(batch.column("learn")[row].as_py(), bool)


def _word_messages(parts: int, asked: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A block's distinct words for each part of the table of words: those learned from with their counts, or all, to be ``asked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words, seen = _split(batch.column("words")[row].as_py()), None
                if not asked:
                    seen = _unsqueezed(batch.column("seen")[row].as_py())
                    words, seen = [w for w, n in zip(words, seen.tolist(), strict=True) if n], seen[seen > 0]
                order, found, firsts = _word_parts(words, parts)
                if not len(order):
                    continue
                runs = np.split(order, firsts[1:])
                out = {"part": pa.array(found.astype(np.int64)), "words": pa.array([_joined([words[i] for i in r.tolist()]) for r in runs], pa.binary())}
                if asked:
                    out["block"] = pa.array([batch.column("block")[row].as_py()] * len(runs), pa.int64())
                else:
                    out["seen"] = pa.array([_squeezed(seen[r]) for r in runs], pa.binary())
                yield pa.record_batch(out)
                del words, seen, order, runs, out
            give_back()

    return run


def _words_of(messages: pa.ChunkedArray) -> tuple[pa.ChunkedArray, list[int]]:
    """The words of some messages, one after the other, and where each message's end."""
    arrays = [pa.array(_split(x.as_py()), pa.large_binary()) for x in messages]
    return pa.chunked_array(arrays, pa.large_binary()), np.cumsum([len(a) for a in arrays]).tolist()


def _count_words(table: pa.Table) -> pa.Table:
    """A part of the table of words: each word once, with its count."""
    words, _ = _words_of(table.column("words"))
    coded = words.combine_chunks().dictionary_encode()
    counts = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(counts, coded.indices.to_numpy(), np.concatenate([_unsqueezed(x.as_py()) for x in table.column("seen")]).astype(np.int64))
    out = {"words": _joined(coded.dictionary.to_pylist()), "counts": _squeezed(counts)}
    sums = {"n_words": int(counts.sum()), "n_types": len(counts)}
    del words, coded, counts
    give_back()
    return pa.table({"part": table.column("part").slice(0, 1)} | {k: pa.array([v], pa.binary()) for k, v in out.items()} | {k: pa.array([v], pa.int64()) for k, v in sums.items()})


def _answer_words(asked: pa.Table, held: pa.Table) -> pa.Table:
    """The counts of the words that the blocks ask one part."""
    words, ends = _words_of(asked.column("words"))
    counts = np.zeros(len(words), np.int64)
    if held.num_rows:
        known = pa.array(_split(held.column("words")[0].as_py()), pa.large_binary())
        at = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()
        counts[at >= 0] = _unsqueezed(held.column("counts")[0].as_py()).astype(np.int64)[at[at >= 0]]
        del known, at
    out = pa.array([_squeezed(c) for c in np.split(counts, ends[:-1])] if ends else [], pa.binary())
    del words, counts
    give_back()
    return pa.table({"block": asked.column("block"), "part": asked.column("part"), "counts": out})


def _merged_bits(table: pa.Table, hashes: int) -> np.ndarray:
    """The filter of a shard from what the blocks send; n-grams that no learning text has are left out."""
    prints = np.concatenate([_sorted_unsqueezed(x.as_py()) for x in table.column("prints")])
    counts = np.concatenate([_unsqueezed(x.as_py()) for x in table.column("counts")]).astype(np.int64)
    prints, counts = prints[counts > 0], counts[counts > 0]
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    firsts = np.flatnonzero(np.diff(prints, prepend=prints[:1] ^ np.uint64(1)))
    return filter_bits(prints[firsts], np.add.reduceat(counts, firsts) if len(firsts) else counts, hashes)


def _filter_shard(hashes: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        bits = _merged_bits(table, hashes)
        out = pa.table({"shard": table.column("shard").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})
        del bits
        give_back()
        return out

    return run


@dataclass
class Model:
    """What a corpus leaves: word counts and the filter as tables, and five numbers."""

    counts: DataFrame  # (part long, words binary, counts binary), words that the corpus has
    n_parts: int
    shards: DataFrame | None  # (shard long, bits binary); none where the filter is made as the blocks ask it
    n_shards: int
    filter_bytes: int  # without a filter, the most that it can have
    n_tokens: int
    n_types: int
    n_texts: int
    hashes: int


def count_blocks(blocks: DataFrame, hashes: int = HASHES, shard_tokens: int = SHARD_TOKENS) -> Model:
    """The model of the learning rows of coded blocks, without its filter; the table of words is in the shared folder."""
    n_parts = max(1, math.ceil((blocks.agg(F.sum("n_distinct")).first()[0] or 0) / PART_WORDS))
    sent = blocks.select("words", "seen").mapInArrow(_word_messages(n_parts, False), "part long, words binary, seen binary")
    schema = "part long, words binary, counts binary, n_words long, n_types long"
    counts = materialize(sent.groupBy("part").applyInArrow(_count_words, schema), "lm_counts")
    n_words, n_types = counts.agg(F.sum("n_words"), F.coalesce(F.sum("n_types"), F.lit(0))).first()
    n_texts = blocks.select(F.sum(F.size(F.filter("learn", lambda x: x)).cast("long"))).first()[0] or 0
    n_tokens = (n_words or 0) + n_texts
    n_shards = max(1, math.ceil(n_tokens / shard_tokens))
    # An n-gram has no more levels than occurrences, and a text no more pairs or triples than tokens.
    most = math.ceil(2 * n_tokens * hashes / math.log(2) / 8) + 8 * n_shards
    return Model(counts.drop("n_words", "n_types"), n_parts, None, n_shards, most, n_tokens, n_types + (n_texts > 0), n_texts, hashes)


def fit_blocks(blocks: DataFrame, hashes: int = HASHES, shard_tokens: int = SHARD_TOKENS) -> Model:
    """The model of the learning rows of coded blocks; its tables are in the shared folder."""
    return _filtered(blocks, count_blocks(blocks, hashes, shard_tokens))


def _filtered(blocks: DataFrame, model: Model) -> Model:
    """``model`` with the table of its filter."""
    sent = blocks.select("learn", "n_words", "codes", "words").mapInArrow(_count_messages(model.n_shards), "shard long, prints binary, counts binary")
    shards = materialize(sent.groupBy("shard").applyInArrow(_filter_shard(model.hashes), "shard long, bits binary"), "lm_filter")
    return replace(model, shards=shards, filter_bytes=shards.agg(F.sum(F.octet_length("bits"))).first()[0] or 0)


def _expected(levels: np.ndarray) -> np.ndarray:
    """The mean of the counts that have a level."""
    return np.where(levels > 0, (2.0 ** (levels.astype(np.float64) - 1) + 2.0 ** levels.astype(np.float64) - 1) / 2, 0.0)


def _scores(tokens: Tokens, c: np.ndarray, levels: np.ndarray, n_tokens: int, n_types: int, n_texts: int, mass: float) -> dict[str, np.ndarray]:
    """Each text's numbers of tokens and of known ones, its base score and its score.

    ``c`` holds the counts by word code, ``levels`` the filter's answers in the order of the fingerprints.
    """
    c = np.concatenate([c, [n_texts, n_texts]]).astype(np.float64)
    own, before = c[tokens.code], c[tokens.before]
    one = (own + 1) / (n_tokens + n_types + 1)
    n = len(tokens.code)
    pairs = np.minimum(_expected(levels[:n]), np.minimum(own, before))
    two = (pairs + mass * one) / (before + mass)
    context = np.roll(pairs, 1)[tokens.deep]
    triples = np.minimum(_expected(levels[n:]), np.minimum(context, pairs[tokens.deep]))
    best = two.copy()
    best[tokens.deep] = (triples + mass * two[tokens.deep]) / (context + mass)
    add = lambda x: np.add.reduceat(x, tokens.first)
    return {
        "n_tokens": np.diff(tokens.first, append=n),
        "n_known": add((own > 0).astype(np.int64)),
        "base_score": add(np.log10(one)),
        "score": add(np.log10(best)),
    }


def _ask(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A block's distinct n-grams, for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tokens, _ = _of_row(batch, row)
                found = np.unique(tokens.fingerprints())
                sent = [(s, _sorted_squeezed(found[run_])) for s, run_ in _parts(found, shards)]
                shard, prints = zip(*sent, strict=True)
                block = pa.array([batch.column("block")[row].as_py()] * len(sent), pa.int64())
                yield pa.record_batch({"block": block, "shard": pa.array(shard, pa.int64()), "prints": pa.array(prints, pa.binary())})
                del tokens, found, sent
            give_back()

    return run


def _answer(hashes: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The levels of what the blocks ask one shard."""

    def run(asked: pa.Table, shard: pa.Table) -> pa.Table:
        levels = []
        own = np.frombuffer(shard.column("bits")[0].as_py(), np.uint8) if shard.num_rows else None
        held = None if own is None else Filter(own, np.zeros(1, np.int64), np.array([len(own) * 8], np.uint64), hashes)
        for x in asked.column("prints"):
            prints = _sorted_unsqueezed(x.as_py())
            levels.append(_squeezed(held.levels(prints) if held else np.zeros(len(prints), np.uint8)))
        return pa.table({"block": asked.column("block"), "shard": asked.column("shard"), "levels": pa.array(levels, pa.binary())})

    return run


def _ask_counted(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A block's distinct n-grams with their counts in its learning texts, for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tokens, learn = _of_row(batch, row)
                learns = np.repeat(learn, np.diff(tokens.first, append=len(tokens.code)))
                found, place = np.unique(tokens.fingerprints(), return_inverse=True)
                counts = np.bincount(place[np.concatenate([learns, learns[tokens.deep]])], minlength=len(found))
                sent = [(s, _sorted_squeezed(found[run_]), _squeezed(counts[run_])) for s, run_ in _parts(found, shards)]
                shard, prints, numbers = zip(*sent, strict=True)
                block = pa.array([batch.column("block")[row].as_py()] * len(sent), pa.int64())
                yield pa.record_batch({"block": block, "shard": pa.array(shard, pa.int64()), "prints": pa.array(prints, pa.binary()), "counts": pa.array(numbers, pa.binary())})
                del tokens, found, place, counts, sent
            give_back()

    return run


def _answer_counted(hashes: int) -> Callable[[pa.Table], pa.Table]:
    """The levels of what the blocks ask one shard, whose filter is of the counts that they send."""

    def run(asked: pa.Table) -> pa.Table:
        bits = _merged_bits(asked, hashes)
        held = Filter(bits, np.zeros(1, np.int64), np.array([len(bits) * 8], np.uint64), hashes)
        levels = [_squeezed(held.levels(_sorted_unsqueezed(x.as_py()))) for x in asked.column("prints")]
        out = pa.table({"block": asked.column("block"), "shard": asked.column("shard"), "levels": pa.array(levels, pa.binary())})
        del bits, held, levels
        give_back()
        return out

    return run


def _score_block(model: tuple[int, int, int], n_parts: int, n_shards: int, held, mass: float, kind: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores a block from its words' counts, and the broadcast filter or the shards' answers."""

    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        names = ("n_tokens", "n_known", "base_score", "score")
        out = {"key": pa.array([], kind)} | {c: pa.array([], pa.int64() if i < 2 else pa.float64()) for i, c in enumerate(names)}
        if block.num_rows:
            batch = block.combine_chunks().to_batches()[0]
            tokens, _ = _of_row(batch, 0)
            c = np.zeros(len(tokens.hashes) - 2, np.int64)
            of_words = known.filter(pc.is_valid(known.column("part"))).sort_by("part").column("counts")
            if len(of_words):
                order, _, _ = _word_parts(_split(batch.column("words")[0].as_py()), n_parts)
                c[order] = np.concatenate([_unsqueezed(x.as_py()) for x in of_words]).astype(np.int64)
            found, place = np.unique(tokens.fingerprints(), return_inverse=True)
            if held is not None:
                levels = held.value.levels(found, _shard(found, n_shards).astype(np.int64))
            else:
                answers = known.filter(pc.is_valid(known.column("shard"))).sort_by("shard").column("levels")
                levels = np.concatenate([_unsqueezed(x.as_py()) for x in answers])
            scores = _scores(tokens, c, levels[place], *model, mass)
            out = {"key": batch.column("keys")[0].values} | {n: pa.array(scores[n], out[n].type) for n in names}
        give_back()
        return pa.table(out)

    return run


def score_blocks(blocks: DataFrame, model: Model, mass: float = MASS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, n_tokens, n_known, base_score, score) of every text of coded blocks.

    A model without a filter must be of the same blocks.
    """
    asked = blocks.select("block", "words").mapInArrow(_word_messages(model.n_parts, True), "part long, words binary, block long")
    known = asked.groupBy("part").cogroup(model.counts.groupBy("part")).applyInArrow(_answer_words, "block long, part long, counts binary")
    none = {c: F.lit(None).cast(k) for c, k in (("part", "long"), ("counts", "binary"), ("shard", "long"), ("levels", "binary"))}
    known = known.select(F.col("block").alias("of"), "part", "counts", none["shard"].alias("shard"), none["levels"].alias("levels"))
    held = None
    if model.shards is not None and model.filter_bytes <= broadcast_bytes:
        rows = {r["shard"]: np.frombuffer(r["bits"], np.uint8) for r in model.shards.collect()}  # filter_bytes at most
        sizes = np.array([len(rows.get(s, b"")) for s in range(model.n_shards)], np.int64)
        # A shard without n-grams has one byte of zeros.
        parts = [rows.get(s, np.zeros(1, np.uint8)) for s in range(model.n_shards)]
        starts = np.cumsum(np.maximum(sizes, 1)) - np.maximum(sizes, 1)
        whole = Filter(np.concatenate(parts), starts, (np.maximum(sizes, 1) * 8).astype(np.uint64), model.hashes)
        held = blocks.sparkSession.sparkContext.broadcast(whole)
    else:
        own = blocks.select("block", "n_words", "codes", "words", "learn")
        if model.shards is None:
            sent = own.mapInArrow(_ask_counted(model.n_shards), "block long, shard long, prints binary, counts binary")
            answers = sent.groupBy("shard").applyInArrow(_answer_counted(model.hashes), "block long, shard long, levels binary")
        else:
            sent = own.mapInArrow(_ask(model.n_shards), "block long, shard long, prints binary")
            answers = sent.groupBy("shard").cogroup(model.shards.groupBy("shard")).applyInArrow(_answer(model.hashes), "block long, shard long, levels binary")
        known = known.unionByName(answers.select(F.col("block").alias("of"), none["part"].alias("part"), none["counts"].alias("counts"), "shard", "levels"))
    of_key = blocks.schema["keys"].dataType.elementType
    run = _score_block((model.n_tokens, model.n_types, model.n_texts), model.n_parts, model.n_shards, held, mass, to_arrow_type(of_key))
    schema = f"key {of_key.simpleString()}, n_tokens long, n_known long, base_score double, score double"
    return blocks.drop("seen", "n_distinct").groupBy("block").cogroup(known.groupBy("of")).applyInArrow(run, schema)


def language_model_scores(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row, by a model of the rows where ``learn`` holds.

    Null texts are empty; an empty text is its end alone. Rows that repeat
    count each, in the model too; a null ``learn`` is false. Without a
    learning row every token has probability one in the base score and the
    score. Other columns play no part, and an empty table gives an empty one.
    """
    blocks = code_blocks(docs, learn, key, text)
    model = count_blocks(blocks)
    if model.filter_bytes <= options.get("broadcast_bytes", BROADCAST_BYTES):
        model = _filtered(blocks, model)
    scored = score_blocks(blocks, model, **options).withColumn("train_tokens", F.lit(model.n_tokens).cast("long"))
    return scored.select(F.col("key").alias(key), "n_tokens", "n_known", "train_tokens", "base_score", "score")
