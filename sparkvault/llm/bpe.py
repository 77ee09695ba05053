"""BPE encoding and decoding over a distinct-word table (operator 4).

Words are split off in Spark, each distinct word is encoded once, and its ids
go back to the places where the word stands. Documents fall into blocks of a
bounded size where they lie; their texts never move. A block keeps a code for
every word and sends its distinct words to word groups: the blocks of a super
block share a fixed number of groups, so that the messages grow with the
blocks and no group grows with the table. A group encodes each of its words
once; for decoding, the ids of these words are joined with the pieces of the
vocabulary, row by row. Ids and pieces return to the blocks that asked, and a
document is its codes' ids and pieces in order.

A word is what ASCII white space separates. The tokenizer's normaliser and
pre-tokenizer drop white space and never look across it, so the ids of a text
are the ids of its words, one after the other.

The blocks are formed twice, for the words and for the codes, and so have to
come out alike: the table's files or partitions must give the same rows in the
same order, as written tables do. A check sum of the words tells if not.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvault.llm._common import give_back, mix64, n_blocks, slices

#: Bytes of text and rows of a block; one task holds one block at a time.
BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 200_000
#: Words of a block that are put together at once.
TURN_WORDS = 500_000
#: Blocks that share word groups, and how many groups these share.
SUPER_BLOCKS, GROUPS = 64, 64


def zstd(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unzstd(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def squeezed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    used = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([used]) + zstd(planes[:used].tobytes())


def unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unzstd(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u4").ravel()


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    """The tokenizer at ``path``, read once per worker, without truncation and padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=2)
def id_pieces(path: str) -> dict[int, str]:
    """The id-to-piece table of a vocabulary file; the file bounds its size."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return {i: piece for piece, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec.get("added_tokens", [])}


def vocabulary(spark: SparkSession, tokenizer_path: str) -> DataFrame:
    """The same table as rows: (id int, piece string)."""
    return spark.createDataFrame(sorted(id_pieces(tokenizer_path).items()), "id int, piece string")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.ChunkedArray, pa.Array]]:
    """(number, keys, texts) of the blocks of one partition; null texts are empty."""
    part, n, held, size, rows = TaskContext.get().partitionId() << 24, 0, [], 0, 0

    def closed() -> tuple[int, pa.ChunkedArray, pa.Array]:
        table = pa.Table.from_batches(held)
        texts = table.column("text").cast(pa.large_string()) if size >= 1 << 30 else table.column("text")
        return part + n, table.column("key"), texts.combine_chunks().fill_null("")

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        for first, last in slices(lengths, BLOCK_BYTES // 8):
            held.append(batch.slice(first, last - first))
            size += sum(lengths[first:last])
            rows += last - first
            if size >= BLOCK_BYTES or rows >= BLOCK_ROWS:
                yield closed()
                n, held, size, rows = n + 1, [], 0, 0
    if held:
        yield closed()


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Words of each text, the code of every word, the distinct words by code, and the group of each of them."""
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    group = np.fromiter((zlib.crc32(w) % GROUPS for w in words), np.int64, len(words))
    return pc.list_value_length(split).to_numpy(), coded.indices.to_numpy(), words, group


def _by_group(words: list[bytes], group: np.ndarray) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(group, codes, message) of the groups that the words go to; a message is its words by code."""
    order = np.argsort(group, kind="stable")
    groups, firsts = np.unique(group[order], return_index=True)
    for g, codes in zip(groups.tolist(), np.split(order, firsts[1:]), strict=True):
        yield g, codes, b"\n".join([words[i] for i in codes.tolist()])


def _words(super_blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The blocks' messages to the word groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in _blocks(batches):
            _, _, words, group = _coded(texts)
            own = int(mix64(np.array([block]))[0] % np.uint64(super_blocks)) * GROUPS
            sent = [(own + g, block, g, zlib.crc32(message), zstd(message)) for g, _, message in _by_group(words, group)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            columns = [pa.array(c, kind) for c, kind in zip(zip(*sent, strict=True), kinds, strict=True)]
            del texts, words, group, sent
            yield pa.RecordBatch.from_arrays(columns, ["group", "block", "part", "sum", "words"])
            del columns
            give_back()

    return run


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a block keeps of its documents: keys, numbers of words, codes, the codes' groups, and the check sums of its messages."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
    for block, keys, texts in _blocks(batches):
        n_words, codes, words, group = _coded(texts)
        sums = np.zeros(GROUPS, np.uint32)
        for g, _, message in _by_group(words, group):
            sums[g] = zlib.crc32(message)
        sink = pa.BufferOutputStream()
        table = pa.table({"key": keys})
        with pa.ipc.new_stream(sink, table.schema, options=options) as out:
            out.write_table(table)
        kept = {"keys": sink.getvalue().to_pybytes(), "n_words": squeezed(n_words), "codes": squeezed(codes), "parts": squeezed(group), "sums": squeezed(sums)}
        del keys, texts, n_words, codes, words, group, table
        yield pa.record_batch({"block": pa.array([block], pa.int64())} | {k: pa.array([v], pa.binary()) for k, v in kept.items()})
        del kept
        give_back()


def _asked(table: pa.Table) -> tuple[list[bytes], list[np.ndarray]]:
    """A group's distinct words in order, and for each message the places of its words among them."""
    messages = [unzstd(x).split(b"\n") for x in table.column("words").to_pylist()]
    distinct = sorted(set().union(*messages))
    place = {w: i for i, w in enumerate(distinct)}
    return distinct, [np.fromiter(map(place.__getitem__, m), np.int64, len(m)) for m in messages]


def _asked_once(table: pa.Table) -> tuple[list[str], list[np.ndarray]]:
    """As :func:`_asked`, with the distinct words in the order in which they come, which is another one each time."""
    lists = [pc.split_pattern(pa.array([unzstd(x)], pa.large_binary()).cast(pa.large_string()), "\n").flatten() for x in table.column("words").to_pylist()]
    coded = pa.concat_arrays(lists).dictionary_encode()
    ends = np.cumsum([len(x) for x in lists])
    return coded.dictionary.to_pylist(), np.split(coded.indices.to_numpy().astype(np.int64), ends[:-1])


def _ids(distinct: list[str], tokenizer_path: str) -> pa.ListArray:
    """The ids of the words."""
    tokenizer, ids, ends = load_tokenizer(tokenizer_path), [], [0]
    for first in range(0, len(distinct), 20_000):
        for code in tokenizer.encode_batch_fast(distinct[first : first + 20_000], add_special_tokens=False):
            ids += code.ids
            ends.append(len(ids))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


def _replies(table: pa.Table, places: list[np.ndarray], ids: pa.ListArray, pieces: pa.LargeBinaryArray | None) -> pa.Table:
    """The answer to every message: the words' numbers of ids, their ids, and the lengths and bytes of their pieces."""
    out: dict[str, list[bytes | None]] = {"n_ids": [], "ids": [], "n_bytes": [], "bytes": []}
    for at in places:
        own = ids.take(pa.array(at))
        out["n_ids"].append(squeezed(np.diff(own.offsets.to_numpy())))
        out["ids"].append(squeezed(own.flatten().to_numpy()))
        shown = None if pieces is None else pieces.take(pa.array(at))
        out["n_bytes"].append(None if shown is None else squeezed(pc.binary_length(shown).to_numpy()))
        out["bytes"].append(None if shown is None else zstd(b"".join(shown.to_pylist())))
    return pa.table({c: table.column(c) for c in ("block", "part", "sum")} | {k: pa.array(v, pa.binary()) for k, v in out.items()})


REPLY = "block long, part int, sum long, n_ids binary, ids binary, n_bytes binary, bytes binary"


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


@dataclass
class Block:
    """Documents of a block, some at a time: keys, ids and, where these were asked for, pieces."""

    keys: pa.ChunkedArray
    ids: np.ndarray
    id_at: np.ndarray
    shown: memoryview | None = None
    shown_at: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.keys)

    def ids_of(self, i: int) -> np.ndarray:
        """The ids of document i as little-endian unsigned 32-bit integers."""
        return self.ids[self.id_at[i] : self.id_at[i + 1]]

    def text_of(self, i: int) -> memoryview:
        """The decoded text of document i in UTF-8; every word's pieces are followed by a space."""
        first, last = self.shown_at[i : i + 2].tolist()
        return self.shown[first : max(first, last - 1)]


def _documents(kept: pa.Table, replies: pa.Table) -> Iterator[Block]:
    """The documents of a block, in turns of some ``TURN_WORDS`` words."""
    one = {c: kept.column(c)[0].as_py() for c in ("keys", "n_words", "codes", "parts", "sums")}
    keys = pa.ipc.open_stream(one["keys"]).read_all().column("key")
    group, n_words, sums = unsqueezed(one["parts"]), unsqueezed(one["n_words"]), unsqueezed(one["sums"])
    row, base = np.full(len(group), -1, np.int32), 0
    n_ids, ids, n_bytes, shown = [], [], [], []
    for part, told, *answer in zip(*(replies.column(c).to_pylist() for c in ("part", "sum", "n_ids", "ids", "n_bytes", "bytes")), strict=True):
        n_ids.append(unsqueezed(answer[0]))
        ids.append(unsqueezed(answer[1]))
        if answer[2] is not None:
            n_bytes.append(unsqueezed(answer[2]))
            shown.append(unzstd(answer[3]))
        own = np.flatnonzero(group == part)
        if told != sums[part] or len(own) != len(n_ids[-1]):
            raise ValueError("a block came out otherwise for its words than for its codes")
        row[own] = base + np.arange(len(own))
        base += len(own)
    if (row < 0).any():
        raise ValueError("a block has words that no group answered for")
    at, words = row[unsqueezed(one["codes"])], _starts(n_words)
    every = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    of_word = pa.ListArray.from_arrays(pa.array(_starts(np.concatenate(n_ids) if n_ids else []), pa.int32()), pa.array(every, pa.uint32()))
    texts = None
    if shown:
        offsets = pa.py_buffer(_starts(np.concatenate(n_bytes)))
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), base, [None, offsets, pa.py_buffer(b"".join(shown))])
    for first, last in slices(n_words.tolist(), TURN_WORDS):
        place, ends = pa.array(at[words[first] : words[last]]), words[first : last + 1] - words[first]
        taken = of_word.take(place)
        block = Block(keys.slice(first, last - first), taken.flatten().to_numpy(), taken.offsets.to_numpy()[ends])
        if texts is not None:
            some = texts.take(place)
            block.shown_at = np.frombuffer(some.buffers()[1], np.int64)[some.offset : some.offset + len(some) + 1][ends]
            block.shown = memoryview(some.buffers()[2] or b"")
        yield block


def _strings(lengths: np.ndarray, data: bytes) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(_starts(lengths).astype(np.int32)), pa.py_buffer(data))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, at, pos, id, piece) rows, those of a group compressed together, some 200,000 at a time."""
    kinds = {"group": pa.int64()} | {c: pa.binary() for c in ("at", "pos", "ids", "n_bytes", "bytes")}
    held, n = [], 0

    def sent() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).sort_by("group")
        groups, firsts = np.unique(table.column("group").to_numpy(), return_index=True)
        for group, first, last in zip(groups.tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(table)], strict=True):
            own = table.slice(first, last - first).combine_chunks()
            at, pos, ids = (own.column(c).to_numpy().astype(np.uint32) for c in ("at", "pos", "id"))
            pieces = own.column("piece").cast(pa.binary())
            row = {
                "group": group, "at": squeezed(np.diff(at, prepend=np.uint32(0))), "pos": squeezed(pos), "ids": squeezed(ids),
                "n_bytes": squeezed(pc.binary_length(pieces).to_numpy()), "bytes": zstd(b"".join(pieces.to_pylist())),
            }
            yield pa.record_batch({c: pa.array([row[c]], kind) for c, kind in kinds.items()})

    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= 200_000:
            yield from sent()
            held, n = [], 0
            give_back()
    if n:
        yield from sent()
        held = []
        give_back()


def _unpacked(table: pa.Table) -> tuple[np.ndarray, pa.Array, pa.StringArray]:
    """(at, ids, pieces) of one group by at and pos; the rows may have come in any order."""
    parts = [table.column(c).to_pylist() for c in ("at", "pos", "ids", "n_bytes", "bytes")]
    if not parts[0]:
        return np.empty(0, np.int64), pa.array([], pa.int32()), pa.array([], pa.string())
    at = np.concatenate([np.cumsum(unsqueezed(x), dtype=np.uint32) for x in parts[0]])
    pos, ids, lengths = (np.concatenate(list(map(unsqueezed, x))) for x in parts[1:4])
    order = pa.array(np.lexsort((pos, at)))
    pieces = _strings(lengths, b"".join(map(unzstd, parts[4])))
    return np.sort(at).astype(np.int64), pa.array(ids.astype(np.int32)).take(order), pieces.take(order)


def joined_pieces(coded: DataFrame, vocab: DataFrame) -> DataFrame:
    """The ids of ``coded`` (group, at, ids) with their pieces, packed by group.

    A join of every id with the vocabulary, which its file bounds.
    """
    exploded = coded.select("group", "at", F.posexplode("ids").alias("pos", "id"))
    joined = exploded.join(F.broadcast(vocab), "id").select("group", "at", "pos", "id", "piece")
    return joined.mapInArrow(_packed, "group long, at binary, pos binary, ids binary, n_bytes binary, bytes binary")


def encoded_blocks(
    docs: DataFrame,
    tokenizer_path: str,
    assemble: Callable[[Block], pa.Table],
    schema: str,
    key: str = "doc_id",
    text: str = "text",
    vocab: DataFrame | None = None,
) -> DataFrame:
    """Run ``assemble`` over the documents of every block of ``docs``, some at a time; with ``vocab`` (id, piece) the blocks have decoded texts too.

    Rows are kept as they are: repeated and null keys stay apart, null texts
    are empty.
    """
    blocks = n_blocks(docs, text, BLOCK_BYTES, BLOCK_ROWS)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).coalesce(2 * blocks)
    messages = rows.mapInArrow(_words(-(-blocks // SUPER_BLOCKS)), "group long, block long, part int, sum long, words binary").groupBy("group")

    def answer(table: pa.Table) -> pa.Table:
        distinct, places = _asked_once(table)
        return _replies(table, places, _ids(distinct, tokenizer_path), None)

    def code(table: pa.Table) -> pa.Table:
        distinct, _ = _asked(table)
        group = pa.array([table.column("group")[0].as_py()] * len(distinct), pa.int64())
        return pa.table({"group": group, "at": pa.array(np.arange(len(distinct), dtype=np.int32)), "ids": _ids([w.decode() for w in distinct], tokenizer_path)})

    def answer_joined(table: pa.Table, coded: pa.Table) -> pa.Table:
        distinct, places = _asked(table)
        at, ids, pieces = _unpacked(coded)
        n_ids = np.bincount(at, minlength=len(distinct))
        ends = pa.array(_starts(n_ids), pa.int32())
        shown = pc.binary_join(pa.ListArray.from_arrays(ends, pieces), " ")
        shown = pc.if_else(pc.greater(pa.array(n_ids), 0), pc.binary_join_element_wise(shown, "", " "), "")
        return _replies(table, places, pa.ListArray.from_arrays(ends, ids), shown.cast(pa.large_binary()))

    if vocab is None:
        replies = messages.applyInArrow(answer, REPLY)
    else:
        coded = messages.applyInArrow(code, "group long, at int, ids array<int>")
        replies = messages.cogroup(joined_pieces(coded, vocab).groupBy("group")).applyInArrow(answer_joined, REPLY)
    kept = rows.mapInArrow(_codes, "block long, keys binary, n_words binary, codes binary, parts binary, sums binary")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.concat_tables(list(map(assemble, _documents(left, right))))
        give_back()
        return out

    return kept.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def encode(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every document.

    Null and empty texts give an empty array; repeated rows give repeated
    rows; an empty table gives an empty table; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def assemble(block: Block) -> pa.Table:
        ids = pa.ListArray.from_arrays(pa.array(block.id_at, pa.int32()), pa.array(block.ids.view(np.int32)))
        return pa.table({"key": block.keys, "ids": ids})

    return encoded_blocks(docs, tokenizer_path, assemble, f"key {kind}, ids array<int>", key, text).withColumnRenamed("key", key)


def decode(encoded: DataFrame, vocab: DataFrame, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded) of every (key, ids) row through a join of ids with pieces.

    Pieces are set one after the other with a space between, as a vocabulary
    without a decoder has it. ``vocab`` is broadcast: a vocabulary file bounds
    it. Ids without a piece are left out; null and empty arrays decode to "".
    """
    rows = encoded.select(F.col(key).alias("__key"), F.col(ids).alias("__ids"), F.monotonically_increasing_id().alias("__row"))
    pieces = (
        rows.select("__row", "__key", F.posexplode_outer("__ids").alias("__at", "__id"))
        .join(F.broadcast(vocab.select(F.col("id").alias("__id"), "piece")), "__id", "left")
        .groupBy("__row", "__key")
        .agg(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("__at", "piece")))).alias("__p"))
    )
    return pieces.select(F.col("__key").alias(key), F.array_join(F.col("__p.piece"), " ").alias("decoded"))


def codec_digests(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every document's encoding and decoding.

    The decoded text is the document's words' pieces, each word's from a join
    of its ids with the vocabulary. Null texts count as empty.
    """
    kind = docs.schema[key].dataType.simpleString()

    def assemble(block: Block) -> pa.Table:
        n, ids_sha, text_sha = np.diff(block.id_at), [], []
        for i in range(len(block)):
            ids_sha.append(hashlib.sha256(block.ids_of(i)).hexdigest())
            text_sha.append(hashlib.sha256(block.text_of(i)).hexdigest())
        return pa.table({"key": block.keys, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": text_sha})

    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    vocab = vocabulary(docs.sparkSession, tokenizer_path)
    return encoded_blocks(docs, tokenizer_path, assemble, schema, key, text, vocab).withColumnRenamed("key", key)
