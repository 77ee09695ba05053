"""WARC writing and sequential reading (operator 6).

Every record is one gzip member, whatever its size. The archives are plain
concatenations of members, written by Spark's text sink and so through any
file system that Spark reaches, with its commit protocol: a row is a whole
archive and has a file of its own. The sink ends a row with a separator. The
last byte of a member, the high byte of its length field, is zero for any
record under 16 MiB, so a row holds the archive without its last byte and the
separator is that byte. An archive that ends with a longer record gets an
empty metadata record behind it.

The reader takes the bytes of an archive in order, inflates them piece by
piece, frames each record by its Content-Length and checks its digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvault.llm._common import checkpoint_dir

#: Bytes inflated at a time.
PIECE = 1 << 16
#: An archive ends with the record that brings it to so many bytes.
ARCHIVE_BYTES = 32 << 20

RECORD_SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to_id string, payload binary, "
    "payload_bytes long, payload_digest string, digest_ok boolean"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(record_id: str, record_type: str, uri: str | None, refers_to: str | None, payload: bytes, digest: str) -> bytes:
    """A WARC/1.1 record. The block of a revisit is empty; its payload digest is that of what it refers to."""
    block = b"" if record_type == "revisit" else payload
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.translate({10: " ", 13: " "}))
    if record_type == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        head.append(f"WARC-Payload-Length: {len(payload)}")
    head += [
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes, level: int = 4) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def archive_bytes(members: list[bytes]) -> bytes:
    """One archive of the members; its last byte is zero."""
    last = [] if members[-1].endswith(b"\0") else [gzip_member(record_bytes("urn:archive:end", "metadata", None, None, b"", base32_sha1(b"")))]
    return b"".join(members + last)


def write_archives(records: DataFrame, path: str, most: int = ARCHIVE_BYTES) -> None:
    """Write (record_id, record_type, target_uri, refers_to_id, payload) rows as archives of about ``most`` bytes under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, size = [], 0
        for batch in batches:
            heads = zip(*(batch.column(c).to_pylist() for c in ("record_id", "record_type", "target_uri", "refers_to_id")), strict=True)
            for head, body in zip(heads, batch.column("payload"), strict=True):
                payload = body.as_py() or b""
                members.append(gzip_member(record_bytes(*head, payload, base32_sha1(payload))))
                size += len(members[-1])
                if size >= most:
                    yield pa.record_batch({"archive": pa.array([archive_bytes(members)[:-1]], pa.binary())})
                    members, size = [], 0
        if members:
            yield pa.record_batch({"archive": pa.array([archive_bytes(members)[:-1]], pa.binary())})

    rows = records.select("record_id", "record_type", "target_uri", "refers_to_id", "payload").mapInArrow(run, "archive binary")
    (
        rows.select(F.col("archive").cast("string").alias("value"))
        .write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)
    )


class _Inflater:
    """The bytes of consecutive gzip members, inflated as they are asked for."""

    def __init__(self, data: bytes):
        self.data, self.at, self.out, self.unpacker = memoryview(data), 0, bytearray(), None

    def more(self) -> bool:
        """Inflate another piece; False at the end of the archive."""
        if self.unpacker is None:
            if self.at >= len(self.data):
                return False
            self.unpacker = zlib.decompressobj(31)
        piece = self.data[self.at : self.at + PIECE]
        if not piece:
            raise ValueError("the archive ends within a member")
        self.out += self.unpacker.decompress(piece)
        self.at += len(piece)
        if self.unpacker.eof:
            self.at -= len(self.unpacker.unused_data)
            self.unpacker = None
        return True

    def line(self) -> bytes | None:
        """Up to and without CRLF; None at the end."""
        while (end := self.out.find(b"\r\n")) < 0:
            if not self.more():
                if self.out:
                    raise ValueError("the archive ends within a header")
                return None
        found = bytes(self.out[:end])
        del self.out[: end + 2]
        return found

    def take(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self.more():
                raise ValueError("the archive ends within a block")
        found = bytes(self.out[:n])
        del self.out[:n]
        return found


def read_records(data: bytes) -> Iterator[dict]:
    """The records of one archive, in order; digest_ok tells whether the block and payload digests hold."""
    source = _Inflater(data)
    while (line := source.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head = {}
        while line := source.line():
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        block = source.take(int(head["content-length"]))
        if source.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end after its length")
        revisit, digest = head["warc-type"] == "revisit", head.get("warc-payload-digest", "").removeprefix("sha1:")
        own = base32_sha1(block)
        yield {
            "record_id": head["warc-record-id"].strip("<>"),
            "record_type": head["warc-type"],
            "target_uri": head.get("warc-target-uri"),
            "refers_to_id": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
            "payload": None if revisit else block,
            "payload_bytes": int(head["warc-payload-length"]) if revisit else len(block),
            "payload_digest": digest,
            "digest_ok": head.get("warc-block-digest", "").removeprefix("sha1:") == own and (revisit or digest == own),
        }


def read_archives(spark, path: str, payload: bool = True) -> DataFrame:
    """All records of the archives under ``path``; without ``payload`` its column is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                for record in read_records(data.as_py()):
                    size += record["payload_bytes"]
                    rows.append(record if payload else record | {"payload": None})
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema(
        [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to_id", pa.string()),
         ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_())]
    )
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD_SCHEMA)


def with_revisits(pages: DataFrame, key: str, url: str, html: str, least_bytes: int = 0) -> DataFrame:
    """Records of ``pages``: of equal payloads, the smallest key's is response and the others revisit it.

    Payloads under ``least_bytes`` are all response. Null html is an empty
    payload. Rows of equal key and payload are the response each, and so are
    rows without a key.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("target_uri"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    digests = rows.select("key", F.sha2("payload", 256).alias("digest"), F.length("payload").alias("n"))
    firsts = digests.filter(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    named = rows.withColumn("digest", F.sha2("payload", 256)).join(firsts, "digest", "left")
    again = F.col("first").isNotNull() & (F.col("key") > F.col("first"))
    return named.select(
        F.coalesce(F.concat(F.lit("urn:page:"), F.col("key").cast("string")), F.lit("urn:page")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(again, F.concat(F.lit("urn:page:"), F.col("first").cast("string"))).alias("refers_to_id"),
        "payload",
    )


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back.

    Returns key, payload_bytes, payload_digest, record_type, refers_to and
    digest_ok. A digest that does not hold fails the query. Repeated rows
    stay, null keys come back null; an empty table gives an empty table.
    """
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(with_revisits(pages, key, url, html, least_bytes), path)
    kind = pages.schema[key].dataType
    of = lambda c: F.when(F.col(c).startswith("urn:page:"), F.regexp_replace(c, "^urn:page:", "").cast(kind))
    digest = F.when(F.col("digest_ok"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("a digest does not hold: "), "record_id")))
    return read_archives(spark, path, payload=False).filter("record_type <> 'metadata'").select(
        of("record_id").alias(key), "payload_bytes", digest.alias("payload_digest"), "record_type", of("refers_to_id").alias("refers_to"), "digest_ok"
    )
