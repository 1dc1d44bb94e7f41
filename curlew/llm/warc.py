"""WARC archives with a Zstandard dictionary in each file.

A file (``.warc.zst``) begins with a skippable frame (magic 0x184D2A5D) that holds a
dictionary built from the records of that file; then each record is a frame of its
own. Of records with equal payloads of at least ``revisit_from`` bytes, the one with the
largest page_id is the response; the others are revisit records that refer to it and
carry the payload's digest and length in their headers, but no payload.

Defined cases: a null html is an empty payload; a null url is written as an empty
target; a null page_id is written and read as null, and ranks below every id; rows that
repeat a response's page_id and payload are responses too; equality of payloads is
equality of SHA-256 and length; an empty table gives no file and no row; further columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import write_whole
from .shared import apart, fresh_path, short_batches, table, tidy

DICTIONARY_MAGIC = 0x184D2A5D
SHARD_BYTES = 12 << 20  # a file is closed beyond so many bytes of records
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the table has no capture time


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _id(name: str) -> int | None:
    text = name[len("<urn:x-page:") : -1]
    return None if text == "none" else int(text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC record with its two closing line ends."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    block = http + payload if refers_to is None else http
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = 32 << 10) -> bytes:
    import zstandard

    if len(records) < 16 or sum(map(len, records)) < 32 << 10:
        return b""
    try:
        return zstandard.train_dictionary(size, records, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive(records: list[bytes], level: int = 3) -> bytes:
    """The bytes of one file."""
    import zstandard

    dictionary = build_dictionary(records)
    kept = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if kept:
        kept.precompute_compress(level)
    press = zstandard.ZstdCompressor(level=level, dict_data=kept).compress
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary + b"".join(map(press, records))


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one file."""
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame at the start of the file")
    kept = zstandard.ZstdCompressionDict(data[8 : 8 + size]) if size else None
    stream = zstandard.ZstdDecompressor(dict_data=kept).stream_reader(io.BytesIO(memoryview(data)[8 + size :]), read_across_frames=True)
    plain = stream.read()
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) for x in lines[1:])
        begin = end + 4
        stop = begin + int(head["Content-Length"])
        yield head, plain[begin:stop]
        at = stop + 4


def page_of(head: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to); the digest of a
    payload that is there is checked."""
    cut = block.index(b"\r\n\r\n") + 4
    length = next(int(x.split(b":", 1)[1]) for x in block[: cut - 4].split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if head["WARC-Type"] == "response" and (hashlib.sha1(block[cut:]).hexdigest() != digest or len(block) - cut != length):
        raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its digest")
    refers = head.get("WARC-Refers-To")
    return _id(head["WARC-Record-ID"]), length, digest, head["WARC-Type"], _id(refers) if refers else None


def with_referral(pages: DataFrame, revisit_from: int = 1000) -> DataFrame:
    """page_id, url, html and refers, the page that a revisit record refers to (else null)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    long = F.octet_length("html") >= revisit_from
    # Payloads too short to be revisited have a key that meets nothing, each its own, so that
    # they are spread evenly.
    own = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumn("key", F.when(long, F.concat_ws(":", F.sha2("html", 256), F.octet_length("html"))).otherwise(own))
    # Only keys with more than one page can have a revisit. They are dealt out evenly before
    # they meet the pages, so that Spark can split a payload that very many pages share.
    keepers = rows.filter(long).groupBy("key").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "keeper")
    refers = F.when(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return rows.join(apart(keepers), "key", "left").select("page_id", "url", "html", refers.alias("refers"))


def write_archives(pages: DataFrame, folder: str, revisit_from: int = 1000) -> int:
    """Writes ``pages(page_id, url, html)`` to ``.warc.zst`` files and returns their number."""
    spark = pages.sparkSession
    short_batches(spark)
    joined = with_referral(pages, revisit_from)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, records, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for page_id, url, text, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                records.append(record(page_id, url, text.encode(), to))
                size += len(records[-1])
                if size >= SHARD_BYTES:
                    write_whole(f"{folder}/part-{part:06d}-{shard:05d}.warc.zst", archive(records))
                    records, size, shard = [], 0, shard + 1
        if records:
            write_whole(f"{folder}/part-{part:06d}-{shard:05d}.warc.zst", archive(records))
            shard += 1
        yield pa.record_batch([[shard]], names=["files"])

    written = joined.mapInArrow(tidy(run), "files long")
    return written.agg(F.sum("files")).first()[0] or 0


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the folder's files."""
    short_batches(spark)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = [page_of(*r) for r in read_archive(data.as_py())]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("content").mapInArrow(tidy(run), schema)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    if not write_archives(table(spark, sf_dir, "pages"), folder):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(spark, folder)


OP9_SQL = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), k AS (
    SELECT payload, max(page_id) AS keeper FROM p WHERE octet_length(payload) >= 1000 GROUP BY payload
)
SELECT p.page_id, octet_length(p.payload)::BIGINT AS payload_bytes, sha1(p.payload) AS payload_digest,
       CASE WHEN k.keeper IS NULL OR k.keeper = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k.keeper != p.page_id THEN k.keeper END AS refers_to
FROM p LEFT JOIN k ON p.payload = k.payload
"""
