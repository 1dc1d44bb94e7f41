"""Token-ID files: one zstandard dictionary, a frame for each document.

A folder holds ``dictionary.zdict`` and shards. A shard is

    magic "CTOKID01" | SHA-256 of the dictionary (32 bytes) | id width in bytes
    (uint32) | number of documents (uint32) | frames | index

and its last 8 bytes say where the index begins. The index has, for each
document, doc_id (int64), place of its frame (uint64), length of the frame
(uint32) and number of ids (uint32), so a single short document is read with two
small reads. Ids are little-endian, 2 bytes wide if the vocabulary has at most
65,536 entries, else 4. All numbers are little-endian.

Defined cases: a null text is an empty text and holds the end id alone; a null
doc_id sorts first and is kept (flagged in the index by the smallest int64); equal
doc_ids are next to each other (unless they hold several shards' share, ordered by the
CRC of their ids); an empty table gives no shard and no row; further
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import byte_bpe
from .files import read_whole, write_whole
from .shared import fresh_path, partitions, short_batches, staged, table, tidy

MAGIC = b"CTOKID01"
HEAD = struct.Struct("<8s32sII")
INDEX = np.dtype([("doc_id", "<i8"), ("at", "<u8"), ("size", "<u4"), ("n", "<u4")])
NULL_ID = -(1 << 63)
SHARD_BYTES = 16 << 20  # a writer closes a shard beyond this


def pack_ids(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def unpack_ids(data: bytes, width: int) -> bytes:
    return data if width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()


def train_dictionary(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A dictionary for serialized id arrays; empty if there is too little to learn."""
    import zstandard

    samples = [s for s in samples if len(s) >= 16]
    if len(samples) < 16 or sum(map(len, samples)) < 16 << 10:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class FrameWriter:
    """Compresses each id array on its own with the shared dictionary."""

    def __init__(self, dictionary: bytes, width: int, level: int = 1):
        import zstandard

        self.width = width
        kept = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self._press = zstandard.ZstdCompressor(level=level, dict_data=kept, write_content_size=True).compress

    def frame(self, ids: bytes) -> bytes:
        return self._press(pack_ids(ids, self.width))


class ShardWriter:
    """Puts finished frames together."""

    def __init__(self, dictionary: bytes, width: int):
        self.hash, self.width = hashlib.sha256(dictionary).digest(), width
        self._begin()

    def _begin(self) -> None:
        self.frames, self.index, self.size = [], [], HEAD.size

    def add(self, doc_id: int | None, frame: bytes, n: int) -> None:
        self.index.append((NULL_ID if doc_id is None else doc_id, self.size, len(frame), n))
        self.frames.append(frame)
        self.size += len(frame)

    def close(self) -> bytes:
        head = HEAD.pack(MAGIC, self.hash, self.width, len(self.index))
        out = b"".join([head, *self.frames, np.array(self.index, INDEX).tobytes(), struct.pack("<Q", self.size)])
        self._begin()
        return out


class ShardReader:
    """Reads any document of a shard; fails on another dictionary than the shard's."""

    def __init__(self, data: bytes, dictionary: bytes):
        import zstandard

        magic, digest, self.width, n = HEAD.unpack_from(data)
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a token-ID shard, or written with another dictionary")
        self.data = data
        self.index = np.frombuffer(data, INDEX, n, struct.unpack_from("<Q", data, len(data) - 8)[0])
        kept = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self._open = zstandard.ZstdDecompressor(dict_data=kept).decompress

    def ids(self, row: int) -> bytes:
        x = self.index[row]
        at = int(x["at"])
        return unpack_ids(self._open(self.data[at : at + int(x["size"])]), self.width)


def _sample(docs: DataFrame, tokenizer: str, end_id: int, width: int, n_docs: int, max_bytes: int) -> list[bytes]:
    """Whole serialized arrays of the ``n_docs`` documents with the smallest hash of the
    id, as many as fit ``max_bytes``; none longer than an eighth of that. It fits
    the dictionary alone."""
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_docs)
    known = [r[0] for r in chosen.collect() if r[0] is not None]
    if not known:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.load(tokenizer)
        for batch in batches:
            out = [pack_ids(bpe.encode(text) + struct.pack("<I", end_id), width) for text in batch.column(1).to_pylist()]
            keep = pa.array([len(x) <= max_bytes // 8 for x in out])
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "ids"]).filter(keep)

    rows = docs.filter(F.col("doc_id").isin(known)).mapInArrow(tidy(run), "doc_id long, ids binary").collect()
    place, left, out = {k: i for i, k in enumerate(known)}, max_bytes, []
    for r in sorted(rows, key=lambda r: (place[r.doc_id], r.ids)):
        if len(r.ids) <= left:
            left -= len(r.ids)
            out.append(bytes(r.ids))
    return out


def _bounds(docs: DataFrame, n: int) -> np.ndarray:
    """``n`` - 1 ids that part the documents into ``n`` ranges of about equal numbers (a null
    id counts as the smallest). An id that holds several ranges' share is there as often."""
    if n < 2:
        return np.zeros(0, np.int64)
    shares = [i / n for i in range(1, n)]
    ids = F.coalesce("doc_id", F.lit(NULL_ID))
    found = docs.agg(F.percentile_approx(ids, shares, min(100 * n, 1_000_000))).first()[0]
    return np.array(found or [], np.int64)


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str | None = None,
    end_id: int = 0,
    dictionary_docs: int = 512,
    dictionary_sample_bytes: int = 8 << 20,
) -> DataFrame:
    """Encodes ``docs(doc_id, text)`` and writes shards in ascending doc_id order. Returns
    the manifest, a row per shard: path, part, shard, n_docs, n_ids.

    Documents are encoded and compressed where they are read; only frames are shuffled."""
    spark = docs.sparkSession
    short_batches(spark)
    tokenizer = tokenizer or byte_bpe.default_path()
    width = 2 if max(byte_bpe.load(tokenizer).vocab_size, end_id + 1) <= 1 << 16 else 4
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dictionary = train_dictionary(_sample(docs, tokenizer, end_id, width, dictionary_docs, dictionary_sample_bytes))
    write_whole(f"{folder}/dictionary.zdict", dictionary)
    end, n_parts = struct.pack("<I", end_id), partitions(spark)
    bounds = _bounds(docs, n_parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, writer = byte_bpe.load(tokenizer), FrameWriter(dictionary, width)
        for batch in batches:
            ids = [bpe.encode(text) + end for text in batch.column(1).to_pylist()]
            crc = np.fromiter(map(zlib.crc32, ids), np.int64, len(ids))
            key = batch.column(0).fill_null(NULL_ID).to_numpy()
            # An id that is a bound more than once holds several ranges; its rows are dealt out.
            low, high = np.searchsorted(bounds, key), np.searchsorted(bounds, key, side="right")
            low = np.where(high > low, low + 1, low)
            part = low + (crc + np.arange(len(ids))) % (high - low + 1).clip(1)
            yield pa.record_batch(
                [pa.array(part, pa.int32()), batch.column(0), pa.array(crc), pa.array([len(i) // 4 for i in ids], pa.int32()), pa.array(map(writer.frame, ids), pa.binary())],
                names=["part", "doc_id", "crc", "n", "frame"],
            )
        bpe.forget()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        writer, shard, n_ids = ShardWriter(dictionary, width), 0, 0

        def close():
            nonlocal shard, n_ids
            n_docs, path = len(writer.index), f"{folder}/shard-{part:07d}-{shard:05d}.ctok"
            write_whole(path, writer.close())
            row = pa.record_batch([[path], [part], [shard], [n_docs], [n_ids]], names=["path", "part", "shard", "n_docs", "n_ids"])
            shard, n_ids = shard + 1, 0
            return row

        for batch in batches:
            for doc_id, n, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n_ids += n
                writer.add(doc_id, frame, n)
                if writer.size >= SHARD_BYTES:
                    yield close()
        if writer.index:
            yield close()

    rows = docs.mapInArrow(tidy(encode), "part int, doc_id long, crc long, n int, frame binary").repartitionById(n_parts, "part")
    ordered = rows.sortWithinPartitions("doc_id", "crc", "frame").select("doc_id", "n", "frame")
    return staged(ordered.mapInArrow(tidy(run), "path string, part long, shard long, n_docs long, n_ids long"), "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all shards before, from sums per 1,024 parts: no task holds
    all rows of the manifest."""
    block = F.floor(F.col("part") / 1024)
    sums = manifest.groupBy(block.alias("block")).agg(F.sum("n_ids").alias("n"))
    earlier = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = W.partitionBy("block").orderBy("part", "shard").rowsBetween(W.unboundedPreceding, -1)
    rows = manifest.withColumn("block", block).withColumn("start", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return rows.join(base, "block").select("path", "part", "shard", "n_docs", "n_ids", (F.col("start") + F.col("base")).alias("start"))


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 and the ids
    themselves as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = read_whole(f"{folder}/dictionary.zdict")
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = ShardReader(read_whole(path), dictionary)
                for low in range(0, len(reader.index), 512):
                    x = reader.index[low : low + 512]
                    ids = [reader.ids(low + i) for i in range(len(x))]
                    n = x["n"].astype("i8")
                    at = start + np.concatenate(([0], np.cumsum(n)))
                    start = int(at[-1])
                    yield pa.record_batch(
                        [
                            pa.array(x["doc_id"].astype("i8"), mask=x["doc_id"] == NULL_ID),
                            pa.array(at[:-1]),
                            pa.array(n),
                            pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                            pa.array(ids, pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    files = with_starts(manifest).select("path", "start").repartition(partitions(spark))
    return files.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-ids")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, end_id=0)
    return read_token_files(spark, folder, manifest).drop("ids")
