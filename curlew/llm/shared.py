"""Shared folder, staged tables and small helpers for the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

# An Arrow batch ends at so many rows or bytes, whichever comes first: a worker holds
# one batch of texts, its results and its tables, however long the texts are.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``storage.shared_folder``)."""
    return storage.shared_folder(spark)


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/curlew-{kind}-{uuid.uuid4().hex}"


def staged(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back. This
    cuts the lineage: later failures re-read files, not the whole history."""
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """Before Python operators run: short Arrow batches, and this package on the
    path of every worker, whichever way the driver found it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    storage.ship(spark)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a pass over Arrow batches, that gives memory back to the machine when its task
    ends: workers live on between tasks, and what they once freed would stay with them."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
            if trim:
                trim(0)

    return tidied


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for the jobs inside, which move numbers alone."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


KEYS_BROADCAST = 500_000  # more keys than these are not broadcast


def text_key(text) -> list:
    """128 bits that name a text (null: as the empty one), as columns k0 and k1: whatever is
    computed from the text alone is the same for rows that share them."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("k0"), F.xxhash64(F.lit(0x5EED), text, F.octet_length(text)).alias("k1")]


def without_texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text is named by ``keys(k0, k1)``. Few keys are broadcast, and
    no text is shuffled; more of them meet the texts in a join that Spark can split."""
    keys = staged(keys.select("k0", "k1").distinct(), "keys")
    few = keys.count() <= KEYS_BROADCAST
    other = F.broadcast(keys) if few else apart(keys)
    mine = [c.alias(f"_{i}") for i, c in enumerate(text_key(F.col("row.text")))]
    rows = docs.select(F.struct("*").alias("row")).select("row", *mine)
    return rows.join(other, (F.col("_0") == other["k0"]) & (F.col("_1") == other["k1"]), "left_anti").select("row.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id's text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes staged tables that no later step reads, and lets Spark remove the
    shuffle files of finished steps, so that disk holds one step's files at a time."""
    jvm = spark.sparkContext._jvm
    for df in tables:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            if path.getName().startswith("curlew-"):
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


def apart(df: DataFrame) -> DataFrame:
    """``df``, an aggregate that is joined by its own key, dealt out evenly
    (``storage.dealt``), so that Spark can split a hot key on the other side."""
    return storage.dealt(df)
