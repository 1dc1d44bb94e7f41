"""Tables written in the shared folder to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset, a local session gets a
    folder of this machine; on a cluster that is an error, as executors would not share it."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="curlew-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def fresh_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/curlew-{kind}-{uuid.uuid4().hex}"


def dealt(df: DataFrame) -> DataFrame:
    """``df``, an aggregate that is joined by its own key, dealt out evenly. Left where the
    aggregation put it, the join would take over that partitioning and Spark could not
    split the partition of a hot key on the other side."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def staged(df: DataFrame, large: bool = False) -> DataFrame:
    """``df``, written and read back. ``large``: rows of up to some MB each, in row groups of some
    16 MB, as a reader and a writer hold one as a whole."""
    path = fresh_folder(df.sparkSession, "stage")
    sizes = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 4} if large else {}
    df.write.options(**sizes).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """This package on the path of every worker, whichever way the driver found it."""
    sc = spark.sparkContext
    if getattr(sc, "_curlew_shipped", None):
        return
    package = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="curlew-code-")) / "curlew_code.zip"
    with zipfile.ZipFile(at, "w") as code:
        for f in sorted(package.rglob("*.py")):
            code.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(at))
    sc._curlew_shipped = True
