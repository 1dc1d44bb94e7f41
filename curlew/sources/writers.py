"""Sinks: JSON lines and arrays, split folders, shards, append logs, metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object per line in UTF-8; null fields are kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def json_array(df: DataFrame, path: str, rows: int = 10_000) -> None:
    """A folder of files that each hold an array of at most ``rows`` objects: no task and no
    string holds more."""
    numbered = df.select(F.monotonically_increasing_id().alias("n"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    lists = numbered.groupBy(F.floor(F.col("n") / rows).alias("part")).agg(F.array_sort(F.collect_list(F.struct("n", "j"))).alias("l"))
    body = lists.select(F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["j"]), ",\n"), F.lit("]")).alias("value"))
    body.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def by_suffix(df: DataFrame, path: str) -> None:
    if path.endswith(".jsonl"):
        json_lines(df, path)
    elif path.endswith(".json"):
        json_array(df, path)
    elif path.endswith(".csv"):
        df.write.mode("overwrite").csv(path, header=True)
    else:
        df.write.mode("overwrite").parquet(path)


def split_folders(df: DataFrame, path: str, column: str) -> None:
    """One folder per value."""
    df.write.mode("overwrite").partitionBy(column).json(path)


def append_log(df: DataFrame, path: str, source: str | None = None) -> None:
    """Rows added to a log, in a folder per source if given."""
    writer = df.write.mode("append")
    (writer.partitionBy(source) if source else writer).json(path)


def shards(df: DataFrame, path: str, rows: int = 204_800) -> None:
    """Parquet files of at most ``rows`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def rows_at(df: DataFrame, places: DataFrame, path: str, id: str = "row_id") -> None:  # noqa: A002
    """The chosen rows as JSON lines."""
    json_lines(df.join(places.select(id).distinct(), id, "left_semi"), path)


def metrics(df: DataFrame, path: str, step: int) -> None:
    """(step, key, value) rows added to a metric table. ``df(key, value)``."""
    df.select(F.lit(step).alias("step"), F.col("key").cast("string").alias("key"), F.col("value").cast("double").alias("value")).write.mode("append").parquet(path)


def generations(df: DataFrame, path: str, step: int, n: int, seed: int = 42) -> None:
    """A fixed sample of validation generations added to a table. ``df(input, output, score)``."""
    chosen = df.orderBy(F.xxhash64("input", "output", F.lit(seed)), "input").limit(n)
    chosen.withColumn("step", F.lit(step)).write.mode("append").parquet(path)


def matrix_rows(t, spark) -> DataFrame:
    """A small matrix as i, j, prob rows."""
    return spark.createDataFrame([(i, j, float(x)) for i, row in enumerate(t) for j, x in enumerate(row)], "i int, j int, prob double")
