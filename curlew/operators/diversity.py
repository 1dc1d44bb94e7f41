"""Long-tail diversity: scores, normalisation, ranks, stratified selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import staged
from .neighbours import knn_edges


def long_tail(df: DataFrame, id: str, vector: str, k: int = 15, metric: str = "cosine") -> DataFrame:  # noqa: A002
    """id and ``score``: mean distance to the ``k`` nearest other rows; 0 for a single row."""
    edges = knn_edges(df, id, vector, k, metric)
    mean = edges.groupBy("id").agg(F.avg("distance").alias("score"))
    return df.select(F.col(id).cast("long").alias("id")).join(mean, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def rarity(df: DataFrame, id: str, vector: str, k: int = 10) -> DataFrame:  # noqa: A002
    """Mean distance to the ``k`` nearest rows, itself among them, mapped to 0..1."""
    edges = knn_edges(df, id, vector, k, include_self=True)
    return edges.groupBy("id").agg(F.avg("distance").alias("d")).select("id", F.bround(2 / (1 + F.exp(-F.col("d"))) - 1, 4).alias("rare_score"))


def min_max(df: DataFrame, value: str, out: str) -> DataFrame:
    """``value`` mapped to 0..1 over the whole table; 0 where all are equal. The two
    numbers are one broadcast row: no window over a single partition."""
    span = df.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    norm = F.when(F.col("_high") > F.col("_low"), (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(F.lit(0.0))
    return df.crossJoin(F.broadcast(span)).withColumn(out, norm).drop("_low", "_high")


def final_rank(df: DataFrame, quality: str, score: str, id: str, out: str = "final_rank") -> DataFrame:  # noqa: A002
    """1-based place by quality (missing last), then score, both falling, then id. Ranks
    come from a distributed sort: places within ranges plus the sizes of earlier ranges."""
    order = [F.desc_nulls_last(quality), F.desc_nulls_last(score), F.asc(id)]
    return place(df, order, out)


def place(df: DataFrame, order: list, out: str, within: str | None = None) -> DataFrame:
    """1-based place in a total order, over the table or ``within`` each value of a column,
    without one task that holds a whole group: a range-partitioned sort, places within
    each partition, and the sizes of the partitions before. The sizes have a row per
    partition and value."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(within) if within else F.lit(0)
    rows = df.withColumn("_key", key)
    ranged = rows.repartitionByRange(n, F.col("_key"), *order).withColumn("_part", F.spark_partition_id())
    # Both uses must see the same partitions, so the ranged rows are written once.
    ranged = staged(ranged)
    local = ranged.withColumn("_row", F.row_number().over(W.partitionBy("_key", "_part").orderBy(*order)))
    sizes = ranged.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(F.col("_key").alias("_k"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = local.join(sizes, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(out, (F.col("_before") + F.col("_row")).cast("long")).drop("_key", "_part", "_row", "_k", "_p", "_before")


def stratified_top(df: DataFrame, stratum: str, score: str, id: str, share: float) -> DataFrame:  # noqa: A002
    """Of each stratum (missing: ``unknown``) the ``max(1, ceil(m * share))`` rows with the
    highest score."""
    key = F.coalesce(F.col(stratum).cast("string"), F.lit("unknown"))
    rows = df.withColumn("_stratum", key)
    sizes = rows.groupBy(F.col("_stratum").alias("_s")).agg(F.count(F.lit(1)).alias("_m"))
    ranked = place(rows, [F.desc(score), F.asc(id)], "_place", within="_stratum")
    keep = F.greatest(F.lit(1), F.ceil(F.col("_m").cast("double") * F.lit(float(share))))
    return ranked.join(sizes, F.col("_stratum") == F.col("_s")).filter(F.col("_place") <= keep).drop("_stratum", "_place", "_s", "_m")


def long_tail_selection(df: DataFrame, id: str, vector: str, stratum: str, k: int = 15, share: float = 0.35) -> DataFrame:  # noqa: A002
    """Scores, normalised scores and the stratified selection in one plan."""
    scored = df.select(F.col(id).cast("long").alias("id"), F.col(stratum).alias("stratum")).join(long_tail(df, id, vector, k), "id")
    return stratified_top(min_max(scored, "score", "norm"), "stratum", "score", "id", share)
