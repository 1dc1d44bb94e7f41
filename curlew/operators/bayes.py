"""Scored libraries and Bayes rewards from neighbours' scores.

Defined cases: rows whose score is no number are left out of a library; a query without a vector
has no reward; ties between neighbours go to the smaller id; an empty library gives no
reward (``with_default`` gives 0.5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .neighbours import nearest
from .noise import class_prior, transition_matrix


def class_index(df: DataFrame, value: str) -> DataFrame:
    """Distinct values in ascending order with their number from 0."""
    distinct = df.select(F.col(value).alias("value")).filter(F.col("value").isNotNull()).distinct()
    return distinct.withColumn("class", (F.row_number().over(W.orderBy("value")) - 1).cast("int"))  # as many rows as classes


def posterior(histogram: DataFrame, transition: DataFrame, prior: DataFrame) -> DataFrame:
    """q, i, post: posterior of class i for query q from ``histogram(q, j, h)``:
    ln p_i + sum of h_j ln T_ij, as a softmax. The matrices are small and broadcast."""
    log_t = F.broadcast(transition.select("i", "j", F.log(F.col("prob") + 1e-12).alias("lt")))
    scored = histogram.join(log_t, "j").groupBy("q", "i").agg(F.sum(F.col("h") * F.col("lt")).alias("s"))
    scored = scored.join(F.broadcast(prior.select(F.col("y").alias("i"), F.log(F.col("p") + 1e-12).alias("lp"))), "i").withColumn("s", F.col("s") + F.col("lp"))
    w = W.partitionBy("q")
    e = scored.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    return e.select("q", "i", (F.col("e") / F.sum("e").over(w)).alias("post"))


def entropy(post: DataFrame) -> DataFrame:
    return post.groupBy("q").agg((-F.sum(F.col("post") * F.log(F.col("post") + 1e-12))).alias("entropy"))


def value_reward(post: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """q, expected, reward: expected class value; 1 from 4 on, .3 at exactly 3, else 0."""
    rows = post.join(F.broadcast(values.select(F.col("class").alias("i"), "value")), "i") if values is not None else post.withColumn("value", F.col("i"))
    mean = rows.groupBy("q").agg(F.sum(F.col("value") * F.col("post")).alias("expected"))
    return mean.withColumn("reward", F.when(F.col("expected") >= 4, 1.0).when(F.col("expected") == 3, 0.3).otherwise(0.0))


def build_library(df: DataFrame, id: str, vector: str, score: str, classes: int, k: int = 8, metric: str = "cosine") -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: A002
    """Library rows, transition matrix of their scores, and prior."""
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"), F.bround(F.col(score).try_cast("double")).cast("int").alias("y")).filter("y IS NOT NULL")
    edges = nearest(rows, rows, k, metric, drop_self=True)
    labels = rows.select("id", "y")
    return rows, transition_matrix(edges, labels, classes), class_prior(labels, classes)


def score_queries(queries: DataFrame, library: tuple[DataFrame, DataFrame, DataFrame], k: int = 16, metric: str = "cosine") -> DataFrame:
    """Rewards of ``queries(id, v)`` from the scores of their ``k`` nearest library rows."""
    rows, t, p = library
    near = nearest(queries, rows, k, metric)
    labels = rows.select(F.col("id").alias("neighbour"), F.col("y").alias("j"))
    histogram = near.join(labels, "neighbour").groupBy(F.col("id").alias("q"), "j").agg(F.count(F.lit(1)).alias("h"))
    return value_reward(posterior(histogram, t, p))


def with_default(queries: DataFrame, rewards: DataFrame, default: float = 0.5) -> DataFrame:
    """q and reward of every row of ``queries(id)``; those that no library scored (none for their
    task, or an empty one) have the default."""
    return queries.select(F.col("id").alias("q")).join(rewards.select("q", "reward"), "q", "left").select("q", F.coalesce("reward", F.lit(default)).alias("reward"))


def write_library(library: tuple[DataFrame, DataFrame, DataFrame], task: str, folder: str) -> None:
    for part, df in zip(("rows", "transition", "prior"), library, strict=True):
        df.withColumn("task", F.lit(task)).write.mode("append").partitionBy("task").parquet(f"{folder}/{part}")


def read_library(spark, folder: str, task: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{folder}/{part}").filter(F.col("task") == task).drop("task") for part in ("rows", "transition", "prior"))
