"""Clusters of bounded size and the merge prompts made from them.

Defined cases: rows without an id or a vector are in no cluster; a block too small for the least
size makes one smaller cluster; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import qa_pair

SIMILARITIES = 4_000_000  # numbers held at a time


def sample_capacities(n: int, low: int, high: int, mean: float, std: float, seed: int = 42) -> list[int]:
    """Cluster sizes between ``low`` and ``high`` that add up to ``n``, near a normal
    distribution. Raises if no such sizes exist."""
    if n == 0:
        return []
    if not 0 < low <= high or math.ceil(n / high) > n // low:
        raise ValueError(f"{n} rows cannot be split into clusters of {low} to {high}")
    rng, sizes, left = np.random.default_rng(seed), [], n
    while left:
        size = int(np.clip(round(rng.normal(mean, std)), low, high))
        rest = left - size
        # What is left must again be splittable.
        while rest and (rest < 0 or math.ceil(rest / high) > rest // low):
            size = size - 1 if size > low else high + 1
            if size > high:
                size = next(s for s in range(low, high + 1) if left - s == 0 or left > s and math.ceil((left - s) / high) <= (left - s) // low)
            rest = left - size
        sizes.append(size)
        left -= size
    rng.shuffle(sizes)
    return sizes


def block_capacities(n: int, low: int, high: int, mean: float, std: float, seed: int = 42) -> list[int]:
    """As ``sample_capacities``; rows that no such sizes hold (fewer than ``low``, or between
    multiples) share the fewest clusters of at most ``high``, as evenly as they go."""
    try:
        return sample_capacities(n, low, high, mean, std, seed)
    except ValueError:
        k = math.ceil(n / high)
        return [n // k + (i < n % k) for i in range(k)]


def centres(df: DataFrame, vector: str, k: int, seed: int = 42, iterations: int = 20) -> np.ndarray:
    """k-means centres of unit length (k rows on the driver)."""
    rows = df.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    found = np.array(KMeans(k=k, seed=seed, maxIter=iterations).fit(rows).clusterCenters())
    size = np.linalg.norm(found, axis=1, keepdims=True)
    return found / np.where(size > 0, size, 1)


def similarities(df: DataFrame, id: str, vector: str, middle: np.ndarray, top: int) -> DataFrame:  # noqa: A002
    """id, centre, similarity: the ``top`` nearest centres of each row. Rows without an id or a
    vector, or with one of another length than the centres, have none."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            size = np.linalg.norm(v, axis=1, keepdims=True)
            s = v / np.where(size > 0, size, 1) @ middle.T
            at = np.argsort(-s, 1, kind="stable")[:, :top]
            ids = np.repeat(b.column(0).to_numpy(), at.shape[1])
            yield pa.record_batch([pa.array(ids), pa.array(at.ravel().astype("i4")), pa.array(np.take_along_axis(s, at, 1).ravel())], names=["id", "centre", "similarity"])

    rows = df.select(F.col(id).cast("long"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col(id).isNotNull() & (F.size("v") == middle.shape[1]) & ~F.exists("v", lambda x: x.isNull()))
    return rows.mapInArrow(run, "id long, centre int, similarity double")


def _sliced(n: int, clusters: int):
    """Ranges of rows whose similarities to all clusters take some 32 MB."""
    step = max(1, SIMILARITIES // max(clusters, 1))
    return [slice(low, low + step) for low in range(0, n, step)]


def constrained_assign(ids: np.ndarray, similar: Callable[[np.ndarray | slice], np.ndarray], capacities: list[int]) -> np.ndarray:
    """Rows in falling order of their best similarity take the nearest centre with room.
    ``similar`` gives the similarities of some rows to all centres."""
    room, out = np.array(capacities), np.full(len(ids), -1)
    full = np.where(room > 0, 0.0, -np.inf)
    slices = _sliced(len(ids), len(room))
    best = np.concatenate([similar(at).max(1) for at in slices]) if slices else np.zeros(0)
    order = np.lexsort((ids, -best))
    for at in slices:
        for i, s in zip(order[at], similar(order[at]), strict=True):
            c = (s + full).argmax()
            if room[c] > 0:
                room[c] -= 1
                out[i] = c
                if not room[c]:
                    full[c] = -np.inf
    return out


def capacity_clusters(df: DataFrame, id: str, vector: str, block: str, low: int, high: int, mean: float, std: float, seed: int = 42) -> DataFrame:  # noqa: A002
    """id, block, cluster. The assignment is sequential by nature, so it runs per block (a
    data set, or a hash bucket of bounded size), in parallel over blocks."""

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        v = t.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        ids = ids[order]
        size = np.linalg.norm(v, axis=1, keepdims=True)
        v = v / np.where(size > 0, size, 1)
        sizes = block_capacities(len(ids), low, high, mean, std, seed)
        rng = np.random.default_rng(seed)
        mid = v[rng.choice(len(ids), len(sizes), replace=False)]
        for _ in range(10):  # k-means within the block
            near = np.concatenate([(v[at] @ mid.T).argmax(1) for at in _sliced(len(v), len(mid))])
            sums = np.zeros_like(mid)
            np.add.at(sums, near, v)
            n = np.linalg.norm(sums, axis=1, keepdims=True)
            mid = np.where(n > 0, sums / np.where(n > 0, n, 1), mid)
        found = constrained_assign(ids, lambda at: v[at] @ mid.T, sizes)
        return pa.table([pa.array(ids), pa.array([t.column("block")[0].as_py()] * len(ids), pa.string()), pa.array(found.astype("i4"))], names=["id", "block", "cluster"])

    rows = df.select(F.col(id).cast("long").alias("id"), F.col(block).cast("string").alias("block"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))
    return rows.groupBy("block").applyInArrow(run, "id long, block string, cluster int")


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))


def size_histogram(df: DataFrame, cluster: str) -> DataFrame:
    """How many clusters there are of each size."""
    return cluster_sizes(df, cluster).groupBy("size").agg(F.count(F.lit(1)).alias("clusters"))


def merge_groups(df: DataFrame, cluster: str, id: str, prompt: str, answer: str, dataset: str, separator: str = "\n\n", instruction: str = "") -> DataFrame:  # noqa: A002
    """One row per cluster: its question-answer pairs in row order, joined. Clusters are
    bounded by their capacity, so a group's text is too."""
    rows = df.filter(F.col(cluster).isNotNull()).withColumn("_pair", F.struct(F.col(id).alias("k"), qa_pair(prompt, answer).alias("t")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("_pair")), lambda p: p["t"]), separator)
    return rows.groupBy(F.col(cluster).alias("cluster_label")).agg(F.min_by(dataset, id).alias("dataset"), text.alias("input")).withColumn("instruction", F.lit(instruction))


def size_summary(df: DataFrame, cluster: str) -> DataFrame:
    """Number of clusters, and mean, deviation, least, quartiles and largest of their sizes."""
    quarter = lambda q: F.percentile("size", q)  # noqa: E731  one row per cluster
    return cluster_sizes(df, cluster).agg(
        F.count(F.lit(1)).alias("count"), F.avg("size").alias("mean"), F.stddev_samp("size").alias("std"), F.min("size").alias("min"), quarter(0.25).alias("q1"), quarter(0.5).alias("median"), quarter(0.75).alias("q3"), F.max("size").alias("max")
    )
