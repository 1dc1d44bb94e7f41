"""Embedding near-duplicates by tiled comparison in PCA order.

Vectors are rotated to the principal axes of all vectors, so that the leading
dimensions carry most of the length. Tiles of one label are compared: products of the
leading dimensions are accumulated first, the rest of each product is bounded by the
norms of what is left (suffix norms), and a pair is dropped as soon as that bound
cannot reach the threshold. Pairs that survive are verified by the cosine of the
original vectors in double precision.

Equal vectors of a label are one row of the comparison. A tile reports link counts and
a spanning forest of its links, never its pairs, so that a large group of near copies
stays small; components run on the forests.

Tiles are cut along the angle to the first axis: two vectors whose angles to it differ by
more than the threshold's own angle cannot reach it, so tiles that lie that far apart never
meet. Within that reach the work is quadratic in the number of different vectors of a
label, as an exact comparison of all of them is; a tile pair has a bounded size and is one
task's group.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite
component, and any vector with a null label, links with nothing and is its own
component; vectors of different lengths never link; a null vec_id is left out (it
cannot name a component); equal vec_ids are rows of their own that share the id; an
empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import short_batches, staged, table, tidy

TILE = 2048
STRIPE = 512
SUMS = 16  # partial sums of matrices that reach the driver, for each vector length


def principal_axes(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length, the axes (columns) of all unit vectors by falling
    variance. Each task adds up one matrix, executors add those in groups, and the driver
    gets at most ``SUMS`` of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            by_length: dict[int, list[np.ndarray]] = {}
            for x in batch.column(0).to_pylist():
                v = np.array(x)
                by_length.setdefault(len(v), []).append(v / np.linalg.norm(v))
            for n, vs in by_length.items():
                m = np.array(vs)
                totals[n] = totals.get(n, 0) + m.T @ m
        for n, m in totals.items():
            yield pa.record_batch([pa.array([n], pa.int32()), pa.array([m.ravel()], pa.list_(pa.float64()))], names=["n", "m"])

    def add(group: pa.Table) -> pa.Table:
        m = sum(x.values.to_numpy() for x in group.column("m"))
        return pa.table([pa.array([group.column("n")[0].as_py()], pa.int32()), pa.array([m], pa.list_(pa.float64()))], names=["n", "m"])

    parts = rows.select("v").mapInArrow(tidy(run), "n int, m array<double>").withColumn("g", F.spark_partition_id() % SUMS)
    found: dict[int, np.ndarray] = {}
    for r in parts.groupBy("n", "g").applyInArrow(lambda t: add(t.drop_columns(["g"])), "n int, m array<double>").collect():
        found[r.n] = found.get(r.n, 0) + np.array(r.m).reshape(r.n, r.n)
    return {n: np.linalg.eigh(m)[1][:, ::-1] for n, m in found.items()}


def _with_bins(rows: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """Adds ``bin``: the angle to the first axis in steps of the threshold's angle (and a little
    more, for rounding). Vectors that reach the threshold are in one bin or in two next to
    each other."""
    width = max(float(np.arccos(min(threshold, 1.0))), 1e-3) * (1 + 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = []
            for x in batch.column("v"):
                v = x.values.to_numpy()
                bins.append(int(np.arccos(np.clip(v @ axes[len(v)][:, 0] / np.linalg.norm(v), -1, 1)) / width))
            yield pa.record_batch([*batch.columns, pa.array(bins, pa.int32())], names=[*batch.schema.names, "bin"])

    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields, T.StructField("bin", T.IntegerType())]))


def tile_links(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of a, j of b) with a cosine of at least ``threshold``; if
    ``same``, a is b and i < j. Stripe by stripe."""
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    pa_, pb = (a / na[:, None]) @ axes, (b / nb[:, None]) @ axes
    n = a.shape[1]
    stops = sorted({*(max(1, n * q // 8) for q in (2, 4, 6)), n})
    left = lambda p, s: np.sqrt(np.maximum((p[:, s:] ** 2).sum(1), 0))
    rest_a, rest_b = [left(pa_, s) for s in stops], [left(pb, s) for s in stops]
    for low in range(0, len(a), STRIPE):
        x = pa_[low : low + STRIPE]
        partial, at = np.zeros((len(x), len(b))), 0
        i = j = None
        for k, s in enumerate(stops):
            if i is None:
                partial += x[:, at:s] @ pb[:, at:s].T
                mask = partial + np.outer(rest_a[k][low : low + STRIPE], rest_b[k]) >= threshold - 1e-9
                if same:
                    mask &= np.arange(low, low + len(x))[:, None] < np.arange(len(b))[None, :]
                if s == n or mask.sum() * 10 < mask.size:
                    i, j = np.nonzero(mask)
                    sums = partial[i, j]
            else:
                sums = sums + np.einsum("ij,ij->i", x[i, at:s], pb[j, at:s])
                keep = sums + rest_a[k][low + i] * rest_b[k][j] >= threshold - 1e-9
                i, j, sums = i[keep], j[keep], sums[keep]
            at = s
        for cut in range(0, len(i), 65_536):
            p, q = low + i[cut : cut + 65_536], j[cut : cut + 65_536]
            exact = np.einsum("ij,ij->i", a[p], b[q]) / (na[p] * nb[q])
            yield p[exact >= threshold], q[exact >= threshold]


class Forest:
    """Union of links over nodes 0 .. n - 1, keeping only links that join two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                return
            high = np.maximum(a, b)
            _, first = np.unique(high, return_index=True)  # one link for each tree
            self.links += zip(i[first].tolist(), j[first].tolist(), strict=True)
            parent = np.arange(len(self.root))
            parent[high[first]] = np.minimum(a, b)[first]  # always towards smaller roots
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            self.root = parent[self.root]


def _compare(axes: dict[int, np.ndarray], threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        ids, copies = group.column("vec_id").to_numpy(), group.column("copies").to_numpy()
        dims = group.column("dim").to_numpy()
        out_a, out_b, out_n = [], [], []
        flat = group.column("v").combine_chunks()
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            v = flat.take(pa.array(rows)).flatten().to_numpy().reshape(-1, dim)
            first, second = np.flatnonzero(side[rows] == 0), np.flatnonzero(side[rows] == 1)
            same = group.column("i")[0].as_py() == group.column("j")[0].as_py()
            second = first if same else second
            if not len(first) or not len(second):
                continue
            degree, forest = np.zeros(len(rows), "i8"), Forest(len(rows))
            own = copies[rows]
            for p, q in tile_links(v[first], v[second], axes[int(dim)], threshold, same):
                p, q = first[p], second[q]
                np.add.at(degree, p, own[q])
                np.add.at(degree, q, own[p])
                forest.add(p, q)
            at = np.flatnonzero(degree)
            out_a += ids[rows[at]].tolist()
            out_b += [None] * len(at)
            out_n += degree[at].tolist()
            for p, q in forest.links:
                out_a.append(int(ids[rows[p]]))
                out_b.append(int(ids[rows[q]]))
                out_n.append(None)
        return pa.table([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_n, pa.int64())], schema=schema)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of
    ``vectors(vec_id, embedding, label)``. ``threshold`` is over 0."""
    short_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label")).filter("vec_id IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & finite
    key = F.sha2(F.array_join(F.transform("v", lambda x: F.hex(F.xxhash64(x))), ","), 256)
    valid = staged(rows.filter(sound).withColumn("key", key), "vectors")
    classes = valid.groupBy("label", "key").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    firsts = valid.join(classes.select(F.col("vec_id"), "label", "key", "copies"), ["vec_id", "label", "key"]).dropDuplicates(["vec_id", "label", "key"])
    firsts = staged(firsts, "first-vectors")
    axes = principal_axes(firsts)
    binned = staged(_with_bins(firsts, axes, threshold), "binned-vectors")
    # A bin has as many tiles as its vectors need. Tile numbers ascend with bins.
    sizes = binned.groupBy("label", "bin").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    number = lambda b, t: F.shiftleft(b.cast("long"), 32) + t
    own = number(F.col("bin"), F.pmod(F.xxhash64("vec_id"), F.col("tiles")))
    # A label has at most pi / (the threshold's angle) + 1 bins: its list of them is short.
    lists = sizes.groupBy("label").agg(F.collect_list(F.struct("bin", "tiles")).alias("bins"))
    placed = binned.join(sizes, ["label", "bin"]).withColumn("own", own).join(lists, "label")
    near = F.filter("bins", lambda x: F.abs(x["bin"] - F.col("bin")) <= 1)
    others = F.flatten(F.transform(near, lambda x: F.transform(F.sequence(F.lit(0), x["tiles"] - 1), lambda t: number(x["bin"], t))))
    dealt = placed.withColumn("other", F.explode(others)).select(
        "label",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
        "vec_id",
        "copies",
        F.size("v").alias("dim"),
        "v",
    )
    found = staged(dealt.groupBy("label", "i", "j").applyInArrow(_compare(axes, threshold), "a long, b long, n long"), "tile-links")
    degrees = found.filter("b IS NULL").groupBy(F.col("a").alias("first")).agg(F.sum("n").alias("n"))
    groups = components(found.filter("b IS NOT NULL").select("a", "b"))
    named = classes.select("label", "key", F.col("vec_id").alias("first"), "copies").join(degrees, "first", "left").join(groups.withColumnRenamed("node", "first"), "first", "left")
    linked = valid.join(named, ["label", "key"]).select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    alone = rows.filter(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


OP8_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), e AS (
    SELECT *, sqrt(list_dot_product(v, v)) AS size FROM v WHERE list_dot_product(v, v) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id != b.vec_id AND len(a.v) = len(b.v)
    WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.93
), reach(node, other) AS (
    SELECT a, a FROM links UNION SELECT l.b, r.other FROM reach r JOIN links l ON l.a = r.node
), c AS (
    SELECT node, min(other) AS component FROM reach GROUP BY node
), n AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id WHERE vec_id IS NOT NULL
"""
