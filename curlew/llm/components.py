"""Connected components of a link table, without ever gathering it in one place.

Alternating large-star and small-star steps: each node hands its neighbours to the
smallest node it knows. A node's smallest neighbour comes from an aggregation with
partial sums and goes back by a join that Spark can split, so a node with very many
links makes no large task. Each round is written to the shared folder.

A table of few links (``FEW``, counted before) is settled by one task instead, with the same
result: rounds cost many jobs, whatever they move.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import apart, dropped, staged, tidy

FEW = 200_000  # links that one task may hold, some 40 MB


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and component, by a union of all links (a, b)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            root[max(x, y)] = min(x, y)
    nodes = list(root)
    for low in range(0, len(nodes), 10_000):
        part = nodes[low : low + 10_000]
        yield pa.record_batch([pa.array(part, pa.int64()), pa.array(map(find, part), pa.int64())], names=["node", "component"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges(a, b)`` with a > b. Large star: every larger neighbour of a node links to
    the smallest node around it. Small star: every smaller neighbour, and the node."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(apart(least), "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for each node that has a
    link to another one. Nodes are long integers. Null ends and loops are no links."""
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a != b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = staged(edges, "links")
    before = _signature(edges)
    if before[0] <= FEW:
        return edges.coalesce(1).mapInArrow(tidy(_settled), "node long, component long")
    for _ in range(max_rounds):
        if not before[0]:
            break
        earlier, edges = edges, staged(_star(_star(edges, True), False), "links")
        now = _signature(edges)
        dropped(edges.sparkSession, earlier)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select("b", "b").distinct())
