"""Balanced partitions of sequence lengths and dynamic micro-batches.

Partitioning is a sequential algorithm on one batch of lengths; batches are
independent, so each is one group of ``applyInArrow`` (a batch has a bounded size).

Defined cases: null lengths count 0; lengths of 0 fill parts too; a batch with fewer rows than parts
has a part for each row; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differencing(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Largest differencing: the two states of the widest spread are merged, heaviest part
    with lightest. With ``equal_size`` all parts get as many items."""
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    states: list[tuple[int, int, list[tuple[int, list[int]]]]] = []
    serial = 0

    def push(parts):
        nonlocal serial
        parts = sorted(parts, key=lambda p: (-p[0], p[1]))
        heapq.heappush(states, (-(parts[0][0] - parts[-1][0]), serial, parts))
        serial += 1

    if equal_size:
        if len(lengths) % k:
            raise ValueError("parts of equal size need a multiple of k items")
        for low in range(0, len(order), k):
            push([(lengths[i], [i]) for i in order[low : low + k]])
    else:
        for i in order:
            push([(lengths[i], [i])] + [(0, []) for _ in range(k - 1)])
    while len(states) > 1:
        _, _, a = heapq.heappop(states)
        _, _, b = heapq.heappop(states)
        push([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)])
    return [sorted(p[1]) for p in states[0][2]] if states else [[] for _ in range(k)]


def greedy(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """In input order, each item to the lightest part (of fewest items first if equal)."""
    parts: list[list[int]] = [[] for _ in range(k)]
    sums = [0] * k
    bias = (sum(lengths) + 1) if equal_size else 0
    for i, n in enumerate(lengths):
        at = min(range(k), key=lambda p: (sums[p], p))
        parts[at].append(i)
        sums[at] += n + bias
    return parts


def balanced(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Differencing, checked: every item once, no part empty. A part that got nothing (as
    lengths of 0 allow) takes the shortest item of a part that has several."""
    if len(lengths) < k:
        raise ValueError(f"{len(lengths)} items cannot fill {k} parts")
    parts = differencing(lengths, k, equal_size)
    for p in range(k):
        if not parts[p]:
            giver = max((q for q in range(k) if len(parts[q]) > 1), key=lambda q: (-min(lengths[i] for i in parts[q]), len(parts[q]), -q))
            item = min(parts[giver], key=lambda i: (lengths[i], i))
            parts[giver].remove(item)
            parts[p].append(item)
    if sorted(i for p in parts for i in p) != list(range(len(lengths))) or not all(parts):
        raise AssertionError("parts do not cover the items")
    return parts


def _per_batch(df: DataFrame, batch: str, id: str, length: str, divide) -> DataFrame:  # noqa: A002
    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("id").to_pylist(), t.column("n").to_pylist(), strict=True))
        parts = divide([n for _, n in rows])
        part = {i: p for p, items in enumerate(parts) for i in items}
        b = t.column("batch")[0].as_py()
        return pa.table([pa.array([b] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([part[i] for i in range(len(rows))], pa.int32())], names=["batch", "id", "part"])

    rows = df.select(F.col(batch).cast("long").alias("batch"), F.col(id).cast("long").alias("id"), F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("n"))
    return rows.groupBy("batch").applyInArrow(run, "batch long, id long, part int")


def balance(df: DataFrame, batch: str, id: str, length: str, parts: int, equal_size: bool = False) -> DataFrame:  # noqa: A002
    """batch, id, part: balanced parts of each batch. A batch with fewer rows than ``parts`` (the
    last one) has a part for each row. Null lengths count 0."""
    return _per_batch(df, batch, id, length, lambda n: balanced(n, min(parts, len(n)), equal_size and len(n) >= parts))


def micro_batches(df: DataFrame, batch: str, id: str, length: str, max_tokens: int) -> DataFrame:  # noqa: A002
    """As many parts as the tokens need, heaviest (by squared lengths) first."""

    def divide(n: list[int]) -> list[list[int]]:
        parts = balanced(n, min(len(n), max(1, math.ceil(sum(n) / max_tokens))))
        return sorted(parts, key=lambda p: -sum(n[i] ** 2 for i in p))

    return _per_batch(df, batch, id, length, divide)


def restored(df: DataFrame, batch: str, id: str = "row_id") -> DataFrame:  # noqa: A002
    """Rows of micro-batches in their order before they were dealt out."""
    return df.orderBy(batch, id).drop("part")


def imbalance(df: DataFrame, part: str, length: str, balanced: str | None = None) -> DataFrame:
    """Smallest and largest token sums of the parts, their difference and their mean; with
    ``balanced`` (another part column) the smallest and largest sums of those parts too."""
    sums = df.groupBy(part).agg(F.sum(length).alias("s"))
    out = sums.agg(F.min("s").alias("min"), F.max("s").alias("max"), (F.max("s") - F.min("s")).alias("difference"), F.avg("s").alias("mean"))
    if balanced is None:
        return out
    even = df.groupBy(balanced).agg(F.sum(length).alias("s")).agg(F.min("s").alias("balanced_min"), F.max("s").alias("balanced_max"))
    return out.crossJoin(even)  # one row each
