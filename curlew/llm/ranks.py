"""Ranks from a distributed sort.

Rows are dealt into ranges of their key and sorted there; a pass over each sorted range
numbers its groups of equal keys and drops rows whose key no other row has. The range
bounds include further columns, so a key that very many rows share is spread over
several ranges; the driver sees the first and last row of each range (their number is
bounded by that of the shuffle's partitions) and joins groups that go on from one range
to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batches_of, partitions, staged, tidy

MARKS = "_part int, _number long, _edge int, _alone boolean, _first boolean"
NUMBER_WIDTH = 40  # bits of a group's number within its range
RANK_ROWS = 1 << 16  # rows of numbers in an Arrow batch


def _numbered(key: list[str], weight: str | None, keep_unique: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, held_new, number, begun = None, True, 0, False  # the last row, not yet given out

        def out(rows: pa.RecordBatch, numbers: np.ndarray, new: np.ndarray, next_new: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
            alone = new & next_new
            if weight:
                alone &= rows.column(weight).to_numpy() == 1
            marked = pa.record_batch(
                [*rows.columns, pa.array(np.full(len(new), part, np.int32)), pa.array(numbers), pa.array(edge), pa.array(alone), pa.array(new)],
                names=[*rows.schema.names, "_part", "_number", "_edge", "_alone", "_first"],
            )
            return marked if keep_unique else marked.filter(pa.array(~alone | (edge > 0)))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys = np.stack([rows.column(k).to_numpy() for k in key])
            new = np.concatenate(([held_new], (keys[:, 1:] != keys[:, :-1]).any(0)))
            numbers = number + np.cumsum(new) - int(held_new)
            last = len(new) - 1
            if last:
                edge = np.zeros(last, np.int32)
                edge[0] = 0 if begun else 1
                yield out(rows.slice(0, last), numbers[:last], new[:last], new[1:], edge)
                begun = True
            held, held_new, number = rows.slice(last), bool(new[last]), int(numbers[last])
        if held is not None:
            yield out(held, np.array([number]), np.array([held_new]), np.array([True]), np.array([2 if begun else 3], np.int32))

    return run


def _joins(edges: list, key: list[str]) -> list[tuple[int, int | None, bool]]:
    """For each range: the rank that its first group takes over (None: its own), and whether
    its last group goes on in the next."""
    firsts = {r["_part"]: r for r in edges if r["_edge"] & 1}
    lasts = {r["_part"]: r for r in edges if r["_edge"] & 2}
    out, before, rank_before = [], None, None
    for p in sorted(firsts):
        same = before is not None and all(firsts[p][k] == before[k] for k in key)
        if same:
            out[-1][2] = True
        out.append([p, rank_before if same else None, False])
        if lasts[p]["_number"] or not same:
            rank_before = (p << NUMBER_WIDTH) + lasts[p]["_number"]
        before = lasts[p]
    return [tuple(x) for x in out if x[1] is not None or x[2]]


def reranked(rows: DataFrame, key: list[str], kind: str, ties: list[str] = (), weight: str | None = None, keep_unique: bool = False, settle: bool = False) -> DataFrame:
    """``rows`` with ``rank`` (ascending with ``key``; equal for equal keys), ``alone`` (no other
    row has the key, and ``weight``, how many rows a row stands for, is 1) and ``first`` (true
    for one row of each rank). Rows that are alone are dropped unless ``keep_unique``.
    Columns of ``key`` and ``weight`` are integers without nulls; ``ties`` tell rows of one key
    apart, so that a hot key can lie in several ranges; ``settle``: which row of a rank is
    ``first`` depends on them too (else on chance, and the sort is cheaper)."""
    spark = rows.sparkSession
    sorted_ = rows.repartitionByRange(partitions(spark), *key, *ties).sortWithinPartitions(*key, *(ties if settle else ()))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    with batches_of(spark, RANK_ROWS):
        numbered = staged(sorted_.mapInArrow(tidy(_numbered(key, weight, keep_unique)), f"{ddl}, {MARKS}"), kind)
    edges = numbered.filter("_edge > 0").select("_part", "_number", "_edge", *key).collect()
    joins = spark.createDataFrame(_joins(edges, key), "_part int, _root long, _goes_on boolean")
    met = numbered.join(F.broadcast(joins), "_part", "left")  # at most one row for each partition
    joined = (F.col("_number") == 0) & F.col("_root").isNotNull()
    goes_on = (F.col("_edge") >= 2) & F.coalesce("_goes_on", F.lit(False))
    alone = F.col("_alone") & ~joined & ~goes_on
    rank = F.when(joined, F.col("_root")).otherwise(F.shiftleft(F.col("_part").cast("long"), NUMBER_WIDTH) + F.col("_number"))
    out = met.select(*rows.columns, rank.alias("rank"), alone.alias("alone"), (F.col("_first") & ~joined).alias("first"))
    return out if keep_unique else out.filter("NOT alone")
