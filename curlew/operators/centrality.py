"""LexRank centrality over a similarity graph, by power iterations on edges.

Defined cases: null ends are no links; a row without a partner scores 1; equal pairs add up; no
pairs and no ids give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import staged
from .neighbours import BLOCK, ids_of, in_worker, near_in_tile, near_pairs, pair_chunks, rows_of, side_of, tiles

LINKS = 500_000  # of a row of links, and 2 million at most
STATE = "chunk long, score binary, before binary, total binary, flow binary, change double"
STEPS = 6  # power iterations between two tables that are written


def lexrank(edges: DataFrame, ids: DataFrame | None = None, damping: float = 1.0, tolerance: float = 1e-6, max_rounds: int = 1000) -> DataFrame:
    """id and score of each node of ``edges(a, b, similarity)`` (undirected, each pair once;
    every node is similar 1 to itself) and of ``ids(id)``: a row without a partner keeps score
    1. Scores add up to the number of nodes. Raises if ``max_rounds`` do not converge."""
    both = edges.select("a", "b", "similarity").union(edges.select("b", "a", "similarity"))
    known = both.select(F.col("a").alias("id"))
    nodes = staged((known if ids is None else known.union(ids.select("id"))).distinct())
    links = both.toDF("a", "b", "w").union(nodes.select("id", F.col("id").alias("b"), F.lit(1.0)))
    out = links.groupBy("a").agg(F.sum("w").alias("t"))
    links = staged(links.join(out, "a").select("a", "b", (F.col("w") / F.col("t")).alias("p")))
    rank = staged(nodes.withColumn("score", F.lit(1.0)))

    def moved(rank: DataFrame) -> DataFrame:
        into = links.join(rank.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id"))
        return into.agg((F.lit(1 - damping) + damping * F.sum(F.col("p") * F.col("score"))).alias("score"))

    for _ in range(-(-max_rounds // STEPS)):
        last = rank
        for _ in range(STEPS - 1):
            last = moved(last)
        # One table of the last two steps: they tell whether scores still move.
        step = staged(last.join(moved(last).withColumnRenamed("score", "new"), "id"))
        rank = step.select("id", F.col("new").alias("score"))
        change = step.agg(F.max(F.abs(F.col("new") - F.col("score")))).first()[0]
        if change is None or change < tolerance:
            return rank
    raise RuntimeError("lexrank did not converge")


def _links(chunks: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Links of pairs of chunks, many to a row: positions in the chunk ``i``, in the chunk ``j``, and
    similarities. Each pair of rows is there once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(parts: list) -> pa.RecordBatch:
            x, y, s = (np.concatenate(p) for p in zip(*parts, strict=True))
            cells = [x.astype("u2").tobytes(), y.astype("u2").tobytes(), s.tobytes()]
            return pa.record_batch([pa.array([row["chunk"].as_py()]), pa.array([row["l_chunk"].as_py()]), *(pa.array([c], pa.binary()) for c in cells)], names=["i", "j", "x", "y", "w"])

        chunk, first = None, None
        for row in rows_of(batches):
            if chunk != row["chunk"].as_py():
                chunk, first = row["chunk"].as_py(), side_of(row, kind, "cosine")
            parts, held = [], 0
            for part in near_in_tile(first, side_of(row, kind, "cosine", "l_"), threshold, chunk == row["l_chunk"].as_py()):
                parts.append(part)
                held += len(part[0])
                if held > LINKS:
                    yield made(parts)
                    parts, held = [], 0
            if held:
                yield made(parts)

    return staged(tiles(chunks, chunks, "chunk <= l_chunk").mapInArrow(in_worker(run), "i long, j long, x binary, y binary, w binary"), large=True)


def _moved(links: DataFrame, state: DataFrame, damping: float, weight: float | None) -> DataFrame:
    """The next state of each chunk: scores, and on the first pass (no ``weight``) the sums of
    similarities. What flows along a row's links is its score over its sum; a step goes ``weight``
    times as far from the scores before the last ones."""

    def flows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for chunk in list(found):
                yield pa.record_batch([pa.array([chunk]), pa.array([found.pop(chunk).tobytes()], pa.binary())], names=["chunk", "part"])

        for row in rows_of(batches):
            at = {n: np.frombuffer(row[n].as_buffer(), t) for n, t in (("x", "u2"), ("y", "u2"), ("w", "f8"), ("i_flow", "f8"), ("j_flow", "f8"))}
            for chunk, to, of, flow, size in ((row["j"], "y", "x", "i_flow", "j_flow"), (row["i"], "x", "y", "j_flow", "i_flow")):
                part = np.bincount(at[to], at["w"] * at[flow][at[of]], len(at[size]))
                found[chunk.as_py()] = found.get(chunk.as_py(), 0) + part
            if len(found) > 256:
                yield from given()
        yield from given()

    def summed(_, own: pa.Table, parts: pa.Table) -> pa.Table:
        of = lambda name: np.frombuffer(own.column(name)[0].as_buffer(), "f8")
        total = of("flow").copy()  # every row is similar 1 to itself
        for p in parts.column("part"):
            total += np.frombuffer(p.as_buffer(), "f8")
        score = of("score")
        if weight is not None:
            score = of("before") + weight * (1 - damping + damping * total - of("before"))
            total = of("total")
        change = np.inf if weight is None else float(np.abs(score - of("score")).max())
        return pa.table([own.column("chunk"), *(pa.array([x.tobytes()], pa.binary()) for x in (score, of("score"), total, score / total)), pa.array([change])], names=["chunk", "score", "before", "total", "flow", "change"])

    ends = links
    for end in "ij":
        side = state.select(F.col("chunk").alias(f"{end}_chunk"), F.col("flow").alias(f"{end}_flow")).repartition(1)
        ends = ends.hint("shuffle_replicate_nl").join(side, F.col(end) == F.col(f"{end}_chunk"))
    parts = ends.mapInArrow(in_worker(flows), "chunk long, part binary")
    return staged(state.groupBy("chunk").cogroup(parts.groupBy("chunk")).applyInArrow(summed, STATE), large=True)


def lexrank_of_vectors(df: DataFrame, id: str, vector: str, threshold: float, damping: float = 1.0, tolerance: float = 1e-6, max_rounds: int = 1000, block: int = BLOCK) -> DataFrame:  # noqa: A002
    """As ``lexrank`` over the pairs with a cosine of at least ``threshold`` and the ids of ``df``.
    Links stay packed by pairs of chunks, 12 bytes each, and a step moves chunks of scores
    alone. Their number is that of the pairs, with the square of the rows. Ids of several rows go
    by pairs."""
    chunks, kind = pair_chunks(df, id, vector, min(block, 1 << 16))
    nodes = df.select(F.col(id).cast("long").alias("id")).filter("id IS NOT NULL").distinct()
    if not ids_of(chunks).groupBy("id").count().filter("count > 1").isEmpty():
        return lexrank(near_pairs(df, id, vector, threshold), nodes, damping, tolerance, max_rounds)
    links = _links(chunks, kind, threshold)

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ones = np.ones(row["rows"].as_py()).tobytes()
            yield pa.record_batch([pa.array([row["chunk"].as_py()]), *(pa.array([ones], pa.binary()) for _ in range(4)), pa.array([np.inf])], names=["chunk", "score", "before", "total", "flow", "change"])

    state = _moved(links, staged(chunks.select("chunk", "rows").mapInArrow(begun, STATE), large=True), damping, None)
    # Chebyshev's weights: similarities are symmetric and not negative, so what is left of an error in
    # a plain step has factors of at most the damping, and the same fixed point takes fewer steps.
    weight, fast = 1.0, 0 < damping < 1 and threshold >= 0
    for k in range(max_rounds):
        if k and fast:
            weight = 2 / (2 - damping**2) if k == 1 else 1 / (1 - damping**2 * weight / 4)
        state = _moved(links, state, damping, weight)
        change = state.agg(F.max("change")).first()[0]
        if change is None or change < tolerance:
            break
    else:
        raise RuntimeError("lexrank did not converge")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield pa.record_batch([pa.array(np.frombuffer(row["ids"].as_buffer(), np.int64)), pa.array(np.frombuffer(row["score"].as_buffer(), "f8"))], names=["_id", "score"])

    scores = chunks.select("chunk", "ids").join(state.select("chunk", "score"), "chunk").select("ids", "score").mapInArrow(told, "_id long, score double")
    return nodes.join(scores, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("score", F.lit(1.0)).alias("score"))
