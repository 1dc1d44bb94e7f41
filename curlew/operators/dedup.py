"""De-duplication of embeddings: leaders in row order, and buckets of rounded vectors.

Defined cases: rows without an id or a vector, and zero vectors, are near nothing and stay;
ties go to the smaller id; an empty table gives no row; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance, rounded
from ..storage import dealt, staged
from .neighbours import BLOCK, CHUNKS, _Side, _single, chunk_row, ids_of, in_worker, near_pairs, packed, rows_of, side_of, tiles

PIECE = 2048  # rows of a chunk that is judged by leaders
ROUND = 32_768  # about so many rows that no earlier leader is near come to one task


def _settled_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b, state of a), sorted by b and a, of a range of b: states of its rows, in
    ascending order, as far as those that they depend on are known or in the same range."""
    known: dict[int, int] = {}
    row, hit, free, own = None, False, True, 0
    out: list[tuple[int, int]] = []

    def close() -> None:
        if row is not None:
            known[row] = own or (2 if hit else 1 if free else 0)
            out.append((row, known[row]))

    def given() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[], []]
        made = pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32())], names=["id", "now"])
        out.clear()
        return made

    for batch in batches:
        for a, b, sa, sb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != row:
                close()
                row, hit, free, own = b, False, True, sb
            state = sa or known.get(a, 0)
            hit, free = hit or state == 1, free and state == 2
        if len(out) >= 10_000:
            yield given()
    close()
    yield given()


def leaders(df: DataFrame, id: str, pairs: DataFrame) -> DataFrame:  # noqa: A002
    """Rows kept by the rule: in ascending id, a row stays unless an earlier row that
    stayed is near it (``pairs(a, b)``, a < b). Settled in rounds: links are dealt out by
    ranges of the later id and each range is walked in order, so that chains within a range
    settle in one round, whatever their length; a round settles at least the first open row.
    Each round is written, so that lineage stays short. Every round settles a row, so the
    rounds end; none are cut off."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = staged(pairs.select("a", "b").distinct())
    later = links.select("b").distinct()
    first = links.select(F.col("a").alias("id")).distinct().join(later, F.col("id") == F.col("b"), "left_anti")
    # 0 open, 1 stays, 2 gone. Rows without an earlier neighbour stay.
    state = staged(first.select("id", F.lit(1).alias("s")).union(later.select("b", F.lit(0))))
    while not state.filter("s = 0").isEmpty():
        seen = links.join(state.toDF("a", "sa"), "a").join(state.toDF("b", "sb"), "b").filter("sb = 0")
        dealt_out = seen.select("a", "b", "sa", "sb").repartitionByRange(n, "b").sortWithinPartitions("b", "a")
        now = dealt_out.mapInArrow(_settled_in_order, "id long, now int")
        state = staged(state.join(now, "id", "left").select("id", F.coalesce("now", "s").alias("s")))
    gone = state.filter("s = 2").select(F.col("id").alias("_gone"))
    return df.join(gone, df[id].cast("long") == gone["_gone"], "left_anti")


def _near_any(rows: _Side, leads: _Side, threshold: float) -> np.ndarray:
    """Which rows are near one of the leads at least."""
    out, slack, n = np.zeros(len(rows.ids), bool), rows.slack(leads), len(leads.ids)
    for low in range(0, len(out), 256):
        high = min(len(out), low + 256)
        found = rows.closeness(low, high, leads, 0, n)
        best = found.max(axis=1, initial=-2)
        out[low:high] = best >= threshold + slack
        open_ = np.flatnonzero((best >= threshold - slack) & ~out[low:high])
        if len(open_):  # single precision does not tell
            x, y = np.nonzero(found[open_] >= threshold - slack)
            out[low + open_[x[1 - rows.distances(low + open_[x], leads, y) >= threshold]]] = True
    return out


def _left_open(kind: str, threshold: float):
    """Of each chunk, the rows that none of the leaders beside it is near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, v = None, None, None
        for row in rows_of(batches):
            if last is None or last["chunk"].as_py() != row["chunk"].as_py():
                if last is not None and len(ids):
                    yield chunk_row(last, ids, v)
                last, ids = row, np.frombuffer(row["ids"].as_buffer(), np.int64)
                v = np.frombuffer(row["vs"].as_buffer(), kind).reshape(len(ids), -1)
            if len(ids):
                left = ~_near_any(_Side(ids, v, "cosine"), side_of(row, kind, "cosine", "l_"), threshold)
                ids, v = ids[left], v[left]
        if last is not None and len(ids):
            yield chunk_row(last, ids, v)

    return run


def _settled(kind: str, threshold: float):
    """The leaders among chunks that come in order of their ids, and how many rows were seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[_Side] = []  # leaders of this round, BLOCK together
        ids, v, seen, last = np.zeros(0, np.int64), None, 0, None
        for row in rows_of(batches):
            last, side = row, side_of(row, kind, "cosine")
            new = np.frombuffer(row["vs"].as_buffer(), kind).reshape(len(side.ids), -1)
            v = new[:0] if v is None else v
            seen += len(side.ids)
            leads = [*whole, *([_Side(ids, v, "cosine")] if len(ids) else [])]
            left = np.ones(len(side.ids), bool)
            for other in leads:
                left &= ~_near_any(side, other, threshold)
            side, new = _Side(side.ids[left], new[left], "cosine"), new[left]
            n, slack = len(side.ids), side.slack(side)
            found = side.closeness(0, n, side, 0, n)
            near = found >= threshold + slack
            x, y = np.nonzero((found >= threshold - slack) & ~near)
            near[x, y] = 1 - side.distances(x, side, y) >= threshold
            stays = np.ones(n, bool)
            for i in range(n):
                if stays[i]:
                    stays[i + 1 :] &= ~near[i, i + 1 :]
            ids, v = np.concatenate([ids, side.ids[stays]]), np.concatenate([v, new[stays]])
            while len(ids) >= BLOCK:
                whole.append(_Side(ids[:BLOCK], v[:BLOCK], "cosine"))
                yield chunk_row(row, ids[:BLOCK], v[:BLOCK], seen=seen)
                ids, v, seen = ids[BLOCK:], v[BLOCK:], 0
        if last is not None:
            yield chunk_row(last, ids, v, seen=seen)

    return run


def leader_dedup(df: DataFrame, id: str, vector: str, threshold: float) -> DataFrame:  # noqa: A002
    """Leader de-duplication by cosine, over all rows. Equal vectors are one row from the start: a
    copy goes with its first, which is at least as early. The others come in rounds of ascending
    ids: chunks are judged by all earlier leaders, in parallel, and what is left is settled in
    order by one task. The first round has 8,192 rows; the next ones are so long that some
    32,768 rows are left over at the rate at which the last one found leaders. So pairs are
    never written, and work is rows times leaders. Ids of several rows and vectors of several
    lengths go by pairs."""
    direction = F.exists(vector, lambda x: x != 0)
    firsts = df.filter(F.col(id).isNotNull() & direction).groupBy(vector).agg(F.min(id).alias("_first")).select("_first")
    rest = df.join(firsts, F.col(id) == F.col("_first"), "left_semi").unionByName(df.filter(F.col(id).isNull() | ~F.coalesce(direction, F.lit(False))))
    rest = staged(rest)
    kind = "f4" if _single(rest, vector) else "f8"
    chunks = packed(rest.select(F.col(id).alias("id"), F.col(vector).alias("v")), PIECE, kind, ordered=True)
    twice = not ids_of(chunks).groupBy("id").count().filter("count > 1").isEmpty()
    if twice or chunks.select("n").distinct().count() > 1:
        return leaders(rest, id, near_pairs(rest, id, vector, threshold))
    pieces = chunks.select("chunk", "rows").orderBy("chunk").collect()  # a row for each 2,048 vectors
    found, at, take = None, 0, 4
    while at < len(pieces):
        now = pieces[at : at + take]
        part = chunks.filter(f"chunk BETWEEN {now[0].chunk} AND {now[-1].chunk}")
        if found is not None:
            part = tiles(part, found.drop("seen"), parts=1).mapInArrow(in_worker(_left_open(kind, threshold)), CHUNKS)
        new = staged(part.repartition(1).sortWithinPartitions("chunk").mapInArrow(in_worker(_settled(kind, threshold)), f"{CHUNKS}, seen long"), large=True)
        kept = new.agg(F.sum("rows")).first()[0] or 0
        found = new if found is None else found.unionByName(new)
        rate = max(kept, 1) / sum(p.rows for p in now)
        at, take = at + take, max(1, min(8 * take, int(ROUND / rate / PIECE)))
    if found is None:
        return rest
    gone = ids_of(chunks).join(ids_of(found).toDF("_kept"), F.col("id") == F.col("_kept"), "left_anti").select(F.col("id").alias("_gone"))
    return rest.join(gone, rest[id].cast("long") == gone["_gone"], "left_anti")


def bucket_dedup(df: DataFrame, id: str, vector: str, threshold: float, digits: int = 2) -> DataFrame:  # noqa: A002
    """Rows with equal rounded vectors are compared with the first of them only; one that is
    near it goes."""
    rows = df.withColumn("_bucket", rounded(vector, digits))
    first = rows.groupBy("_bucket").agg(F.min_by(vector, id).alias("_lead"), F.min(id).alias("_id"))
    far = (F.col(id) == F.col("_id")) | (1 - cosine_distance(vector, "_lead") < threshold)
    return rows.join(dealt(first), "_bucket").filter(far).drop("_bucket", "_lead", "_id")
