"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Linear grouping: lengths above a bound are large. They are sorted, dealt into
groups of equal cardinality and rounded up to the largest length of their group, so
that only a few sizes remain. Column generation finds fractional numbers of
configurations (multisets of sizes that fit one sequence); whole parts are kept and
what is left over is placed best-fit. Actual documents then take the places of their
group, which frees what rounding had added, and the small lengths are placed best-fit
into the free space, longest first.

All of this runs on the counts of the ``capacity`` possible lengths: its cost and
memory do not depend on the number of documents. The plan is a list of runs (a
length, a range of ranks among the pieces of that length, the first sequence of as
many consecutive sequences, a place in them). Executors number the pieces of each
length and look the run up.

Defined cases: a null text is an empty text (one piece that holds the end id); a
null doc_id is kept; equal rows are packed as often as they occur; an empty table
gives no row; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import byte_bpe
from .shared import short_batches, staged, table, tidy

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# Pieces of one length are numbered in so many independent buckets.
BUCKETS = 1024


@dataclass
class Run:
    """Pieces of ``length`` ranked rank .. rank + n - 1 go to sequences seq .. seq + n - 1 at offset."""

    length: int
    rank: int
    n: int
    seq: int
    offset: int


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (count of each size) and how often to use them, whole parts of
    the linear programme's optimum by column generation."""
    k = len(sizes)
    fixed = np.array(sizes)  # longest first
    ascending = fixed[::-1]
    basis = np.zeros((k, k))
    for i, s in enumerate(sizes):
        basis[i, i] = capacity // s
    use = np.array(demand, float) / np.diag(basis)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(1, capacity + 1):
            best[c] = best[c - 1]
            fits = k - np.searchsorted(ascending, c, side="right")
            if fits < k:
                gain = best[c - fixed[fits:]] + price[fits:]
                i = int(gain.argmax())
                if gain[i] > best[c] + 1e-12:
                    best[c], took[c] = gain[i], fits + i
        if best[capacity] <= 1 + 1e-9:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                column[took[c]] += 1
                c -= sizes[took[c]]
        step = np.linalg.solve(basis, column)
        if not (step > 1e-9).any():
            break
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        theta = ratio[out]
        use = np.maximum(use - theta * step, 0)
        use[out] = theta
        basis[:, out] = column
    left, found = list(demand), []
    for j in np.argsort(-use):
        column = basis[:, j].astype(int)
        n = int(min([use[j] + 1e-9, *(left[i] // column[i] for i in range(k) if column[i])]))
        if n > 0:
            found.append((tuple(column.tolist()), n))
            for i in range(k):
                left[i] -= n * int(column[i])
    return found


def plan_with(counts: dict[int, int], capacity: int, groups: int, large_from: int) -> tuple[list[Run], int]:
    """The runs and the number of sequences for a given number of groups."""
    runs: list[Run] = []
    used: dict[int, int] = {}
    n_seq = 0
    free: dict[int, list[tuple[int, int]]] = {}  # free space -> ranges of sequences
    spaces: list[int] = []

    def offer(space: int, seq: int, n: int) -> None:
        if space > 0 and n > 0:
            if space not in free:
                bisect.insort(spaces, space)
                free[space] = []
            free[space].append((seq, n))

    def place(length: int, n: int) -> None:
        """Best fit: the least free space that holds the length, else new sequences."""
        nonlocal n_seq
        while n:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):
                each = capacity // length
                new = -(-n // each)
                offer(capacity, n_seq, new)
                n_seq += new
                continue
            space = spaces[at]
            seq, m = free[space].pop()
            if not free[space]:
                del free[space]
                spaces.pop(at)
            per = min(space // length, n)
            took = min(m, n // per)
            for i in range(per):
                runs.append(Run(length, used.get(length, 0), took, seq, capacity - space + i * length))
                used[length] = used.get(length, 0) + took
            n -= per * took
            offer(space - per * length, seq, took)
            offer(space, seq + took, m - took)

    full = counts.get(capacity, 0)
    if full:
        runs.append(Run(capacity, 0, full, 0, 0))
        n_seq = full
    large = sorted(((s, n) for s, n in counts.items() if large_from <= s < capacity and n), reverse=True)
    total = sum(n for _, n in large)
    if total and groups:
        each = -(-total // groups)
        members: list[list[list[int]]] = [[]]  # groups of [length, number], longest first
        room = each
        for s, n in large:
            while n:
                if not room:
                    members.append([])
                    room = each
                took = min(room, n)
                members[-1].append([s, took])
                room, n = room - took, n - took
        sizes = [g[0][0] for g in members]
        demand = [sum(n for _, n in g) for g in members]
        merged: dict[int, int] = {}
        for i, s in enumerate(sizes):  # equal sizes are one size
            merged.setdefault(s, i)
        if len(merged) < len(sizes):
            keep = sorted(merged, reverse=True)
            members = [[m for i, s2 in enumerate(sizes) if s2 == s for m in members[i]] for s in keep]
            sizes, demand = keep, [sum(n for _, n in g) for g in members]
        for column, n in configurations(sizes, demand, capacity):
            slots = [i for i, c in enumerate(column) for _ in range(c)]
            while n:  # runs in which no place changes its actual length
                need: dict[int, int] = {}
                for i in slots:
                    need[i] = need.get(i, 0) + 1
                took = n
                for i, c in need.items():
                    if members[i][0][1] >= c:
                        took = min(took, members[i][0][1] // c)
                    else:
                        took = 1
                at = 0
                for i in slots:
                    while not members[i][0][1]:
                        members[i].pop(0)
                    if members[i][0][1] < took:
                        raise AssertionError("a place without a document")
                    length = members[i][0][0]
                    runs.append(Run(length, used.get(length, 0), took, n_seq, at))
                    used[length] = used.get(length, 0) + took
                    members[i][0][1] -= took
                    if not members[i][0][1] and len(members[i]) > 1:
                        members[i].pop(0)
                    at += length
                offer(capacity - at, n_seq, took)
                n_seq += took
                n -= took
    for s in sorted(counts, reverse=True):
        if s < capacity and counts[s] > used.get(s, 0):
            place(s, counts[s] - used.get(s, 0))
    return runs, n_seq


def plan(
    counts: dict[int, int],
    capacity: int,
    group_numbers: tuple[int, ...] = (12, 24, 48),
    large_shares: tuple[float, ...] = (2.05, 2.5, 3.05, 4.05),
) -> tuple[list[Run], int]:
    """The plan with the fewest sequences over several numbers of groups and several
    bounds of large lengths (``capacity / share``)."""
    found = [plan_with(counts, capacity, g, max(1, int(capacity / share))) for g in group_numbers for share in large_shares]
    return min(found, key=lambda x: x[1])


def pieces_of(docs: DataFrame, capacity: int, tokenizer: str, end_id: int) -> DataFrame:
    """Whole documents as pieces of at most ``capacity`` ids; of a longer one, the
    first piece is the short one, so that all others fill a sequence each."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.load(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(bpe.encode(text) + end)
                n = len(ids) // 4
                at, piece, size = 0, 0, (n - 1) % capacity + 1
                while at < n:
                    rows.append((doc_id, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, piece, size = at + size, piece + 1, capacity
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        bpe.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), PIECES)


def assign(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to staged pieces (``length`` from 1 to capacity)."""
    order = ["doc_id", "piece", "start", "ids_crc32"]
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)).cast("int"))
    counts = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity rows
    runs, _ = plan(totals, capacity)
    by_length: dict[int, list[Run]] = {}
    for r in runs:
        by_length.setdefault(r.length, []).append(r)
    tables = {s: tuple(np.array(x, "i8") for x in zip(*((r.rank, r.seq, r.offset) for r in sorted(rs, key=lambda r: r.rank)), strict=True)) for s, rs in by_length.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, offset = np.zeros(len(rank), "i8"), np.zeros(len(rank), "i8")
            for s in np.unique(length):
                mine = length == s
                ranks, seqs, offsets = tables[int(s)]
                at = np.searchsorted(ranks, rank[mine], side="right") - 1
                seq[mine] = seqs[at] + rank[mine] - ranks[at]
                offset[mine] = offsets[at]
            kept = batch.drop_columns(["rank"])
            yield pa.record_batch([*kept.columns, pa.array(seq), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"])

    rank = F.row_number().over(W.partitionBy("length", "bucket").orderBy(*order))
    ranked = pieces.withColumn("rank", rank.cast("long")).join(base, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank") - 1).alias("rank"))
    return ranked.mapInArrow(tidy(run), PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """One row per piece of every document of ``docs(doc_id, text)``: doc_id, piece,
    start, length, ids_crc32, sequence_id, offset."""
    short_batches(docs.sparkSession)
    pieces = staged(pieces_of(docs, capacity, tokenizer or byte_bpe.default_path(), end_id), "pieces")
    return assign(pieces, capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), capacity=1024, end_id=2)
