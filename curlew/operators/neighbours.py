"""Exact nearest neighbours and near pairs by tiles.

Rows are packed into chunks of bounded rows and bytes; each pair of chunks is a tile, and tiles
are dealt out evenly by a cartesian product of the few chunk rows. Within a tile, products in
single precision pick candidates, within a bound of their error; candidates are compared in
double precision, components added up in their order (as DuckDB does), so that equal vectors
have equal distances. The nearest so far raise the bar for later chunks. Nothing is collected
or broadcast. Work is the product of both sides, as an exact search is; ties go to the smaller id.

Defined cases: rows without an id or a vector, and vectors with a null or non-finite component,
take no part; vectors of different lengths are never compared; a zero vector has cosine 0 to
every other one; equal ids are rows of their own; an empty table gives no row.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import staged

BLOCK = 8192  # rows of a chunk
CHUNK_BYTES = 16 << 20  # of a chunk's vectors
PARTS = 64  # tasks over chunks of queries
LIBRARY_CHUNKS = 32  # in one task, at least four such parts
SLICE = 256  # queries compared at a time
CHUNKS = "k string, n int, chunk long, rows int, ids binary, vs binary, kept binary"
EDGES = "id long, neighbour long, distance double"
METRICS = ("cosine", "euclidean", "manhattan")


@cache
def _one_thread() -> None:
    """NumPy's products on one thread, where its library can be told: Spark allows each worker
    as many threads as its executor has cores, and tasks would stand in each other's way."""
    try:
        with open("/proc/self/maps") as maps:
            loaded = {line.split()[-1] for line in maps if "openblas" in line}
    except OSError:  # not a Linux machine
        return
    for path in loaded:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def in_worker(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a pass over Arrow batches, in a worker: products take one thread, and memory goes
    back to the machine when the task ends, as workers live on between tasks."""

    @wraps(run)
    def alone(batches: Iterator) -> Iterator:
        _one_thread()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
            if trim:
                trim(0)

    return alone


class _Side:
    """Rows of a chunk as a metric needs them."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, metric: str):
        self.ids, self.metric = ids, metric
        self.v = np.ascontiguousarray(v.T.astype(np.float64))  # a row for each component
        self.square = np.zeros(len(ids))
        for x in self.v:
            self.square += x * x
        if metric == "cosine":
            size = np.sqrt(self.square)
            self.unit = v.astype(np.float64) / np.where(size > 0, size, 1)[:, None]
            self.near = np.ascontiguousarray(self.unit, np.float32)
            self.most = 1.0
        else:
            self.near = np.ascontiguousarray(v, np.float64)
            self.most = float((self.square if metric == "euclidean" else np.abs(self.near).sum(1)).max(initial=0.0))
        self.across = np.ascontiguousarray(self.near.T)

    def slack(self, other: _Side) -> float:
        """More than the error of a closeness: for unit vectors, twice the bound (n + 4) * 2^-24."""
        n = len(self.v) + 8
        return n * 2.0**-23 if self.metric == "cosine" else n * 2.0**-51 * (self.most + other.most)

    def closeness(self, low: int, high: int, other: _Side, a: int, b: int) -> np.ndarray:
        """Of rows low..high and the other side's rows a..b; falls as distance grows."""
        if self.metric == "manhattan":
            return np.stack([-np.abs(other.near[a:b] - x).sum(1) for x in self.near[low:high]])
        found = self.near[low:high] @ other.across[:, a:b]
        if self.metric == "euclidean":
            found = 2 * found - self.square[low:high, None] - other.square[None, a:b]
        return found

    def at_least(self, distance: np.ndarray | float, slack: float):
        """The closeness that a pair within ``distance`` has."""
        d = np.asarray(distance, float)
        return (1 - d if self.metric == "cosine" else -d * d if self.metric == "euclidean" else -d) - slack

    def distances(self, rows: np.ndarray, other: _Side, cols: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        for at in range(0, len(rows), 8192):
            r, c = rows[at : at + 8192], cols[at : at + 8192]
            total = np.zeros(len(r))
            for x, y in zip(self.v, other.v, strict=True):
                p, q = x[r], y[c]
                total += p * q if self.metric == "cosine" else (p - q) ** 2 if self.metric == "euclidean" else np.abs(p - q)
            if self.metric == "cosine":
                x, y = self.square[r], other.square[c]
                with np.errstate(all="ignore"):
                    root = np.sqrt(x * y)
                    root = np.where((root > 0) & np.isfinite(root), root, np.sqrt(x) * np.sqrt(y))
                    total = 1 - np.where(root > 0, np.clip(total / root, -1, 1), 0.0)
            out[at : at + 8192] = np.sqrt(total) if self.metric == "euclidean" else total
        return out

    def candidates(self, low: int, high: int, other: _Side, a: int, b: int, found: np.ndarray, bar: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and other rows whose closeness ``found`` reaches ``bar`` (of each row, with the slack
        taken off). Where single precision keeps many, double precision sorts them out."""
        hit = found >= bar.astype(found.dtype)[:, None]
        width = b - a
        if width % 8:
            at = np.flatnonzero(hit)
        else:  # eight at a time, as hits are rare
            words = hit.view(np.uint64)
            some = np.flatnonzero(words.ravel() != 0)
            x, y = np.nonzero(hit.reshape(-1, 8)[some])
            at = some[x] * 8 + y
        rows, cols = at // width, at % width
        if self.metric == "cosine" and len(rows) > hit.size // 16:
            fine = self.unit[low:high] @ other.unit[a:b].T
            ok = fine[rows, cols] >= (bar + slack - slack * 2.0**-27)[rows]
            rows, cols = rows[ok], cols[ok]
        return rows + low, cols + a


class _Best:
    """The ``k`` nearest of each row so far."""

    def __init__(self, side: _Side, k: int, drop_self: bool):
        self.side, self.k, self.drop_self = side, k, drop_self
        self.rows, self.distance, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.last = np.full(len(side.ids), np.inf)  # distance of the k-th
        self.later: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        self.zero = np.flatnonzero(side.square == 0) if side.metric == "cosine" else np.zeros(0, np.int64)

    def merge(self) -> None:
        rows, distance, ids = (np.concatenate([x, *y]) for x, y in zip((self.rows, self.distance, self.ids), zip(*self.later, strict=True) if self.later else ((),) * 3, strict=True))
        self.later, self.held = [], 0
        order = np.lexsort((ids, distance, rows))
        rows, distance, ids = rows[order], distance[order], ids[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < self.k
        full = place == self.k - 1
        self.last[rows[full]] = distance[full]
        self.rows, self.distance, self.ids = rows[kept], distance[kept], ids[kept]

    def add(self, rows: np.ndarray, distance: np.ndarray, ids: np.ndarray) -> None:
        if len(rows):
            self.later.append((rows, distance, ids))
            self.held += len(rows)
            if self.held > max(self.k * len(self.last), 1 << 18):
                self.merge()

    def meet(self, other: _Side) -> None:
        """``other``: rows of the library in ascending id."""
        side, k, slack = self.side, self.k, self.side.slack(other)
        mine = theirs = np.zeros(0, np.int64)
        if self.drop_self:
            first, end = np.searchsorted(other.ids, side.ids), np.searchsorted(other.ids, side.ids, "right")
            mine = np.repeat(np.arange(len(side.ids)), end - first)
            theirs = np.arange(len(mine)) - np.repeat(np.cumsum(end - first) - (end - first), end - first) + np.repeat(first, end - first)
        for row in self.zero:  # as far from all: the smallest ids
            ids = other.ids[other.ids != side.ids[row]] if self.drop_self else other.ids
            ids = ids[:k]
            self.add(np.full(len(ids), row), np.ones(len(ids)), ids)
        a, width = 0, max(1024, 4 * k)
        while a < len(other.ids):
            # The first chunk comes in growing steps: each raises the bar for the next.
            b = min(len(other.ids), a + width)
            width *= 2
            for low in range(0, len(side.ids), SLICE):
                high = min(len(side.ids), low + SLICE)
                found = side.closeness(low, high, other, a, b)
                own = slice(np.searchsorted(mine, low), np.searchsorted(mine, high))
                x, y = mine[own], theirs[own]
                inside = (y >= a) & (y < b)
                found[x[inside] - low, y[inside] - a] = -np.inf
                found[self.zero[(self.zero >= low) & (self.zero < high)] - low] = -np.inf
                bar = np.full(high - low, float(np.finfo(np.float32).min))
                known = np.isfinite(self.last[low:high])
                bar[known] = side.at_least(self.last[low:high][known], slack)
                if b - a > k and not known.all():
                    best = np.partition(found[~known], b - a - k, axis=1)[:, b - a - k].astype(float) - 2 * slack
                    bar[~known] = np.maximum(best, bar[~known])
                rows, cols = side.candidates(low, high, other, a, b, found, bar, slack)
                self.add(rows, side.distances(rows, other, cols), other.ids[cols])
            if not np.isfinite(self.last).all():
                self.merge()
            a = b

    def table(self) -> pa.RecordBatch:
        self.merge()
        return pa.record_batch([pa.array(self.side.ids[self.rows]), pa.array(self.ids), pa.array(self.distance)], names=["id", "neighbour", "distance"])


def _copies(ids: np.ndarray, v: np.ndarray, copies: int) -> bytes | None:
    """Positions of rows that can be among the nearest: of equal vectors, the smallest ids."""
    _, code, n = np.unique(np.ascontiguousarray(v).view(f"V{v.itemsize * v.shape[1]}").ravel(), return_inverse=True, return_counts=True)
    if n.max() <= copies or len(np.unique(ids)) < len(ids):
        return None
    order = np.argsort(code, kind="stable")
    place = np.arange(len(ids)) - np.searchsorted(code[order], code[order])
    return np.sort(order[place < copies]).astype(np.int32).tobytes()


def _pack(block: int, kind: str, copies: int):
    """Rows (k, n, id, v) to chunks of rows in ascending id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held: dict[tuple[str, int], list] = {}
        size = np.dtype(kind).itemsize

        def chunks(key: tuple[str, int], least: int) -> Iterator[pa.RecordBatch]:
            nonlocal made
            ids, v = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
            most = max(1, min(block, CHUNK_BYTES // (size * key[1])))
            at = 0
            while len(ids) - at >= (most if least else 1):
                i, x = ids[at : at + most], v[at : at + most]
                order = np.argsort(i, kind="stable")
                i, x = i[order], np.ascontiguousarray(x[order])
                kept = _copies(i, x, copies) if copies else None
                row = [[key[0]], [key[1]], [base + made], [len(i)], [i.tobytes()], [x.tobytes()], [kept]]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(row, (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["k", "n", "chunk", "rows", "ids", "vs", "kept"])
                at, made = at + most, made + 1
            if at < len(ids):
                held[key] = [(ids[at:], v[at:])]

        for b in batches:
            groups: dict[tuple[str, int], list[int]] = {}
            for i, key in enumerate(zip(b.column("k").to_pylist(), b.column("n").to_pylist(), strict=True)):
                groups.setdefault(key, []).append(i)
            for key, rows in groups.items():
                part = b.take(pa.array(rows)) if len(groups) > 1 else b
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), key[1]).astype(kind)
                sound = np.isfinite(v).all(1)
                held.setdefault(key, []).append((part.column("id").to_numpy()[sound], v[sound]))
                if sum(len(x[0]) for x in held[key]) >= max(1, min(block, CHUNK_BYTES // (size * key[1]))):
                    yield from chunks(key, 1)
            if sum(x[1].nbytes for parts in held.values() for x in parts) > 4 * CHUNK_BYTES:  # many keys
                for key in list(held):
                    yield from chunks(key, 0)
        for key in list(held):
            yield from chunks(key, 0)

    return run


def _single(df: DataFrame, name: str) -> bool:
    """The column holds single-precision numbers: they travel as such, and are compared in
    double precision."""
    return isinstance(getattr(df.schema[name].dataType, "elementType", None), T.FloatType)


def sound(vector: str):
    """The condition for a vector to take part (beside its id)."""
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull()), F.lit(False))


def packed(df: DataFrame, block: int = BLOCK, kind: str = "f8", copies: int = 0, by: str | None = None, ordered: bool = False) -> DataFrame:
    """Chunks of ``df(id, v)`` and, with ``by``, of its values, written once. Chunks of an
    ``ordered`` packing hold ranges of ids that do not overlap. ``copies``: that many equal
    vectors of a chunk are needed in a library."""
    key = F.col(by).cast("string") if by else F.lit("")
    rows = df.select(key.alias("k"), F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>" if kind == "f4" else "array<double>").alias("v"))
    rows = rows.filter(F.col("k").isNotNull() & F.col("id").isNotNull() & sound("v")).select("k", F.size("v").alias("n"), "id", "v")
    if ordered:
        rows = rows.repartitionByRange("id").sortWithinPartitions("id")
    return staged(rows.mapInArrow(_pack(block, kind, copies), CHUNKS), large=True)


def side_of(row: dict, kind: str, metric: str, prefix: str = "", library: bool = False) -> _Side:
    """A chunk row (Arrow scalars by name) made ready; of a library, without needless copies."""
    ids = np.frombuffer(row[f"{prefix}ids"].as_buffer(), np.int64)
    v = np.frombuffer(row[f"{prefix}vs"].as_buffer(), kind).reshape(len(ids), -1)
    kept = row[f"{prefix}kept"].as_buffer() if library else None
    if kept is not None:
        at = np.frombuffer(kept, np.int32)
        ids, v = ids[at], v[at]
    return _Side(ids, v, metric)


def tiles(left: DataFrame, right: DataFrame, condition: str = "true", parts: int | None = None) -> DataFrame:
    """Pairs of chunk rows of equal keys, columns of the right ones with ``l_`` before their names.
    Rows are few, a chunk each, so the cartesian product is small; a task has some left chunks,
    one after the other, and a part of the right ones."""
    n, m = left.count(), right.count()
    right = right.select(*(F.col(c).alias(f"l_{c}") for c in right.columns))
    left = left.repartitionByRange(max(1, min(n, PARTS)), "chunk")
    right = right.repartitionByRange(max(1, min(m, parts or max(4, -(-m // LIBRARY_CHUNKS)))), "l_chunk")
    return left.hint("shuffle_replicate_nl").join(right, F.expr(f"k = l_k AND n = l_n AND {condition}"))


def chunk_row(row: dict, ids: np.ndarray, v: np.ndarray, **more: int) -> pa.RecordBatch:
    """A chunk of some rows, with the key and number of ``row``."""
    found = {"k": pa.array([row["k"].as_py()], pa.string()), "n": pa.array([row["n"].as_py()], pa.int32()), "chunk": pa.array([row["chunk"].as_py()], pa.int64()), "rows": pa.array([len(ids)], pa.int32())}
    found |= {"ids": pa.array([ids.tobytes()], pa.binary()), "vs": pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()), "kept": pa.nulls(1, pa.binary())}
    return pa.record_batch(found | {name: pa.array([x], pa.int64()) for name, x in more.items()})


def ids_of(chunks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield pa.record_batch([pa.array(np.frombuffer(row["ids"].as_buffer(), np.int64))], names=["id"])

    return chunks.select("ids").mapInArrow(run, "id long")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(j)[i] for j, name in enumerate(b.schema.names)}


def nearest(queries: DataFrame, library: DataFrame, k: int, metric: str = "cosine", drop_self: bool = False, by: str | None = None, block: int = BLOCK) -> DataFrame:
    """``id``, ``neighbour``, ``distance``, ``rank`` (from 1) of the ``k`` rows of
    ``library(id, v)`` nearest to each of ``queries(id, v)``; with ``by``, among rows of
    equal ``by``. Rows without a vector or id take no part."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    kind = "f4" if all(_single(df, "v") for df in (queries, library)) else "f8"
    q = packed(queries, block, kind, k + 1, by)
    l = q if queries is library else packed(library, block, kind, k + 1, by)  # noqa: E741

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, best = None, None
        for row in rows_of(batches):
            if chunk != row["chunk"].as_py():
                if best:
                    yield best.table()
                chunk, best = row["chunk"].as_py(), _Best(side_of(row, kind, metric), k, drop_self)
            best.meet(side_of(row, kind, metric, "l_", True))
        if best:
            yield best.table()

    found = tiles(q, l).mapInArrow(in_worker(run), EDGES)
    rank = F.row_number().over(W.partitionBy("id").orderBy("distance", "neighbour"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def knn_edges(df: DataFrame, id: str, vector: str, k: int, metric: str = "cosine", include_self: bool = False, block: int = BLOCK) -> DataFrame:  # noqa: A002
    """Neighbours of each row among the rows of the same table; itself is left out by
    id, or takes part like any other."""
    rows = df.select(F.col(id).alias("id"), F.col(vector).alias("v"))
    return nearest(rows, rows, k, metric, drop_self=not include_self, block=block)


def near_in_tile(first: _Side, second: _Side, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions and cosines of pairs of at least ``threshold``, a slice at a time; of the ``same``
    chunk, each pair once. Rows of equal ids are no pairs."""
    slack = first.slack(second)
    for low in range(0, len(first.ids), SLICE):
        high, a = min(len(first.ids), low + SLICE), low // 8 * 8 if same else 0
        found = first.closeness(low, high, second, a, len(second.ids))
        rows, cols = first.candidates(low, high, second, a, len(second.ids), found, np.full(high - low, threshold - slack), slack)
        keep = (first.ids[rows] != second.ids[cols]) & ((rows < cols) | (not same))
        rows, cols = rows[keep], cols[keep]
        s = 1 - first.distances(rows, second, cols)
        keep = s >= threshold
        yield rows[keep], cols[keep], s[keep]


def pair_chunks(df: DataFrame, id: str, vector: str, block: int = BLOCK) -> tuple[DataFrame, str]:  # noqa: A002
    """Chunks of the rows, and the kind of their components."""
    kind = "f4" if _single(df, vector) else "f8"
    return packed(df.select(F.col(id).alias("id"), F.col(vector).alias("v")), block, kind), kind


def near_pairs(df: DataFrame, id: str, vector: str, threshold: float, block: int = BLOCK) -> DataFrame:  # noqa: A002
    """Pairs ``a < b`` with a cosine of at least ``threshold``, over all rows."""
    chunks, kind = pair_chunks(df, id, vector, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, first = None, None
        for row in rows_of(batches):
            if chunk != row["chunk"].as_py():
                chunk, first = row["chunk"].as_py(), side_of(row, kind, "cosine")
            second = side_of(row, kind, "cosine", "l_")
            for x, y, s in near_in_tile(first, second, threshold, chunk == row["l_chunk"].as_py()):
                p, q = first.ids[x], second.ids[y]
                yield pa.record_batch([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(s)], names=["a", "b", "similarity"])

    return tiles(chunks, chunks, "chunk <= l_chunk").mapInArrow(in_worker(run), "a long, b long, similarity double")
