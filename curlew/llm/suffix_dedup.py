"""Repeated byte strings by distributed prefix doubling over sampled positions.

Removes every byte that lies in a string of ``length`` bytes which also starts anywhere
else in the corpus. Ranks (equal ranks: equal strings) come from Spark's range sort
(``ranks.reranked``): rows are sorted by a pair of a rank and the name or rank of what
stands at a growing offset, numbered anew, and those whose pair is unique drop out, until
strings of ``length`` bytes are reached.

Ranking every byte of the corpus would move many times its size, so the first rounds
rank a sample that misses nothing: each window of ``length`` bytes is represented by
the 40-byte string in it with the least hash. Equal windows have equal representatives
at equal places, so:

1. sort the names of the 40 bytes at each sampled position; unique ones drop out;
2. sort pairs of that rank and the name of the *span*, all windows that the position
   represents (with their place in it): windows of equal spans are settled;
3. of each kind of span that shares its rank with another (edges of passages, edits), cut
   one into blocks of 16 windows; sort triples of rank, block and the name of the bytes
   common to the block's windows; unique ones drop out, equal whole blocks are settled;
4. prefix doubling over the windows that are left: the positions at which their parts
   start are sorted by the names of a quarter of ``length`` bytes and ranked; pairs (rank
   at i, rank at i + 50) give ranks of 100 bytes, pairs (rank at i, rank at i + 100) of
   those give ranks of 200 bytes. Positions whose rank is unique drop out in each round; windows
   that are left in the end occur elsewhere.

Names are 64-bit polynomial hashes of the bytes, with another base in rounds 2 to 4 than in
round 1. Ranks ascend with names, not with the bytes: equality is all that is asked of them.

Large groups: equal spans within a document are merged before any shuffle, and a rank that
very many rows share lies in several ranges of the sort.

Defined cases: a null text is empty; a document shorter than ``length`` loses nothing;
a null doc_id is kept; rows that repeat a doc_id are documents of their own (told
apart by a 64-bit hash of their text; equal rows are copies and lose what copies lose); an
empty table gives no row; further columns are kept by ``remove_repeats``, whatever their
names, and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import reranked
from .shared import batches_of, dropped, partitions, short_batches, staged, table, tidy

LENGTH = 200
GRAM = 40
BLOCK = 16
SEGMENT = 1 << 18  # starts of windows handled at once; bounds a worker's memory
U = np.uint64
_LOW = U((1 << 24) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


class Hasher:
    """Polynomial hashes of any stretch of a text, from prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base | 1, pow(base | 1, -1, 1 << 64), 0

    def load(self, data: np.ndarray) -> None:
        if len(data) + 1 > self.n:
            self.n = max(len(data) + 1, 2 * self.n, 1 << 16)
            self.up, self.down = _powers(self.base, self.n), _powers(self.inverse, self.n)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * self.up[: len(data)], out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        return _mix((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])

    def stretch(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.down[start])


_FIRST, _SECOND = Hasher(0x9E3779B97F4A7C15), Hasher(0xD1B54A32D192ED03)


def spans(text: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """For each stretch of the text: rank and span hashes, first window, number of
    windows less one, and the place of the representative after the first window."""
    width = length - GRAM + 1
    for begin in range(0, max(len(text) - length + 1, 0), SEGMENT):
        data = np.frombuffer(text, np.uint8)[begin : begin + SEGMENT + length - 1]
        _FIRST.load(data)
        grams = _FIRST.every(GRAM)
        least = (grams & ~_LOW) | np.arange(len(grams), dtype=U)
        reach = 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if width > reach:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        place = (least & _LOW).astype(np.int64)
        cut = np.flatnonzero(np.diff(place)) + 1
        low = np.concatenate(([0], cut))
        more = np.concatenate((cut, [len(place)])) - 1 - low
        place = place[low]
        _SECOND.load(data)
        span = _SECOND.stretch(low, low + more + length)
        span = _mix(span ^ ((more.astype(U) << U(32)) | (place - low).astype(U)))
        yield grams[place], span, low + begin, more, place - low


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the given ones."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[new], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))]


SPANS = pa.schema([("gram", pa.int64()), ("span", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("low", pa.int64()), ("more", pa.int32()), ("place", pa.int32()), ("n", pa.int32())])
SPANS_DDL = "gram long, span long, doc_id long, tag long, low long, more int, place int, n int"


OUT_ROWS = 1 << 16  # rows of an Arrow batch that a pass over texts gives out


class _Rows:
    """Columns of numbers beside a document's id and tag, given out in bounded batches."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.names = schema, [n for n in schema.names if n not in ("doc_id", "tag")]
        self._begin()

    def _begin(self) -> None:
        self.parts, self.ids, self.tags, self.n = [], [], [], 0

    def add(self, doc_id: int | None, tag: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            self.parts.append(columns)
            self.ids.append(doc_id)
            self.tags.append(tag)
            self.n += len(columns[0])
        if self.n >= OUT_ROWS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        at = pa.array(np.repeat(np.arange(len(self.parts)), [len(p[0]) for p in self.parts]))
        cols = []
        for f in self.schema:
            if f.name in ("doc_id", "tag"):
                cols.append(pa.array(self.ids if f.name == "doc_id" else self.tags, pa.int64()).take(at))
            else:
                x = np.concatenate([p[self.names.index(f.name)] for p in self.parts])
                cols.append(pa.array(x.view(np.int64) if x.dtype == U else x).cast(f.type))
        out = pa.record_batch(cols, schema=self.schema)
        self._begin()
        for low in range(0, out.num_rows, OUT_ROWS):
            yield out.slice(low, OUT_ROWS)


def _sampled(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(SPANS)
        for batch in batches:
            for doc_id, tag, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for gram, span, low, more, place in spans(text.encode(), length):
                    # Equal spans of one document: one row that counts them. n = 0 marks
                    # windows settled by this alone (a run of them is one row).
                    _, first, same, n = np.unique(span ^ (gram * U(31)), return_index=True, return_inverse=True, return_counts=True)
                    part = [x[first] for x in (gram, span, low, more, place)] + [n]
                    if len(first) < len(gram):
                        twice = n[same] > 1
                        a, b = merged(low[twice], low[twice] + more[twice] + 1)
                        none = np.zeros(len(a), U)
                        part = [np.concatenate(x) for x in zip(part, (none, none, a, b - a - 1, np.zeros(len(a), "i8"), np.zeros(len(a), "i8")), strict=True)]
                    yield from rows.add(doc_id, tag, part)
        yield from rows.rest()

    return run


BLOCKS = pa.schema([("gram", pa.int64()), ("block", pa.int64()), ("common", pa.int64()), ("whole", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("low", pa.int64()), ("more", pa.int32()), ("place", pa.int32())])
BLOCKS_DDL = "gram long, block long, common long, whole long, doc_id long, tag long, low long, more int, place int"
POSITIONS = pa.schema([("name", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("pos", pa.int64()), ("level", pa.int32())])
POSITIONS_DDL = "name long, doc_id long, tag long, pos long, level int"


def lengths_of(length: int) -> list[int]:
    """The string lengths of the doubling: a quarter, half, all (rounded up)."""
    return [-(-length // 4), -(-length // 2), length]


def _asked(batch: pa.RecordBatch) -> Iterator[tuple[int | None, int, bytes, dict[str, np.ndarray]]]:
    """doc_id, tag, text and the asked stretches' columns of each row."""
    asked = batch.column("asked")
    flat = asked.flatten()
    columns = {f.name: flat.field(i).to_numpy().astype(np.int64) for i, f in enumerate(flat.type)}
    ends = np.cumsum(pa.compute.list_value_length(asked).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    for doc_id, tag, text, end in zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), batch.column("text"), ends.tolist(), strict=True):
        yield doc_id, tag, text.as_py().encode(), {k: v[begin:end] for k, v in columns.items()}
        begin = end


def _segments(text: bytes, low: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The text piece by piece: where the piece begins, its bytes, and which of the given
    stretches lie in it. Stretches are short beside a piece."""
    data, done = np.frombuffer(text, np.uint8), np.zeros(len(low), bool)
    for begin in range(0, len(text), SEGMENT):
        end = begin + SEGMENT + 4 * LENGTH + 1024
        mine = ~done & (low >= begin) & (stop <= end)
        if mine.any():
            done |= mine
            yield begin, data[begin:end], mine
    if not done.all():
        raise AssertionError("a stretch outside its text")


def _cut_into_blocks(length: int):
    """A span's windows, by how far the representative lies after the window's start, in
    blocks of 16. ``common``: hash of the bytes that all windows of the full block share;
    ``whole``: of all their bytes, if the span has the block in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(BLOCKS)
        for batch in batches:
            for doc_id, tag, data, asked in _asked(batch):
                gram, low, more, place = (asked[k] for k in ("gram", "low", "more", "place"))
                nearest, farthest = place - more, place  # distance from a window's start to the representative
                first, last = nearest // BLOCK, farthest // BLOCK
                each = last - first + 1
                row = np.repeat(np.arange(len(gram)), each)
                block = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                at = (low + place)[row]  # the representative
                from_, to = np.maximum(nearest[row], block * BLOCK), np.minimum(farthest[row], block * BLOCK + BLOCK - 1)
                start, stop = at - block * BLOCK, at - (block * BLOCK + BLOCK - 1) + length
                full = to - from_ == BLOCK - 1
                for begin, piece, mine in _segments(data, at - to, at - from_ + length):
                    _SECOND.load(piece)
                    common = _SECOND.stretch(start[mine] - begin, stop[mine] - begin)
                    wide = full[mine]
                    whole = np.zeros(len(common), U)
                    whole[wide] = _SECOND.stretch((at - to)[mine][wide] - begin, (at - from_)[mine][wide] + length - begin)
                    yield from rows.add(doc_id, tag, [gram[row[mine]], block[mine], common, whole, (at - to)[mine], (to - from_)[mine], from_[mine]])
        yield from rows.rest()

    return run


def _named_positions(length: int):
    """Of each window asked for (``low .. low + more``): the positions at which its parts
    start, and the names of the bytes there. ``level``: how many rounds of doubling a position
    goes through."""
    base, half, whole = lengths_of(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(POSITIONS)
        for batch in batches:
            for doc_id, tag, data, asked in _asked(batch):
                low, size = asked["low"], asked["more"] + 1
                ends = np.cumsum(size)
                windows = np.unique(np.repeat(low - ends + size, size) + np.arange(ends[-1]))
                halves = np.union1d(windows, windows + whole - half)
                pos = np.union1d(halves, halves + half - base)
                level = np.isin(pos, halves, assume_unique=True).astype(np.int64) + np.isin(pos, windows, assume_unique=True)
                for begin, piece, mine in _segments(data, pos, pos + base):
                    _SECOND.load(piece)
                    at = pos[mine] - begin
                    yield from rows.add(doc_id, tag, [_SECOND.stretch(at, at + base), pos[mine], level[mine]])
        yield from rows.rest()

    return run


CUT = 16  # positions are dealt out by document and stretches of 2 ** CUT bytes


def _pairs_at(offset: int, level: int):
    """Rows sorted by ``place`` (a hash of document and stretch above, the position in the
    stretch below) to pairs of the ranks at i and at i + offset, for positions that go
    through that many rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def paired(t: pa.RecordBatch) -> pa.RecordBatch:
            place, tag, pos, rank, lev = (t.column(c).to_numpy() for c in ("place", "tag", "pos", "rank", "level"))
            doc = t.column("doc_id").fill_null(-(1 << 63)).to_numpy()
            inner = place & ((1 << CUT + 1) - 1)
            stretch = (pos - inner) >> CUT
            new = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (stretch[1:] != stretch[:-1])
            if (new & (place[1:] >> CUT + 1 == place[:-1] >> CUT + 1)).any():  # two of one hash
                order = pa.array(np.lexsort((pos, stretch, tag, doc, place >> CUT + 1)))
                return paired_in_order(t.take(order), *(x[order] for x in (doc, tag, stretch, pos, rank, lev, inner)))
            return paired_in_order(t, doc, tag, stretch, pos, rank, lev, inner)

        def paired_in_order(t, doc, tag, stretch, pos, rank, lev, inner) -> pa.RecordBatch:
            new = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (stretch[1:] != stretch[:-1])
            at = (np.concatenate(([0], np.cumsum(new))) << CUT + 2) + inner
            other = np.searchsorted(at, at + offset)
            there = other < len(at)
            there[there] = at[other[there]] == at[there] + offset
            there &= (lev >= level) & (inner < 1 << CUT)
            out = t.select(["doc_id", "tag", "pos", "level"]).filter(pa.array(there))
            return pa.record_batch([pa.array(rank[there]), pa.array(rank[other[there]]), *out.columns], names=["a", "b", "doc_id", "tag", "pos", "level"])

        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if left is None else pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
            above = rows.column("place").to_numpy() >> CUT + 1
            cuts = np.flatnonzero(above[1:] != above[:-1])
            if len(cuts):
                yield paired(rows.slice(0, int(cuts[-1]) + 1))
                rows = rows.slice(int(cuts[-1]) + 1)
            left = rows
        if left is not None:
            yield paired(left)

    return run


def _doubled(ranked: DataFrame, offset: int, level: int) -> DataFrame:
    """Pairs (rank at i, rank at i + offset) of ``ranked(doc_id, tag, pos, level, rank)``, ranked."""
    spark = ranked.sparkSession
    stretch = F.shiftright("pos", CUT)
    # A position just after a stretch's begin also goes to the stretch before.
    stretches = F.when((F.col("pos") >= 1 << CUT) & (F.col("pos") - F.shiftleft(stretch, CUT) < offset), F.array(stretch, stretch - 1)).otherwise(F.array(stretch))
    rows = ranked.select("doc_id", "tag", "pos", "level", "rank", F.explode(stretches).alias("stretch"))
    above = F.shiftleft(F.shiftright(F.xxhash64("doc_id", "tag", "stretch"), CUT + 1), CUT + 1)
    rows = rows.select("doc_id", "tag", "pos", "level", "rank", (above + F.col("pos") - F.shiftleft("stretch", CUT)).alias("place"))
    dealt = rows.repartition(partitions(spark), F.shiftright("place", CUT + 1)).sortWithinPartitions("place")
    with batches_of(spark, OUT_ROWS):
        pairs = staged(dealt.mapInArrow(tidy(_pairs_at(offset, level)), "a long, b long, doc_id long, tag long, pos long, level int"), "pairs")
    out = reranked(pairs, ["a", "b"], "pair-ranks", ["doc_id", "tag", "pos"])
    dropped(spark, pairs)
    return out


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, tag (a hash of the text, which tells rows of one id apart) and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def _asked_of(docs: DataFrame, asked: DataFrame, cut, ddl: str) -> DataFrame:
    """Runs ``cut`` on each document of which stretches are asked, beside their list."""
    lists = asked.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("gram", "low", "more", "place")).alias("asked"))
    met = _identified(docs).join(lists.withColumnRenamed("doc_id", "id_").withColumnRenamed("tag", "tag_"), F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("tag") == F.col("tag_")))
    return met.select("doc_id", "tag", "text", "asked").mapInArrow(tidy(cut), ddl)


def repeated_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, tag, low, more: windows ``low .. low + more`` of a document, each of which
    starts a string of ``length`` bytes that also starts elsewhere (not merged)."""
    spark = docs.sparkSession
    short_batches(spark)
    where, here = ["doc_id", "tag", "low", "more"], ["doc_id", "tag", "low"]
    sampled = staged(_identified(docs).select("doc_id", "tag", "text").mapInArrow(tidy(_sampled(length)), SPANS_DDL), "sampled")
    # Round 1: ranks of 40 bytes; unique ones drop out.
    alive = reranked(sampled.filter("n > 0"), ["gram"], "ranks", here, weight="n")
    inside = staged(sampled.filter("n = 0").select(where), "inside")
    dropped(spark, sampled)
    # Round 2: pairs with the span; equal spans settle, and one of each kind goes on.
    spans_ = reranked(alive.select(F.col("rank").alias("gram"), "span", *where, "place", "n"), ["gram", "span"], "spans", here, weight="n", keep_unique=True, settle=True)
    dropped(spark, alive)
    settled = spans_.filter("NOT alone").select(where)
    kinds = spans_.filter("first").select("gram", *where, "place")
    # Round 3: of kinds that share their rank with another, blocks of windows.
    mixed = reranked(kinds, ["gram"], "kinds", here)
    blocks = staged(_asked_of(docs, mixed.select("gram", *where, "place"), _cut_into_blocks(length), BLOCKS_DDL), "blocks")
    dropped(spark, mixed)
    left = reranked(blocks, ["gram", "block", "common"], "blocks-left", here)
    dropped(spark, blocks)
    # Equal whole blocks settle, and one of each kind goes on; cut blocks are kinds of their own.
    cut = F.col("whole") == 0
    own = [F.when(cut, c).otherwise(0).alias(f"own_{k}") for k, c in (("doc", F.coalesce("doc_id", F.lit(-(1 << 63)))), ("tag", F.col("tag")), ("low", F.col("low")))]
    wholes = reranked(left.select(F.col("rank").alias("gram"), "whole", *own, *where, "place"), ["gram", "whole", "own_doc", "own_tag", "own_low"], "wholes", here, keep_unique=True, settle=True)
    dropped(spark, left)
    by_block = wholes.filter("whole != 0 AND NOT alone").select(where)
    open_ = reranked(wholes.filter("first").select("gram", *where, "place"), ["gram"], "open", here)
    # Round 4: prefix doubling over the windows that are left.
    base, half, whole = lengths_of(length)
    named = staged(_asked_of(docs, open_.select("gram", *where, "place"), _named_positions(length), POSITIONS_DDL), "positions")
    dropped(spark, open_)
    ranked = reranked(named, ["name"], "quarter-ranks", ["doc_id", "tag", "pos"])
    dropped(spark, named)
    halves = _doubled(ranked, half - base, 1)
    dropped(spark, ranked)
    wholes_ = _doubled(halves, whole - half, 2)
    dropped(spark, halves)
    by_window = wholes_.select("doc_id", "tag", F.col("pos").alias("low"), F.lit(0).alias("more"))
    return inside.unionByName(settled).unionByName(by_block).unionByName(by_window)


def _with_runs(docs: DataFrame, length: int) -> DataFrame:
    """id_, tag_ and the windows of each document that loses some."""
    runs = repeated_runs(docs, length)
    # Windows of one document come together here; their number is bounded by its length.
    lists = runs.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("low", "more")).alias("runs"))
    return lists.select(F.col("doc_id").alias("id_"), F.col("tag").alias("tag_"), "runs")


def _covered(runs: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """Starts and stops of the maximal removed runs of each row; None without any."""
    flat = runs.flatten()
    low, more = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
    sizes = pa.compute.fill_null(pa.compute.list_value_length(runs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = 0
    for n in sizes.tolist():
        end = begin + n
        yield merged(low[begin:end], low[begin:end] + more[begin:end] + length) if n else None
        begin = end


def cut_out(data: bytes, starts: np.ndarray, stops: np.ndarray) -> bytes:
    edges = [0, *np.stack([starts, stops], 1).ravel().tolist(), len(data)]
    return b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])


def removed_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_sha256."""
    lists = _with_runs(docs, length)
    rows = _identified(docs)
    joined = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("tag") == F.col("tag_")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, spans_, kept = [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), _covered(batch.column(2), length), strict=True):
                data = text.encode()
                left = cut_out(data, *found) if found else data
                sizes.append(len(data))
                gone.append(len(data) - len(left))
                spans_.append(len(found[0]) if found else 0)
                kept.append(left)
            numbers = [pa.array(x, pa.int64()) for x in (sizes, gone, spans_)]
            digests = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
            yield pa.record_batch([batch.column(0), *numbers, pa.array(kept, pa.binary()), digests], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return joined.select("doc_id", "text", "runs").mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_spans(table(spark, sf_dir, "documents"), LENGTH).drop("kept")


def _whole_characters(data: bytes, starts: np.ndarray, stops: np.ndarray) -> bytes:
    """What is left if removed runs give up the characters they cut in two."""
    kept, at = [], 0
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        while a < b and data[a] & 0xC0 == 0x80:  # the rest of a character that began before
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:  # a character that goes on
            b -= 1
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All rows and columns of ``docs``, with repeated strings cut out of ``text`` (a
    character that is only partly covered stays) and ``n_chars``, if there, counted
    anew. Texts without repeats are returned as they are."""
    lists = _with_runs(docs, length)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The columns travel as one struct, so that no name of theirs can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"))
    joined = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("tag") == F.col("tag_")), "left").select("row", "runs")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.column(0).flatten()
            texts = []
            for t, found in zip(cols[at].to_pylist(), _covered(batch.column(1), length), strict=True):
                texts.append(_whole_characters(t.encode(), *found).decode() if found else t)
            cols[at] = pa.array(texts, pa.string())
            yield pa.record_batch(cols, names=docs_columns)

    docs_columns = docs.columns
    out = joined.mapInArrow(tidy(run), docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
