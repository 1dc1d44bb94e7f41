"""SimHash near-duplicates by segment bit counts.

A fingerprint's bit is 1 if more than half of the hashes of the text's word shingles
(repeats included) have it set. Distinct fingerprints are mapped to the bit counts of
their 32 segments of 2 bits. The Manhattan distance of two such vectors is a lower
bound of the Hamming distance. Fingerprints within 3 bits are within 1 in the first or
in the last 16 segments, so two grids of exact cells hold all of them (up to 7 bits:
four grids of 8 segments): a fingerprint is stored in its own cell of each grid, and
probes that cell and the cells one step away. (One step changes the parity of the
cell's sum, so only even cells probe their neighbours.) Pairs that meet are verified by
their Hamming distance inside the join.

With ``length_ratio`` only texts whose numbers of distinct shingles are near can link: the
grids get one more dimension, the logarithm of that number in steps of the ratio, and
cells meet in the same and the next step. Two sets of shingles with a similarity s have
sizes within a ratio of s, so nothing similar is lost (a text and the same text repeated
meet), and far fewer cells meet.

``deduplicate`` asks for a similarity of shingle sets rather than of fingerprints: the
grids then hold fingerprints over single words, which nearly all texts of that similarity
share up to 7 bits, and every pair is verified by its shingles (``similar_groups``).

Groups of equal fingerprints are one row from the start, whatever their size.

Defined cases: a null text is an empty text; a text without words has fingerprint
zero, which links like any other; a text with fewer words than a shingle is one
shingle; a null doc_id is left out of the result (it cannot name a component); equal
doc_ids are rows of their own that share the id; an empty table gives no row; further
columns are kept by ``deduplicate`` and ignored elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import apart, batches_of, dropped, partitions, short_batches, staged, table, tidy

SEED = 42
MAX_BITS = 3


def fingerprint(text: str | None, shingle: int) -> tuple[int, int]:
    """Unsigned 64-bit SimHash of a whole text, and its number of words. A-Z is
    lower-cased; words are runs of anything but ASCII white space."""
    return _fingerprint(text, shingle)[:2]


def _fingerprint(text: str | None, shingle: int) -> tuple[int, int, int]:
    """Also the number of distinct shingles."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0, 0, 0
    data, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(data, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        view = memoryview(data)
        hashes = [digest(view[a:b], SEED) for a, b in zip(starts[: 1 - shingle or None].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    n, ones = len(hashes), np.zeros(64, np.int64)
    rows = np.array(hashes, ">u8")
    for low in range(0, n, 65_536):  # bounded memory for very long texts
        part = rows[low : low + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big"), len(words), len(set(hashes))


def with_fingerprints(docs: DataFrame, shingle: int = 5, length_ratio: float | None = None) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) and size (the step of the number of distinct
    shingles; 0 without ``length_ratio``) of each document."""
    short_batches(docs.sparkSession)
    if length_ratio is not None and not 0 < length_ratio < 1:
        raise ValueError("length_ratio lies between 0 and 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            fp = np.array([f for f, _, _ in found], np.uint64)
            size = [0 if length_ratio is None else -2 if not n else int(math.log(n) / -math.log(length_ratio)) for _, _, n in found]
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64)), pa.array(size, pa.int32())], names=["doc_id", "fp", "size"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, fp long, size int")


def _part(fp: str, grid: int, grids: int) -> str:
    bits = 64 // grids
    return f"(shiftrightunsigned({fp}, {grid * bits}) & {(1 << bits) - 1}L)"


def _counts(fp: str, grid: int, grids: int) -> str:
    """Bit counts of the grid's 2-bit segments, packed in a long."""
    x = _part(fp, grid, grids)
    return f"({x} - (shiftrightunsigned({x}, 1) & {0x5555555555555555 & ((1 << 64 // grids) - 1)}L))"


def _cells(prints: DataFrame, max_bits: int) -> DataFrame:
    """Each row of ``prints(fp, ...)`` once per grid: grid, cell (its bit counts of 2-bit
    segments, packed in a long) and ones (their sum)."""
    if not 0 <= max_bits <= 7:
        raise ValueError("the grids find distances up to 7")
    grids = 2 if max_bits <= 3 else 4
    cells = ", ".join(f"named_struct('grid', {g}, 'cell', {_counts('fp', g, grids)}, 'ones', bit_count({_part('fp', g, grids)}))" for g in range(grids))
    return prints.select(*prints.columns, F.explode(F.expr(f"array({cells})")).alias("h")).select(*prints.columns, "h.grid", "h.cell", "h.ones")


def _probes(cells: DataFrame, max_bits: int, sized: bool) -> DataFrame:
    """The rows of ``_cells`` with the cells that they look into in place of their own (kept
    as ``home``), and sizes in place of theirs (``size_l``). Even cells look one step away."""
    bits = 32 if max_bits <= 3 else 16
    steps = f"""
        flatten(transform(sequence(0, {bits // 2 - 1}), i ->
            filter(array(
                if((shiftright(cell, 2 * i) & 3) < 2, cell + shiftleft(1L, 2 * i), -1L),
                if((shiftright(cell, 2 * i) & 3) > 0, cell - shiftleft(1L, 2 * i), -1L)), x -> x >= 0)))
    """
    kept = [c for c in cells.columns if c not in ("cell", "size", "ones")]
    out = cells.select(*kept, F.col("size").alias("size_l"), F.col("cell").alias("home"), F.explode(F.expr(f"if(ones % 2 = 0, concat(array(cell), {steps}), array(cell))")).alias("cell"))
    if not sized:
        return out.withColumn("size", F.col("size_l"))
    # From its own cell a row meets the same and the next size, from others also the one before.
    at = F.col("size_l")
    return out.withColumn("size", F.explode(F.when(F.col("home") == F.col("cell"), F.array(at, at + 1)).otherwise(F.array(at - 1, at, at + 1))))


def near_pairs(fingerprints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fp_a, size_a, fp_b, size_b: pairs of different rows of ``fingerprints(fp[, size])``
    whose fingerprints differ in at most ``max_bits`` (0 to 7) bits and whose sizes
    in at most 1, each pair once."""
    sized = "size" in fingerprints.columns
    cells = _cells(fingerprints.select("fp", F.col("size") if sized else F.lit(0).alias("size")).distinct(), max_bits)
    left = _probes(cells, max_bits, sized).withColumnRenamed("fp", "fp_l")
    right = cells.select(*(F.col(c).alias(f"{c}_r") for c in ("fp", "size", "grid", "cell")))
    near = F.bit_count(F.col("fp_l").bitwiseXOR(F.col("fp_r"))) <= max_bits
    once = (F.col("home") != F.col("cell_r")) | (F.col("size_l") != F.col("size_r")) | (F.col("fp_l") < F.col("fp_r"))
    same = (F.col("grid") == F.col("grid_r")) & (F.col("cell") == F.col("cell_r")) & (F.col("size") == F.col("size_r"))
    met = left.join(right, same & near & once)
    l, r = (F.struct(F.col(f"fp_{x}").alias("fp"), F.col(f"size_{x}").alias("size")) for x in "lr")  # noqa: E741
    both = met.select(F.least(l, r).alias("a"), F.greatest(l, r).alias("b")).distinct()
    return both.select(F.col("a.fp").alias("fp_a"), F.col("a.size").alias("size_a"), F.col("b.fp").alias("fp_b"), F.col("b.size").alias("size_b"))


def _across(prints: DataFrame, max_bits: int, limit: int) -> DataFrame:
    """a, b: pairs of ``prints(first, own, size, fp, sketch)`` that lie within ``max_bits`` bits,
    one size and ``limit`` bits of the sketch of each other and are in different groups."""
    kept, grids = ["first", "own", "size", "fp", *SKETCHED], 2 if max_bits <= 3 else 4
    cells = _cells(prints, max_bits).withColumn("cell", F.col("cell") + F.shiftleft(F.col("grid").cast("long"), 48))
    probes = _probes(cells, max_bits, False)
    # One step away from a cell of one grid never is a cell of another: the grid's number is above.
    left = probes.select("cell", "home", "grid", *(F.col("size_l" if c == "size" else c).alias(f"{c}_l") for c in kept))
    right = cells.select(F.col("cell").alias("cell_r"), *(F.col(c).alias(f"{c}_r") for c in kept))
    apart_by = lambda c: F.bit_count(F.col(f"{c}_l").bitwiseXOR(F.col(f"{c}_r")))
    far = apart_by(SKETCHED[0])
    for c in SKETCHED[1:]:
        far = far + apart_by(c)
    near = (F.col("own_l") != F.col("own_r")) & (F.abs(F.col("size_l") - F.col("size_r")) <= 1) & (apart_by("fp") <= max_bits) & (far <= limit)
    # Two that share cells meet in the first one alone, two that share none as neighbours.
    shares = lambda g: F.expr(f"{_counts('fp_l', g, grids)} = {_counts('fp_r', g, grids)}")
    earlier, any_ = F.lit(False), F.lit(False)
    for g in range(grids):
        earlier, any_ = earlier | (F.col("grid") > g) & shares(g), any_ | shares(g)
    once = F.when(F.col("home") == F.col("cell_r"), (F.col("first_l") < F.col("first_r")) & ~earlier).otherwise(~any_)
    met = left.join(right, (F.col("cell") == F.col("cell_r")) & near & once)
    return met.select(F.least("first_l", "first_r").alias("a"), F.greatest("first_l", "first_r").alias("b")).distinct()


def grouped(docs: DataFrame, shingle: int = 5, max_bits: int = MAX_BITS, length_ratio: float | None = None) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of each
    document with an id."""
    rows = staged(with_fingerprints(docs, shingle, length_ratio).filter("doc_id IS NOT NULL"), "fingerprints")
    classes = staged(rows.groupBy("fp", "size").agg(F.min("doc_id").alias("first")), "classes")
    pairs = near_pairs(classes if length_ratio else classes.drop("size"), max_bits)
    named = lambda c: classes.select(F.col("fp").alias(f"fp_{c}"), F.col("size").alias(f"size_{c}"), F.col("first").alias(f"first_{c}"))
    links = pairs.join(named("a"), ["fp_a", "size_a"]).join(named("b"), ["fp_b", "size_b"])
    # Classes are nodes by their first doc_id; classes that share an id (ids that repeat) are one node.
    groups = components(links, "first_a", "first_b")
    labelled = classes.join(groups, classes["first"] == groups["node"], "left").select("fp", "size", F.coalesce("component", "first").alias("component_id"))
    return rows.join(labelled, ["fp", "size"]).select("doc_id", "fp", "component_id")


# Near-duplicates by words, verified by shingles


SEEDS = (42, 7)  # of the fingerprints over a text's distinct words
VERIFY_ROWS = 64  # pairs of texts in an Arrow batch
SKETCH = 8  # longs of the fingerprint over shingles that sorts pairs out before their texts are read
ROUNDS = 3  # in which each document is linked to its nearest neighbour in a cell
NEXT = 48  # rows after it in a cell that a row is compared with in a round
IDS_BROADCAST = 1_000_000  # more ids than these are not broadcast
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _sketch_limit(threshold: float, deviations: float) -> int:
    """Bits in which the sketches of sets of that Jaccard similarity differ at most: the mean and
    so many deviations (two: all but 2 in a hundred; one: all but 16)."""
    share = math.acos(2 * threshold / (1 + threshold)) / math.pi
    n = 64 * SKETCH
    return int(n * share + deviations * math.sqrt(n * share * (1 - share)))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles (fewer words: the whole
    sequence; none: one of its own)."""
    import xxhash

    words = (text or "").encode().lower().split()
    known = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    h = np.array([known[w] for w in words], np.uint64)
    n = min(shingle, max(len(h), 1))
    rolled = np.full(max(len(h) - n + 1, 1), len(h) < n, np.uint64)
    for i in range(min(n, len(h))):
        rolled = (rolled * _ODD) ^ h[i : len(h) - n + 1 + i]
        rolled ^= rolled >> np.uint64(29)
    return np.unique(rolled)


def _majority(hashes: np.ndarray) -> np.ndarray:
    """The 64 bits that more than half of the hashes have set, as one long."""
    ones = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[low : low + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > max(len(hashes), 1)).view(">u8")[0]


def _traits(text: str | None, shingle: int) -> tuple[int, int, int, list[int], list[int]]:
    """128 bits that name the sequence of words, the number of distinct shingles, a fingerprint
    over the distinct words for each seed, and the sketch over the distinct shingles."""
    import xxhash

    words = (text or "").encode().lower().split()
    key = xxhash.xxh3_128_intdigest(b" ".join(words))
    distinct, shingles = set(words), shingle_set(text, shingle)
    fps = [int(_majority(np.array([xxhash.xxh64_intdigest(w, seed) for w in distinct], np.uint64))) for seed in SEEDS]
    sketch, h = [], shingles
    for _ in range(SKETCH):  # each long from another hash of the shingles
        h = (h ^ (h >> np.uint64(31))) * _ODD
        h ^= h >> np.uint64(29)
        sketch.append(int(_majority(h)))
    return key >> 64, key & ((1 << 64) - 1), len(shingles), fps, sketch


SKETCHED = [f"p{i}" for i in range(SKETCH)]
TRAITS = "doc_id long, high long, low long, size int, " + ", ".join(f"{c} long" for c in [f"fp{i}" for i in range(len(SEEDS))] + SKETCHED)


def _with_traits(docs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_traits(t, shingle) for t in batch.column(1).to_pylist()]
            size = [int(math.log(n) / -math.log(threshold)) for _, _, n, _, _ in found]
            longs = np.array([[h, w, *f, *p] for h, w, _, f, p in found], np.uint64).reshape(len(found), -1).view(np.int64)
            cols = [pa.array(np.ascontiguousarray(c)) for c in longs.T]
            yield pa.record_batch([batch.column(0), *cols[:2], pa.array(size, pa.int32()), *cols[2:]], names=[f.split()[0] for f in TRAITS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), TRAITS)


def _verified(docs: DataFrame, pairs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Of ``pairs(a, b)`` of doc_ids, those whose texts' shingle sets have a Jaccard similarity
    of at least ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                if a != last:
                    last, held = a, shingle_set(ta, shingle)
                other = shingle_set(tb, shingle)
                common = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(common >= threshold * (len(held) + len(other) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "asked")
    few = ids.count() <= IDS_BROADCAST  # else Spark meets them in a shuffle
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("t"))
    texts = staged(texts.join(F.broadcast(ids) if few else ids, "id", "left_semi"), "texts")
    first = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a")
    both = first.join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    with batches_of(docs.sparkSession, VERIFY_ROWS):
        out = staged(both.select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long"), "verified")
    dropped(docs.sparkSession, ids, texts)
    return out


def _nearest_in_cells(max_bits: int, limit: int):
    """Rows sorted by cell: each with the nearest of the ``NEXT`` rows on both sides of it in
    its cell that is in another group and near enough; a and b (a < b), and d."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met(rows: pa.RecordBatch, done: int) -> pa.RecordBatch:
            column = lambda c: rows.column(c).to_numpy()
            cell, first, own, size = (column(c) for c in ("cell", "first", "own", "size"))
            fp, sketch = column("fp").view(np.uint64), np.stack([column(c).view(np.uint64) for c in SKETCHED])
            n = len(cell)
            best, other = np.full(n, 1 << 20), np.full(n, -1)
            for step in range(1, min(NEXT, n - 1) + 1):
                i = np.flatnonzero((cell[:-step] == cell[step:]) & (own[:-step] != own[step:]) & (np.abs(size[:-step] - size[step:]) <= 1))
                i = i[i + step >= done]  # pairs of two rows that were here before are done
                i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= max_bits]
                if not len(i):
                    continue
                d = np.bitwise_count(sketch[:, i] ^ sketch[:, i + step]).sum(0, dtype=np.int64)
                i, d = i[d <= limit], d[d <= limit]
                for x, y in ((i, i + step), (i + step, i)):
                    nearer = d < best[x]
                    best[x[nearer]], other[x[nearer]] = d[nearer], y[nearer]
            at = np.flatnonzero(other >= 0)
            return pa.record_batch([pa.array(first[at]), pa.array(first[other[at]]), pa.array(best[at])], names=["first", "other", "d"])

        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if before is None else pa.Table.from_batches([before, batch]).combine_chunks().to_batches()[0]
            yield met(rows, 0 if before is None else before.num_rows)
            before = rows.slice(max(0, rows.num_rows - NEXT))

    return run


def similar_groups(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, max_bits: int = 7) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable) of each document with an id.
    Documents link if their sets of word shingles have a Jaccard similarity of at least
    ``threshold``, checked exactly, and their fingerprints over distinct words differ in at
    most ``max_bits`` bits for one of ``SEEDS``.

    Equal sequences of words are one row from the start. In rounds, each document is
    compared with a bounded number of others of its grid cells and linked to the nearest
    one, so a large group of near copies comes together over as many links as it has
    members; what is left is compared across groups. Before texts are read, a fingerprint
    of 512 bits over the shingles sorts out pairs that are too far apart: across groups a
    sixth of those of just that similarity go with them, hardly any of a higher one. Numbers of distinct shingles within a ratio of
    ``threshold`` are a condition of the similarity.

    Defined cases as in the module; a text of fewer words than a shingle is similar only to
    the same sequence of words. Rows of equal doc_id are one node."""
    spark = docs.sparkSession
    rows = staged(_with_traits(docs, shingle, threshold).filter("doc_id IS NOT NULL"), "traits")
    rest = [c for c in rows.columns if c not in ("doc_id", "high", "low")]
    classes = staged(rows.groupBy("high", "low").agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in rest)), "classes")
    links: DataFrame | None = None
    groups: DataFrame | None = None

    def prints(seed: int) -> DataFrame:
        """The classes with one fingerprint, and ``own``, the group of ``first`` so far."""
        df = classes.select("first", "size", F.col(f"fp{seed}").alias("fp"), *SKETCHED)
        if groups is None:
            return df.withColumn("own", F.col("first"))
        return df.join(groups.withColumnRenamed("node", "first"), "first", "left").withColumn("own", F.coalesce("component", "first")).drop("component")

    def add(pairs: DataFrame) -> None:
        nonlocal links, groups
        found = _verified(docs, pairs, shingle, threshold)
        links = found if links is None else links.unionByName(found)
        groups = staged(components(links), "groups")
        dropped(spark, pairs)

    for turn in range(ROUNDS):
        cells = None
        for seed in range(len(SEEDS)):
            part = _cells(prints(seed), max_bits).withColumn("cell", F.col("cell") + F.shiftleft(F.col("grid").cast("long") + 4 * seed, 48)).drop("grid", "ones")
            cells = part if cells is None else cells.unionByName(part)
        # A cell's rows in another order in each round; a hot cell lies in several ranges.
        cells = cells.withColumn("order", F.xxhash64("first", F.lit(turn)))
        dealt = cells.repartitionByRange(partitions(spark), "cell", "order").sortWithinPartitions("cell", "order").drop("order")
        with batches_of(spark, 1 << 15):
            near = staged(dealt.mapInArrow(tidy(_nearest_in_cells(max_bits, _sketch_limit(threshold, 2))), "first long, other long, d long"), "near")
        best = near.groupBy("first").agg(F.min(F.struct("d", "other")).alias("best"))
        pairs = best.select(F.least("first", "best.other").alias("a"), F.greatest("first", "best.other").alias("b")).distinct()
        add(staged(pairs, "pairs"))
        dropped(spark, near)
    for seed in range(len(SEEDS)):
        add(staged(_across(prints(seed), max_bits, _sketch_limit(threshold, 1)), "pairs"))
    named = classes.join(groups, classes["first"] == groups["node"], "left").select("high", "low", F.coalesce("component", "first").alias("component_id"))
    return rows.select("doc_id", "high", "low").join(apart(named), ["high", "low"]).select("doc_id", "component_id")


def deduplicate(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, max_bits: int = 7) -> DataFrame:
    """One document of each group of ``similar_groups``: the one with the smallest doc_id (and
    of rows that share it, all). Documents without an id stay."""
    kept = similar_groups(docs, shingle, threshold, max_bits).filter("doc_id = component_id").select(F.col("doc_id").alias("_kept_id")).distinct()
    stay = docs.join(kept, docs["doc_id"].cast("long") == kept["_kept_id"], "left_semi")
    return stay.unionByName(docs.filter(docs["doc_id"].isNull()))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouped(table(spark, sf_dir, "documents"), shingle=3, max_bits=MAX_BITS)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
