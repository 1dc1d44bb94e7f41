"""Document fingerprints: threshold-scaled sketches, in DataFrame functions only.

A word's hash is XXH64; a shingle's hash chains those of its words. A sketch keeps
every shingle hash (its upper 48 bits) below ``2**48 / scale``, sorted and without
repeats: an expected share ``1 / scale`` of the shingles, whatever the document's
length. Sketches of two texts merge by union, and the share of the smaller sketch
that lies in the larger estimates containment even if lengths differ widely.

A fingerprint is the sketch as 12 hexadecimal digits per hash. If no hash of a text
that has words is below the threshold, the fingerprint is ``~`` and the least hash, so
that different short texts still differ; it counts as a sketch of one hash, which a longer
sketch does not hold: such a text has likeness 0 to a long one that contains it whole.

Defined cases: a null text is an empty text; a text without words has an empty
fingerprint; a text with fewer words than a shingle is one shingle; two equal
fingerprints have likeness 1 (empty ones too), an empty and another one 0; rows
without doc_id are left out of ``with_neighbour`` (they have no place in the order);
equal doc_ids follow each other in the order of their texts; an empty table gives no
row; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import partitions, table

SHINGLE = 5
SCALE = 8


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """Ascending array of retained hashes; one negative number, ``-1 - least hash``, if a
    text with words has no hash below the threshold."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.transform(F.array(hashes), lambda h: _retained(h, shingle, scale))[0]


def _retained(h: Column, shingle: int, scale: int) -> Column:
    n = F.size(h)
    chained = F.transform(F.sequence(F.lit(1), n - (shingle - 1)), lambda i: F.shiftrightunsigned(F.xxhash64(*(F.element_at(h, i + j) for j in range(shingle))), 16))
    whole = F.array(F.shiftrightunsigned(F.aggregate(h, F.lit(42).cast("long"), lambda seed, x: F.xxhash64(seed, x)), 16))
    every = F.when(n >= shingle, chained).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))
    # An array of one element stands for a name: its expression is evaluated once.
    return F.transform(F.array(every), lambda e: _below(e, (1 << 48) // scale))[0]


def _below(every: Column, bound: int) -> Column:
    least = F.aggregate(every, F.lit(1 << 48), lambda a, x: F.least(a, x))
    kept = F.array_sort(F.array_distinct(F.filter(every, lambda x: x < bound)))
    return F.when(F.size(every) == 0, F.array().cast("array<bigint>")).when(least >= bound, F.array(-1 - least)).otherwise(kept)


def as_text(found: Column) -> Column:
    """The fingerprint of a sketch."""
    digits = lambda x: F.lpad(F.lower(F.hex(x)), 12, "0")
    head = F.get(found, F.lit(0))  # null in an empty sketch, where element_at is an error in ANSI mode
    return F.when(head < 0, F.concat(F.lit("~"), digits(-1 - head))).otherwise(F.array_join(F.transform(found, digits), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that lies in the other: containment, 0 to 1."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(a == b, F.lit(1.0)).when(smaller == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / smaller)


def _place(x: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are at most ``x``: first in steps of their square
    root, then within a step."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)] + [[]]
    numbers = lambda found: F.array(*map(F.lit, found)).cast("array<bigint>")
    passed = F.size(F.filter(numbers([b[-1] for b in blocks if len(b) == step]), lambda c: c <= x))
    inside = F.element_at(F.array(*map(numbers, blocks)), passed + 1)
    return passed * step + F.size(F.filter(inside, lambda c: c <= x))


def with_neighbour(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``after``: the text of the next document in ascending doc_id
    (of the last, the first). Quantiles of doc_id cut the order into ranges of about
    equal size; the first document of each range is also put at the end of the range
    before, so each range finds its neighbours by itself."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("doc_id IS NOT NULL")
    n = 4 * partitions(spark)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    cuts = sorted(set(cuts))  # at most n numbers
    place = _place(F.col("doc_id"), cuts)
    ranged = rows.withColumn("part", place)
    first = {r.part: r.first for r in ranged.groupBy("part").agg(F.min("doc_id").alias("first")).collect()}
    order = sorted(first)
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("guest"))
    places = F.array(own)
    if order:
        before = {p: order[i - 1] for i, p in enumerate(order)}
        every = range(max(order) + 1)
        firsts = F.array(*(F.lit(first.get(p)) for p in every)).cast("array<bigint>")
        befores = F.array(*(F.lit(before.get(p)) for p in every)).cast("array<int>")
        guest = F.struct(F.element_at(befores, F.col("part") + 1).alias("part"), F.lit(1).alias("guest"))
        places = F.when(F.element_at(firsts, F.col("part") + 1) == F.col("doc_id"), F.array(own, guest)).otherwise(places)
    dealt = ranged.select("doc_id", "text", F.explode(places).alias("at")).select("doc_id", "text", "at.part", "at.guest")
    after = F.lead("text").over(W.partitionBy("part").orderBy("guest", "doc_id", "text"))
    return dealt.withColumn("after", after).filter("guest = 0").select("doc_id", "text", "after")


def op10_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_neighbour(table(spark, sf_dir, "documents"))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - quarter), F.col("after").substr(F.lit(1), quarter))
    made = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), sketch(F.col("text")).alias("s"), sketch(edited).alias("e"), sketch(F.col("after")).alias("a"))
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("s")).alias("fingerprint"),
        as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("e")).alias("near_edited"),
        likeness(F.col("s"), F.col("a")).alias("near_next"),
    )
