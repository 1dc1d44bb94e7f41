"""Batch algebra on ordered rows (``row_id`` counts from 0).

Defined cases: ``row_id`` is never null; an empty table has no batches; columns of any name are
kept, but for ``row_id`` itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select(df: DataFrame, names: list[str]) -> DataFrame:
    """Known names only; unknown ones are ignored."""
    return df.select(*(n for n in names if n in df.columns))


def pop(df: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The named columns, and the rest; both with row_id."""
    taken = [n for n in names if n in df.columns and n != "row_id"]
    return df.select("row_id", *taken), df.drop(*taken)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def rows_at(df: DataFrame, places: list[int]) -> DataFrame:
    return df.filter(F.col("row_id").isin(places))


def rows_between(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Half-open, as a slice."""
    return df.filter((F.col("row_id") >= start) & (F.col("row_id") < stop))


def chunk(df: DataFrame, parts: int) -> DataFrame:
    """Adds ``part``; the rows must divide evenly."""
    n = df.count()
    if n % parts:
        raise ValueError(f"{n} rows cannot be cut into {parts} equal parts")
    return df.withColumn("part", F.floor(F.col("row_id") / (n // parts)).cast("int"))


def split(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("part", F.floor(F.col("row_id") / size).cast("int"))


def concat(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, one after the other, numbered anew."""
    out, base = None, 0
    for p in parts:
        moved = p.withColumn("row_id", F.col("row_id") + F.lit(base))
        base += p.count()
        out = moved if out is None else out.unionByName(moved)
    return out


def pad_to(df: DataFrame, divisor: int) -> DataFrame:
    """Repeats leading rows until the number divides; they are flagged ``padding``."""
    n = df.count()
    pad = -n % divisor
    extra = [df.filter(F.col("row_id") < min(n, pad - at)).withColumn("row_id", F.col("row_id") + F.lit(n + at)) for at in range(0, pad, n or 1)] if n else []
    out = df.withColumn("padding", F.lit(False))
    for e in extra:
        out = out.unionByName(e.withColumn("padding", F.lit(True)))
    return out


def unpad(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("padding")).drop("padding")


def repeat(df: DataFrame, times: int, interleave: bool = True) -> DataFrame:
    """Each row ``times`` times, its copies side by side or the table as a whole again."""
    out = df.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    place = F.col("row_id") * times + F.col("_rep") if interleave else F.col("row_id") + F.col("_rep") * F.lit(df.count() if not interleave else 0)
    return out.withColumn("row_id", place.cast("long")).drop("_rep")


def reorder(df: DataFrame, order: list[int]) -> DataFrame:
    """Row i becomes the row that was at ``order[i]``."""
    places = F.create_map(*(F.lit(x) for i, o in enumerate(order) for x in (o, i)))
    return df.withColumn("row_id", F.element_at(places, F.col("row_id").cast("int")).cast("long"))


def union_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of both by row_id. Columns of both must agree; numbers of rows too."""
    common = [c for c in a.columns if c in b.columns and c != "row_id"]
    left, right = a, b.withColumnsRenamed({c: f"_r_{c}" for c in common})
    joined = left.join(right, "row_id", "full")
    clash = F.lit(False)
    for c in common:
        clash = clash | ~F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    if not joined.filter(clash).isEmpty() or a.count() != b.count():
        raise ValueError("columns of the two sides disagree")
    return joined.drop(*(f"_r_{c}" for c in common))


def collate(df: DataFrame, batch: str, *columns: str) -> DataFrame:
    """One row per batch with each column as an array in row order."""
    rows = F.array_sort(F.collect_list(F.struct("row_id", *columns)))
    packed = df.groupBy(batch).agg(rows.alias("_rows"))
    field = lambda c: F.transform("_rows", lambda r: r[c]).alias(c)
    return packed.select(batch, *map(field, columns))


def batch_ids(df: DataFrame, size: int, drop_last: bool = False) -> DataFrame:
    out = split(df, size).withColumnRenamed("part", "batch")
    return out.filter(F.col("batch") < df.count() // size) if drop_last else out


def epoch_batches(df: DataFrame, size: int, epochs: int, seed: int, drop_last: bool = False) -> DataFrame:
    """``epoch`` and ``batch`` of each row, in another fixed order in every epoch. Places within an
    epoch come from a hash in [0, 1): batches are its equal parts, of about ``size`` rows."""
    n = df.count()
    parts = max(n // size if drop_last else -(-n // size), 1)
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    place = F.pmod(F.xxhash64("row_id", "epoch", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    return rows.withColumn("batch", F.floor(place * parts).cast("int"))


class Cursor:
    """How far a run has come: epoch and batch, kept in a small JSON document."""

    def __init__(self, epoch: int = 0, batch: int = 0):
        self.epoch, self.batch = epoch, batch

    def rest(self, df: DataFrame) -> DataFrame:
        """Rows of ``epoch_batches`` that have not been taken."""
        return df.filter((F.col("epoch") > self.epoch) | (F.col("epoch") == self.epoch) & (F.col("batch") >= self.batch))

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([(self.epoch, self.batch)], "epoch int, batch int").coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark, path: str) -> Cursor:
        row = spark.read.schema("epoch int, batch int").json(path).first()
        return cls(row.epoch, row.batch)


def inverse_order(order: list[int]) -> list[int]:
    """Where each place of a permutation came from."""
    out = [0] * len(order)
    for i, o in enumerate(order):
        out[o] = i
    return out


def retained_checkpoints(df: DataFrame, step: str, limit: int, best: int | None = None) -> DataFrame:
    """The best step and the newest ``limit - 1`` others."""
    others = df.filter(F.col(step) != best) if best is not None else df
    newest = others.orderBy(F.desc(step)).limit(max(limit - (best is not None), 0))
    return newest.unionByName(df.filter(F.col(step) == best)) if best is not None else newest
