"""Filters, overwrite and anti-joins, tiers, merges, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def low_quality(df: DataFrame, score: str, below: int = 4) -> DataFrame:
    """Rows with a whole-number score below the bound."""
    value = F.col(score).try_cast("double")
    return df.filter((value < below) & (value == F.floor(value)))


def high_quality(df: DataFrame, *scores: str, at_least: float = 4.0) -> DataFrame:
    """Rows whose first score that is there reaches the bound."""
    return df.filter(F.coalesce(*(F.col(s).cast("double") for s in scores)) >= at_least)


def with_text(df: DataFrame, text: str) -> DataFrame:
    return df.filter(F.length(text) > 0)


def from_sources(df: DataFrame, source: str, wanted: list[str]) -> DataFrame:
    return df.filter(F.lower(F.trim(source)).isin([w.strip().lower() for w in wanted]))


def short_prompts(df: DataFrame, tokens: str, at_most: int) -> DataFrame:
    return df.filter(F.size(tokens) <= at_most)


def with_labels(df: DataFrame, labels: str, ignore: int = -100) -> DataFrame:
    """Rows with a label that is not ignored."""
    return df.filter(F.exists(labels, lambda x: x != ignore))


def overwrite(df: DataFrame, changes: DataFrame, id: str, target: str, value: str, confidence: str | None = None, at_least: float = 0.5) -> DataFrame:  # noqa: A002
    """``target`` replaced by the value of a change with enough confidence."""
    if confidence:
        changes = changes.filter(F.col(confidence) >= at_least)
    new = changes.select(F.col(id), F.col(value).alias("_new")).dropDuplicates([id])
    return df.join(new, id, "left").withColumn(target, F.coalesce("_new", target)).drop("_new")


def pending(items: DataFrame, done: DataFrame, id: str, by: str | None = None) -> DataFrame:  # noqa: A002
    """Items that have not been processed (``by``: each source by itself, with ids of its own). If any item lacks an id, processing is resumed
    by count instead: the items after as many rows as are done, in the order of ``id``'s
    place (``row_id``)."""
    if by:
        return items.join(done.select(by, id).distinct(), [by, id], "left_anti")
    if "row_id" in items.columns and not items.filter(F.col(id).isNull()).isEmpty():
        return items.filter(F.col("row_id") >= done.count())
    return items.join(done.select(id).distinct(), id, "left_anti")


def tiered(df: DataFrame, score: str, rare: str, id: str, quota: int, eligible: Column | None = None) -> DataFrame:  # noqa: A002
    """The first ``quota`` rows by score, then rarity, then id: whole tiers of high scores, the
    last one filled by rarity."""
    rows = df if eligible is None else df.filter(eligible)
    return rows.orderBy(F.desc(score), F.desc(rare), F.asc(id)).limit(quota)


def top_by(df: DataFrame, value: str, id: str, n: int) -> DataFrame:  # noqa: A002
    """The ``n`` highest values; what is no number ranks last."""
    number = F.coalesce(F.col(value).try_cast("double"), F.lit(float("-inf")))
    return df.orderBy(F.desc(number), F.asc(id)).limit(n)


def shuffled(df: DataFrame, id: str, seed: int) -> DataFrame:  # noqa: A002
    """A fixed random order, by a hash of the id and the seed."""
    return df.orderBy(F.xxhash64(F.col(id), F.lit(seed)), id)


def merge_top(original: DataFrame, mixed: DataFrame, value: str, id: str, n: int, seed: int = 42) -> DataFrame:  # noqa: A002
    """All of ``original`` and the top ``n`` of ``mixed`` as prompt and completion, shuffled."""
    both = original.unionByName(top_by(mixed, value, id, n), allowMissingColumns=True)
    return shuffled(both, id, seed).select(id, F.coalesce("prompt", F.lit("")).alias("prompt"), F.coalesce("completion", F.lit("")).alias("completion"))


def sample_per(df: DataFrame, group: str, id: str, n: int, seed: int = 42) -> DataFrame:  # noqa: A002
    """At most ``n`` rows of each group, chosen by a hash."""
    # A limit by rank within a group is applied before the shuffle too.
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.xxhash64(F.col(id), F.lit(seed)), id))
    return df.withColumn("_row", rank).filter(F.col("_row") <= n).drop("_row")


def sample(df: DataFrame, id: str, n: int, seed: int = 42) -> DataFrame:  # noqa: A002
    return df.orderBy(F.xxhash64(F.col(id), F.lit(seed)), id).limit(n)


def not_in(a: DataFrame, b: DataFrame, id: str) -> DataFrame:  # noqa: A002
    return a.join(b.select(id).distinct(), id, "left_anti")


def inside(a: DataFrame, b: DataFrame, id: str) -> DataFrame:  # noqa: A002
    return a.join(b.select(id).distinct(), id, "left_semi")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Both sides have the same set of keys."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def scoreboard(results: DataFrame, benchmarks: list[str]) -> DataFrame:
    """Percent of each benchmark to one place (missing: 0) and their mean."""
    spark = results.sparkSession
    wanted = spark.createDataFrame([(b,) for b in benchmarks], "benchmark string")
    each = wanted.join(results, "benchmark", "left").select("benchmark", F.round(F.coalesce("value", F.lit(0.0)) * 100, 1).alias("percent"))
    return each.unionByName(each.agg(F.round(F.avg("percent"), 1).alias("percent")).select(F.lit("average").alias("benchmark"), "percent"))
