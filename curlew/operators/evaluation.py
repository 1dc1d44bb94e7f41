"""Benchmark metrics: accuracies, exact match, F1, recall, log-probability roll-ups.

Defined cases: a null prediction is wrong; null levels are the group ``all`` by name; an
empty table gives null means; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_match


def micro_accuracy(df: DataFrame, correct: str, *levels: str) -> DataFrame:
    """Share of correct rows for every value of each level, and over all, in one pass."""
    sets = [(level,) for level in levels] + [()]
    out = df.groupingSets(sets, *levels).agg(F.grouping_id().alias("g"), F.avg(F.col(correct).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    full = (1 << len(levels)) - 1
    level = F.lit("all")
    for i, name in enumerate(levels):
        level = F.when(F.col("g") == full - (1 << (len(levels) - 1 - i)), F.lit(name)).otherwise(level)
    return out.select(level.alias("level"), F.coalesce(*(F.col(x).cast("string") for x in levels), F.lit("all")).alias("name"), "accuracy", "n")


def category_accuracy(df: DataFrame, correct: str, subject: str, categories: DataFrame) -> DataFrame:
    """Share of correct rows of each category. ``categories(subject, category)`` is small, and a
    subject may be in several; subjects in none count nowhere."""
    rows = df.join(F.broadcast(categories.select(F.col("subject").alias(subject), "category").distinct()), subject)  # a row for each subject and category
    return rows.groupBy("category").agg(F.avg(F.col(correct).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def macro_exact_match(df: DataFrame, task: str, predicted: str, truth: str) -> DataFrame:
    """Exact match per task, and the mean of the tasks."""
    each = df.groupBy(F.col(task).alias("task")).agg(F.avg((F.col(predicted) == F.col(truth)).cast("double")).alias("exact_match"))
    return each.unionByName(each.agg(F.avg("exact_match").alias("exact_match")).select(F.lit("average").alias("task"), "exact_match"))


def exact_match(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Case and punctuation aside (so 3.5 equals 35)."""
    return df.agg(F.avg((normal_match(predicted) == normal_match(truth)).cast("double")).alias("exact_match"))


def answer_tokens(x: Column | str) -> Column:
    """Lower case, without punctuation and articles, split at white space."""
    s = F.regexp_replace(F.lower(F.col(x) if isinstance(x, str) else x), r"\p{Punct}", "")
    s = F.regexp_replace(s, r"\b(a|an|the)\b", " ")
    return F.filter(F.split(s, r"\s+"), lambda w: w != "")


def token_f1(predicted: Column | str, truth: Column | str) -> Column:
    """Harmonic mean of the shares of common tokens, with repeats."""
    p, t = answer_tokens(predicted), answer_tokens(truth)
    count = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    common = F.aggregate(F.array_distinct(p), F.lit(0), lambda s, w: s + F.least(count(p, w), count(t, w)))
    return F.when((F.size(p) == 0) | (F.size(t) == 0), (F.size(p) == F.size(t)).cast("double")).otherwise(2.0 * common / (F.size(p) + F.size(t)))


def best_f1(df: DataFrame, predicted: str, truths: str) -> DataFrame:
    """Adds f1, exact and recall (truth inside the prediction, 0 or 100): best over the truths."""
    best = lambda f: F.array_max(F.transform(truths, f))
    joined = lambda x: F.array_join(answer_tokens(x), " ")
    return df.withColumns({"f1": best(lambda t: token_f1(predicted, t)) * 100, "exact": best(lambda t: (joined(F.col(predicted)) == joined(t)).cast("double")) * 100, "recall": best(lambda t: F.lower(F.col(predicted)).contains(F.lower(t)).cast("double")) * 100})


def by_language(df: DataFrame, language: str, *metrics: str) -> DataFrame:
    """Means per language, and the mean of the languages."""
    each = df.groupBy(F.col(language).alias("language")).agg(*(F.avg(m).alias(m) for m in metrics))
    return each.unionByName(each.agg(*(F.avg(m).alias(m) for m in metrics)).select(F.lit("average").alias("language"), *metrics))


def top_k_accuracy(df: DataFrame, ranked: str, label: str, *ks: int) -> DataFrame:
    """Share of rows whose label is among the first k of an array of labels."""
    return df.agg(*(F.avg(F.array_contains(F.slice(F.col(ranked), 1, k), F.col(label)).cast("double")).alias(f"top{k}") for k in ks))


def completion_scores(df: DataFrame, prompt: str, completion: str, log_prob: str, how: str = "sum") -> DataFrame:
    """Per prompt a map of completion to the sum, mean or maximum of its token scores."""
    f = {"sum": F.sum, "mean": F.avg, "max": F.max}[how]
    each = df.groupBy(prompt, completion).agg(f(log_prob).alias("s"))
    return each.groupBy(prompt).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(completion), F.col("s"))))).alias("scores"))


def joint_accuracy(df: DataFrame, model: str, first: str, second: str, at_least: float = 0.5) -> DataFrame:
    """Means of two judged qualities and of their product."""
    a, b = (F.col(first) >= at_least).cast("double"), (F.col(second) >= at_least).cast("double")
    return df.groupBy(model).agg(F.avg(a).alias("first"), F.avg(b).alias("second"), F.avg(a * b).alias("both"))


def metric_table(df: DataFrame, model: str, metric: str, value: str, metrics: list[str]) -> DataFrame:
    """Models down, metrics across, mean values."""
    return df.groupBy(model).pivot(metric, metrics).agg(F.avg(value))
