"""Group-normalised advantages, group filters and rollout metrics.

Defined cases: rows with a null group are a group of their own; null scores count in no mean and
have a null advantage; a group of one has none; an empty table gives no row (metrics: one
row of nulls); further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dealt


def grpo(df: DataFrame, group: str, score: str, out: str = "advantage", eps: float = 1e-6, strict: bool = False) -> DataFrame:
    """(score - mean) / (sample deviation + eps) within each group. A group of one has no
    deviation: null, or an error if ``strict``."""
    if strict and not df.groupBy(group).count().filter("count < 2").isEmpty():
        raise ValueError("a group has fewer than two rows")
    stats = _group_stats(df, group, F.avg(score).alias("_m"), F.stddev_samp(score).alias("_s"))
    return _with_stats(df, group, stats).withColumn(out, (F.col(score) - F.col("_m")) / (F.col("_s") + eps)).drop("_m", "_s")


def rloo(df: DataFrame, group: str, score: str, out: str = "advantage") -> DataFrame:
    """Score less the mean of the group's other scores; null in a group of one."""
    stats = _group_stats(df, group, F.sum(score).alias("_t"), F.count(score).alias("_n"))
    others = (F.col("_t") - F.col(score)) / F.when(F.col("_n") > 1, F.col("_n") - 1)
    return _with_stats(df, group, stats).withColumn(out, F.col(score) - others).drop("_t", "_n")


def _group_stats(df: DataFrame, group: str, *aggregates) -> DataFrame:
    return dealt(df.groupBy(F.col(group).alias("_g")).agg(*aggregates))


def _with_stats(df: DataFrame, group: str, stats: DataFrame) -> DataFrame:
    """Rows meet the numbers of their group in a join: those come from partial sums and are
    dealt out evenly, so that Spark can split a hot group; a window would put it in one task."""
    return df.join(stats, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def remax(df: DataFrame, score: str, baseline: str, out: str = "advantage") -> DataFrame:
    return df.withColumn(out, F.col(score) - F.col(baseline))


def whitened(df: DataFrame, value: str, out: str, eps: float = 1e-8) -> DataFrame:
    """Mean 0 and deviation 1 over the whole table; one broadcast row of two numbers."""
    stats = df.agg(F.avg(value).alias("_m"), F.var_samp(value).alias("_v"))
    return df.crossJoin(F.broadcast(stats)).withColumn(out, (F.col(value) - F.col("_m")) / F.sqrt(F.col("_v") + eps)).drop("_m", "_v")


def masked_whitened(df: DataFrame, values: str, mask: str, out: str, eps: float = 1e-8) -> DataFrame:
    """Token arrays with mean 0 and (sample) deviation 1 over all tokens that the mask holds;
    every token is moved, those outside the mask too. One broadcast row of three numbers, from
    sums of values and squares per row; a mask of at most one token has no correction."""
    total = lambda f: F.aggregate(F.zip_with(values, mask, f), F.lit(0.0), lambda s, x: s + x)
    held = lambda v, m: v.cast("double") * m.cast("double")
    sums = df.select(total(lambda v, m: m.cast("double")).alias("n"), total(held).alias("s"))
    first = sums.agg(F.sum("n").alias("_n"), F.sum("s").alias("_t")).withColumn("_m", F.col("_t") / (F.col("_n") + 1e-8))
    centred = df.crossJoin(F.broadcast(first))
    second = centred.select("_n", total(lambda v, m: F.pow(v.cast("double") - F.col("_m"), 2) * m.cast("double")).alias("q"))
    var = second.agg((F.sum("q") / (F.max("_n") + 1e-8) * F.when(F.max("_n") > 1, F.max("_n") / (F.max("_n") - 1)).otherwise(1.0)).alias("_v"))
    moved = F.transform(values, lambda v: (v.cast("double") - F.col("_m")) / F.sqrt(F.col("_v") + eps))
    return centred.crossJoin(F.broadcast(var)).withColumn(out, moved).drop("_n", "_t", "_m", "_v")


def token_means(df: DataFrame, mask: str, *values: str) -> DataFrame:
    """Mean of each array column over all tokens that the mask holds."""
    total = lambda a: F.sum(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")))
    n = total(F.col(mask)) + 1e-8
    return df.agg(*((total(F.zip_with(v, mask, lambda x, m: x.cast("double") * m.cast("double"))) / n).alias(v) for v in values))


def common_metrics(*tables: DataFrame) -> DataFrame:
    """key and the values of several ``(key, value)`` tables, for the keys that all of them have:
    value_0, value_1 and so on."""
    out = tables[0].select("key", F.col("value").alias("value_0"))
    for i, t in enumerate(tables[1:], 1):
        out = out.join(t.select("key", F.col("value").alias(f"value_{i}")), "key")
    return out


def merged_metrics(*tables: DataFrame) -> DataFrame:
    """One ``(key, value)`` table; of a key that several hold, the last table's value."""
    rows = None
    for i, t in enumerate(tables):
        part = t.select("key", "value", F.lit(i).alias("_i"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("key").agg(F.max_by("value", "_i").alias("value"))


def informative_groups(df: DataFrame, group: str, score: str, low: float, high: float) -> DataFrame:
    """Groups whose mean score lies strictly between the bounds."""
    kept = df.groupBy(group).agg(F.avg(score).alias("_m")).filter((F.col("_m") > low) & (F.col("_m") < high)).select(group)
    return df.join(dealt(kept), group, "left_semi")


def quota_groups(df: DataFrame, group: str, order: str, score: str, low: float, high: float, quota: int) -> DataFrame:
    """The first ``quota`` rows of informative groups in ``order``."""
    return informative_groups(df, group, score, low, high).orderBy(order).limit(quota)


def summary(df: DataFrame, *values: str) -> DataFrame:
    """metric, mean, max and min of each value column."""
    aggs = [f(c).alias(f"{c}|{n}") for c in values for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    row = df.agg(*aggs)
    parts = [F.struct(F.lit(c).alias("metric"), *(F.col(f"{c}|{n}").cast("double").alias(n) for n in ("mean", "max", "min"))) for c in values]
    return row.select(F.explode(F.array(*parts)).alias("m")).select("m.*")


def length_metrics(df: DataFrame, length: str, limit: int) -> DataFrame:
    """Mean, largest and smallest length, and the share that reaches the limit."""
    return df.agg(F.avg(length).alias("mean"), F.max(length).alias("max"), F.min(length).alias("min"), F.avg((F.col(length) >= limit).cast("double")).alias("clip_ratio"))


def explained_variance(df: DataFrame, returns: str, values: str, eps: float = 1e-5) -> DataFrame:
    return df.agg((1 - F.var_samp(F.col(returns) - F.col(values)) / (F.var_samp(returns) + eps)).alias("explained_variance"))


def timing_metrics(df: DataFrame, seconds: str, tokens: str, devices: int) -> DataFrame:
    """Milliseconds per token, and tokens per second and device."""
    return df.withColumn("ms_per_token", F.col(seconds) * 1000 / F.col(tokens)).withColumn("tokens_per_device_second", F.col(tokens) / (F.col(seconds) * devices))


def mean_metrics(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias("value"))


def mean_loss(df: DataFrame, losses: str, mask: str, by: str = "token") -> DataFrame:
    """Mean over all masked tokens, or over each row's masked mean."""
    z = F.zip_with(losses, mask, lambda a, m: a * m)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double"))
    rows = df.select(total(z).alias("s"), total(F.col(mask)).alias("n"))
    if by == "token":
        return rows.agg((F.sum("s") / (F.sum("n") + 1e-8)).alias("loss"))
    return rows.agg(F.avg(F.col("s") / (F.col("n") + 1e-8)).alias("loss"))


def flops_estimate(df: DataFrame, length: str, parameters: float, layers: int, hidden: int) -> DataFrame:
    """Training FLOPs of sequences: dense part plus attention, from sums of lengths and of
    their squares."""
    return df.agg((6.0 * parameters * F.sum(length) + 12.0 * layers * hidden * F.sum(F.col(length).cast("double") * F.col(length))).alias("flops"))


class KlController:
    """Fixed, or adaptive towards a target."""

    def __init__(self, coefficient: float, target: float | None = None, horizon: int = 10_000):
        self.coefficient, self.target, self.horizon = coefficient, target, horizon

    def update(self, current: float, steps: int) -> float:
        if self.target:
            error = min(max(current / self.target - 1, -0.2), 0.2)
            self.coefficient *= 1 + error * steps / self.horizon
        return self.coefficient
