"""Score noise: consensus counts, transition matrices, detection and correction.

Defined cases: rows without a vector have no neighbours and are never flagged; a null label
is counted in no class; ties between labels go to the smaller; an empty table gives no row
(matrices keep their smoothing); further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import staged
from .neighbours import knn_edges


def label_grid(spark: SparkSession, classes: int, *names: str) -> DataFrame:
    """All combinations of class numbers, one column per name."""
    out = spark.range(1).select(*(F.lit(0).alias("_"),))
    for n in names:
        out = out.withColumn(n, F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    return out.drop("_")


def patterns(df: DataFrame, id: str, vector: str, label: str) -> DataFrame:  # noqa: A002
    """y0, y1, y2: a row's label and those of its two nearest other rows."""
    edges = knn_edges(df, id, vector, 2)
    labels = df.select(F.col(id).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    near = edges.join(labels.select(F.col("id").alias("neighbour"), "y"), "neighbour")
    both = near.groupBy("id").agg(F.max(F.when(F.col("rank") == 1, F.col("y"))).alias("y1"), F.max(F.when(F.col("rank") == 2, F.col("y"))).alias("y2"))
    return labels.join(both, "id").select("id", F.col("y").alias("y0"), "y1", "y2")


def consensus_counts(found: DataFrame) -> DataFrame:
    """Counts of label patterns of order 1, 2 and 3 in one pass (grouping sets)."""
    return (
        found.groupingSets([("y0",), ("y0", "y1"), ("y0", "y1", "y2")], "y0", "y1", "y2")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
        .select(F.when(F.col("g") == 3, 1).when(F.col("g") == 1, 2).otherwise(3).alias("ord"), "y0", "y1", "y2", "n")
    )


def solve_consensus(c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, steps: int = 1500, rate: float = 0.1, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Transition matrix T and clean prior p whose analytic consensus of orders 1 to 3 is
    nearest to the observed one. Adam on softmax parameters, with exact gradients; a few
    hundred numbers, so it runs on the driver."""
    k, rng = len(c1), np.random.default_rng(seed)
    # The analytic consensus is symmetric, so only the symmetric part of the counts matters.
    c2 = (c2 + c2.T) / 2
    c3 = sum(c3.transpose(a) for a in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))) / 6
    a = np.eye(k) * 2 + 0.01 * rng.standard_normal((k, k))
    b = np.zeros(k)
    state = [np.zeros_like(a), np.zeros_like(a), np.zeros_like(b), np.zeros_like(b)]

    def soft(x):
        e = np.exp(x - x.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    best, kept = np.inf, None
    for step in range(1, steps + 1):
        t, p = soft(a), soft(b)
        e1 = p @ t
        pairs = (t[:, :, None] * t[:, None, :]).reshape(k, k * k)
        e2 = (p @ pairs).reshape(k, k)
        e3 = ((p[:, None] * t).T @ pairs).reshape(k, k, k)
        gaps = [e1 - c1, e2 - c2, e3 - c3]
        sizes = [np.linalg.norm(g) for g in gaps]
        loss = sum(sizes)
        if loss < best:
            best, kept = loss, (t.copy(), p.copy())
        g1, g2, g3 = (g / max(s, 1e-12) for g, s in zip(gaps, sizes, strict=True))
        inner = (pairs @ g3.reshape(k, k * k).T).reshape(k, k)
        dp = t @ g1 + pairs @ g2.ravel() + (inner * t).sum(1)
        dt = np.outer(p, g1) + p[:, None] * (2 * t @ g2 + 3 * inner)
        da = t * (dt - (dt * t).sum(1, keepdims=True))
        db = p * (dp - (dp * p).sum())
        for x, g, m, v in ((a, da, 0, 1), (b, db, 2, 3)):
            state[m] = 0.9 * state[m] + 0.1 * g
            state[v] = 0.999 * state[v] + 0.001 * g * g
            x -= rate * (state[m] / (1 - 0.9**step)) / (np.sqrt(state[v] / (1 - 0.999**step)) + 1e-8)
    return kept


def estimate_transition(df: DataFrame, id: str, vector: str, label: str, classes: int, rounds: int = 1, share: float = 0.9, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: A002
    """T, clean prior and observed prior from consensus counts averaged over sampled rounds
    (each searches neighbours within its sample). Only class counts reach the driver."""
    c = [np.zeros(classes), np.zeros((classes,) * 2), np.zeros((classes,) * 3)]
    for r in range(rounds):
        part = df if rounds == 1 else df.filter(F.pmod(F.xxhash64(F.col(id), F.lit(seed + r)), F.lit(1000)) < int(1000 * share))
        for row in consensus_counts(patterns(part, id, vector, label)).collect():
            at = tuple(x for x in (row.y0, row.y1, row.y2) if x is not None)
            c[row.ord - 1][at] += row.n
    c = [x / max(x.sum(), 1) for x in c]
    t, p = solve_consensus(*c, seed=seed)
    return t, p, c[0]


def transition_matrix(edges: DataFrame, labels: DataFrame, classes: int, smoothing: float = 1e-2) -> DataFrame:
    """i, j, prob: how often a row of class i has a neighbour of class j; smoothed and
    normalised by row. ``edges(id, neighbour)``, ``labels(id, y)``."""
    a = labels.select("id", F.col("y").alias("i"))
    b = labels.select(F.col("id").alias("neighbour"), F.col("y").alias("j"))
    counted = edges.join(a, "id").join(b, "neighbour").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    full = label_grid(edges.sparkSession, classes, "i", "j").join(counted, ["i", "j"], "left").select("i", "j", (F.coalesce("n", F.lit(0)) + smoothing).alias("x"))
    return full.select("i", "j", (F.col("x") / F.sum("x").over(W.partitionBy("i"))).alias("prob"))


def class_prior(labels: DataFrame, classes: int) -> DataFrame:
    """y and p: share of each class, lifted by 1e-8."""
    counted = labels.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    full = label_grid(labels.sparkSession, classes, "y").join(counted, "y", "left").select("y", (F.coalesce("n", F.lit(0)) + 1e-8).alias("x"))
    return full.select("y", (F.col("x") / F.sum("x").over(W.partitionBy())).alias("p"))


def true_transition(pairs: DataFrame, clean: str, noisy: str) -> DataFrame:
    """Row-normalised confusion of clean and noisy classes."""
    n = pairs.groupBy(F.col(clean).alias("i"), F.col(noisy).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("i", "j", (F.col("n") / F.sum("n").over(W.partitionBy("i"))).alias("prob"))


def label_distribution(df: DataFrame, id: str, vector: str, label: str, k: int = 10, norm: str = "l2") -> DataFrame:  # noqa: A002
    """id, y, weight: neighbours' labels weighted by similarity, the row itself with a
    distance that extends the line of the next two; normalised per row."""
    edges = knn_edges(df, id, vector, k, include_self=True)
    w = W.partitionBy("id")
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("distance"))).over(w)
    d = F.when(F.col("rank") == 1, 2 * at(2) - at(3)).otherwise(F.col("distance"))
    labels = df.select(F.col(id).cast("long").alias("neighbour"), F.col(label).cast("int").alias("y"))
    summed = edges.withColumn("d", d).join(labels, "neighbour").groupBy("id", "y").agg(F.sum(1 - F.col("d")).alias("x"))
    size = F.sqrt(F.sum(F.col("x") * F.col("x")).over(w)) if norm == "l2" else F.sum("x").over(w)
    return summed.select("id", "y", F.try_divide("x", size).alias("weight"))  # null where no neighbour has any weight


def corruption_score(distribution: DataFrame, labels: DataFrame) -> DataFrame:
    """id, label, score = -ln(weight of the own label + 1e-8)."""
    own = labels.select("id", F.col("y").alias("label"))
    joined = own.join(distribution, (own["id"] == distribution["id"]) & (own["label"] == distribution["y"]), "left")
    return joined.select(own["id"], "label", (-F.log(F.coalesce("weight", F.lit(0.0)) + 1e-8)).alias("score"))


def given_noisy(t: np.ndarray, clean: np.ndarray, observed: np.ndarray) -> np.ndarray:
    """P(clean i | noisy j) by Bayes."""
    return t * clean[:, None] / observed[None, :]


def _held(rates: dict[int, float]) -> dict[int, float]:
    return {c: 0.95 if r >= 1 else 0.05 if r <= 0 else r for c, r in rates.items()}


def exact_percentiles(df: DataFrame, key: str, value: str, shares: dict[int, float], margin: float = 1e-3) -> DataFrame:
    """``key`` and ``cut``, the percentile of each key's own share, interpolated. An approximate
    percentile on both sides brackets the wanted rows; only the share of a key's values
    inside the bracket (twice ``margin``) comes together, and the others are counted."""
    rows = df.filter(F.col(key).isin(list(shares)) & F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    of = F.element_at(F.create_map(*(F.lit(x) for c, s in sorted(shares.items()) for x in (c, float(s)))), F.col("k"))
    steps = sorted({x for s in shares.values() for x in (max(0.0, s - margin), min(1.0, s + margin))})
    marks = rows.groupBy("k").agg(F.percentile_approx("v", steps, 100_000).alias("m"), F.count(F.lit(1)).alias("n"))
    at = lambda x: F.array_position(F.array(*map(F.lit, steps)), x).cast("int")
    low = F.element_at("m", at(F.greatest(F.lit(0.0), of - margin)))
    high = F.element_at("m", at(F.least(F.lit(1.0), of + margin)))
    few = F.col("n") <= 100_000  # then a margin is less than a few ranks: all values come together
    marks = marks.select("k", "n", (of * (F.col("n") - 1)).alias("at"), F.when(few, F.lit(float("-inf"))).otherwise(low).alias("low"), F.when(few, F.lit(float("inf"))).otherwise(high).alias("high"))
    # One row for each key. Ranks bracket the value to within a few steps of the approximation.
    met = rows.join(F.broadcast(marks), "k")
    inside = (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))
    found = met.groupBy("k").agg(F.sum((F.col("v") < F.col("low")).cast("long")).alias("below"), F.array_sort(F.collect_list(F.when(inside, F.col("v")))).alias("vs"), F.first("at").alias("at"), F.first("n").alias("n"))
    lower = F.floor("at")
    pick = lambda i: F.get("vs", F.least(F.greatest(i - F.col("below"), F.lit(0)), F.size("vs") - 1).cast("int"))
    a, b = pick(lower), pick(F.least(lower + 1, F.col("n") - 1))
    return found.select(F.col("k").alias(key), (a + (b - a) * (F.col("at") - lower)).alias("cut"))


def flag_noisy(scores: DataFrame, rates: dict[int, float]) -> DataFrame:
    """Rows at or above their class's percentile of the corruption score. ``rates``: noise
    rate per class, held to .95 from 1 on and to .05 from 0 down."""
    held = _held(rates)
    cuts = exact_percentiles(scores, "label", "score", {c: 1 - r for c, r in held.items()})
    return scores.join(F.broadcast(cuts), "label").filter(F.col("score") >= F.col("cut")).select(*scores.columns)  # one cut for each class


def majority_noisy(distribution: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows whose strongest neighbour label (smallest among equals) is not their own."""
    top = distribution.groupBy("id").agg(F.max(F.struct("weight", (-F.col("y")).alias("y"))).alias("t")).select("id", (-F.col("t.y")).alias("suggested"))
    return labels.join(top, "id").filter(F.col("suggested") != F.col("y")).select("id", F.col("y").alias("label"), "suggested")


def vote(flags: DataFrame, drawn: DataFrame, labels: DataFrame, classes: int) -> DataFrame:
    """Votes of several rounds. ``flags(id, suggested)`` has a row per flagged round,
    ``drawn(id, times)`` the rounds that a row took part in (rows that are not there: 0, and
    an average of 0.5, which is not noisy). Returns id, noisy_avg, noisy,
    suggested and confidence; the own label is never suggested."""
    n = flags.groupBy("id").agg(F.count(F.lit(1)).alias("f"))
    rows = labels.join(drawn, "id", "left").join(n, "id", "left").select("id", "y", ((F.coalesce("f", F.lit(0)) + 1) / (F.coalesce("times", F.lit(0)) + 2)).alias("noisy_avg"), F.coalesce("f", F.lit(0)).alias("f"))
    said = flags.groupBy("id", "suggested").agg(F.count(F.lit(1)).alias("c"))
    grid = rows.withColumn("suggested", F.explode(F.sequence(F.lit(0), F.lit(classes - 1)))).join(said, ["id", "suggested"], "left")
    conf = F.when(F.col("suggested") == F.col("y"), F.lit(-1.0)).otherwise((F.coalesce("c", F.lit(0)) + 1) / (F.col("f") + classes))
    best = grid.groupBy("id", "noisy_avg").agg(F.max(F.struct(conf.alias("c"), (-F.col("suggested")).alias("s"))).alias("t"))
    return best.select("id", "noisy_avg", (F.col("noisy_avg") > 0.5).alias("noisy"), (-F.col("t.s")).alias("suggested"), (F.col("t.c") * F.col("noisy_avg")).alias("confidence"))


def detect(df: DataFrame, id: str, vector: str, label: str, classes: int, epochs: int = 3, k: int = 10, share: float = 0.9, seed: int = 0, method: str = "rank") -> DataFrame:  # noqa: A002
    """Rounds over samples of ``share`` of the rows, each flagged by rank or by majority, and
    their votes; a row of every labelled id. A round's neighbours are the nearest of its
    own sample: they come from one search of the whole table, which is repeated for more
    neighbours if a round has fewer than ``k`` of them."""
    labels = df.select(F.col(id).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    rates = None
    if method == "rank":
        t, clean, observed = estimate_transition(df, id, vector, label, classes, seed=seed)
        g = given_noisy(t, clean, np.maximum(observed, 1e-8))
        rates = {c: 1 - min(float(g[c, c]), 1.0) for c in range(classes)}
    elif method != "majority":
        raise ValueError(f"unknown method {method}")
    at = [F.pmod(F.xxhash64(F.col(id), F.lit(seed + e)), F.lit(1000)) < int(1000 * share) for e in range(epochs)]
    rows = staged(df.select(F.col(id).cast("long").alias("id"), F.col(label).cast("int").alias("y"), F.array(*at).alias("drawn")))
    judged = staged(_judged(df, rows, id, vector, k, share))  # read by several steps
    if rates is None:
        flags = judged.filter("suggested != y")
    else:
        held = _held(rates)
        numbered = judged.withColumn("class", F.col("round") * classes + F.col("y"))
        cut = exact_percentiles(numbered, "class", "score", {e * classes + c: 1 - held[c] for e in range(epochs) for c in range(classes)})
        flags = numbered.join(F.broadcast(cut), "class").filter("score >= cut AND suggested IS NOT NULL")  # a cut for each round and class
    times = rows.select("id", F.size(F.filter("drawn", lambda x: x)).alias("times"))
    return vote(staged(flags.select("id", "suggested")), times, labels, classes)


def _judged(df: DataFrame, rows: DataFrame, id: str, vector: str, k: int, share: float) -> DataFrame:  # noqa: A002
    """id, round, y, score and suggested (null without neighbours) of each row of
    ``rows(id, y, drawn)`` and each round in which it is drawn; as ``label_distribution``,
    ``corruption_score`` and ``majority_noisy`` have them over the rows of the round."""
    total, wide = rows.count(), int(k / max(share, 0.05)) + 10
    while True:
        edges = knn_edges(df, id, vector, wide, include_self=True)
        other = rows.select(F.col("id").alias("neighbour"), F.col("y").alias("label"), F.col("drawn").alias("there"))
        near = edges.join(other, "neighbour").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "distance", "label", "there"))).alias("near"))
        found = rows.join(near, "id", "left").select("id", "y", "near", F.posexplode("drawn").alias("round", "here")).filter("here")
        found = found.withColumn("wide", F.size("near")).withColumn("near", F.expr(f"slice(filter(near, x -> get(x.there, round)), 1, {k})"))
        found = staged(found.select("id", "round", "y", "wide", F.expr("transform(near, x -> struct(x.distance, x.label))").alias("near")))
        if wide >= total or found.filter(f"wide >= {wide} AND size(near) < {k}").isEmpty():
            break
        wide *= 2
    parts = "transform(near, (x, i) -> struct(x.label AS y, 1 - if(i = 0, 2 * get(near, 1).distance - get(near, 2).distance, x.distance) AS w))"
    summed = "transform(array_distinct(parts.y), c -> struct(aggregate(filter(parts, p -> p.y = c), 0D, (a, p) -> a + coalesce(p.w, 0D)) AS x, -c AS m))"
    found = found.withColumn("parts", F.expr(parts)).withColumn("dist", F.expr(summed))
    weight = F.expr("try_divide(get(filter(dist, d -> -d.m = y), 0).x, sqrt(aggregate(dist, 0D, (a, d) -> a + d.x * d.x)))")
    return found.select("id", "round", "y", (-F.log(F.coalesce(weight, F.lit(0.0)) + 1e-8)).alias("score"), (-F.array_max("dist")["m"]).alias("suggested"))


def random_transition(diagonal: list[float], seed: int) -> np.ndarray:
    """A transition matrix with the given diagonal; the rest of each row is dealt out at random."""
    k = len(diagonal)
    t = np.random.default_rng(seed).random((k, k))
    np.fill_diagonal(t, 0)
    t *= ((1 - np.array(diagonal)) / np.where(t.sum(1) > 0, t.sum(1), 1))[:, None]
    np.fill_diagonal(t, diagonal)
    return t


def synthetic_noise(df: DataFrame, id: str, label: str, t: np.ndarray, seed: int) -> DataFrame:  # noqa: A002
    """Labels flipped by the rows of a transition matrix, with a hash of the id as the draw."""
    steps = np.cumsum(t, 1)
    draw = F.pmod(F.xxhash64(F.col(id), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    flips = F.when(F.lit(False), F.lit(0))
    for i, row in enumerate(steps):
        new = F.size(F.filter(F.array(*(F.lit(float(x)) for x in row[:-1])), lambda x: x <= draw))
        flips = flips.when(F.col(label) == i, new)
    return df.withColumn("noisy_label", flips)
