"""Token-level expressions over arrays: masks, returns, penalties, losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, ColumnLike


def response_mask(ids: ColumnLike, eos: int) -> Column:
    """1 up to and with the first end token."""
    at = F.array_position(_c(ids), eos)
    return F.transform(_c(ids), lambda x, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def position_ids(mask: ColumnLike) -> Column:
    """Running sum of the mask less 1, at least 0."""
    m = _c(mask)
    return F.transform(m, lambda x, i: F.greatest(F.aggregate(F.slice(m, F.lit(1), i + 1), F.lit(0), lambda s, v: s + v.cast("int")) - 1, F.lit(0)))


def token_reward(score: ColumnLike, length: ColumnLike, size: ColumnLike) -> Column:
    """The score at the last token of the response, 0 elsewhere."""
    return F.transform(F.sequence(F.lit(1), _c(size)), lambda i: F.when(i == _c(length), _c(score)).otherwise(0.0))


def discounted_returns(rewards: ColumnLike, mask: ColumnLike, gamma: float = 1.0) -> Column:
    """Returns from the end backwards; the running return starts anew where the mask is 0."""
    z = F.reverse(F.arrays_zip(_c(rewards).alias("r"), _c(mask).alias("m")))
    zero = F.struct(F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out"))

    def step(acc, x):
        now = x["r"].cast("double") + acc["run"] * gamma
        return F.struct((now * x["m"].cast("double")).alias("run"), F.concat(F.array(now), acc["out"]).alias("out"))

    return F.aggregate(z, zero, step, lambda a: a["out"])


def gae(rewards: ColumnLike, values: ColumnLike, gamma: float = 1.0, lam: float = 1.0) -> Column:
    """Generalised advantage estimates (steps are not masked); returns are estimates plus values."""
    z = F.reverse(F.arrays_zip(_c(rewards).alias("r"), _c(values).alias("v")))
    zero = F.struct(F.lit(0.0).alias("gae"), F.lit(0.0).alias("next"), F.array().cast("array<double>").alias("out"))

    def step(acc, x):
        v = x["v"].cast("double")
        now = x["r"].cast("double") + acc["next"] * gamma - v + acc["gae"] * (gamma * lam)
        return F.struct(now.alias("gae"), v.alias("next"), F.concat(F.array(now), acc["out"]).alias("out"))

    return F.aggregate(z, zero, step, lambda a: a["out"])


def kl_penalty(log_probs: ColumnLike, reference: ColumnLike, kind: str = "kl") -> Column:
    """Per-token divergence: kl, abs, mse or low_var_kl; ``full`` takes arrays of each token's
    log-probabilities over the vocabulary."""
    if kind == "full":
        term = lambda a, b: F.exp(a.cast("double")) * (a.cast("double") - b.cast("double"))
        return F.zip_with(_c(log_probs), _c(reference), lambda a, b: F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x))

    def one(a, b):
        d = a.cast("double") - b.cast("double")
        if kind == "kl":
            return d
        if kind == "abs":
            return F.abs(d)
        if kind == "mse":
            return d * d * 0.5
        if kind == "low_var_kl":
            up = F.least(F.greatest(-d, F.lit(-20.0)), F.lit(20.0))
            return F.least(F.greatest(F.exp(up) - up - 1, F.lit(-10.0)), F.lit(10.0))
        raise ValueError(f"unknown kind {kind}")

    return F.zip_with(_c(log_probs), _c(reference), one)


def shaped_rewards(scores: ColumnLike, penalties: ColumnLike, coefficient: float) -> Column:
    return F.zip_with(_c(scores), _c(penalties), lambda s, k: s.cast("double") - k * coefficient)


def policy_loss(old: ColumnLike, new: ColumnLike, advantages: ColumnLike, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> Column:
    """Clipped loss of each token, with the lower bound of the dual clip for negative advantages."""
    z = F.arrays_zip(_c(old).alias("o"), _c(new).alias("n"), _c(advantages).alias("a"))

    def one(x):
        ratio = F.exp(F.least(F.greatest(x["n"] - x["o"], F.lit(-20.0)), F.lit(20.0)))
        clipped = F.least(F.greatest(ratio, F.lit(1 - low)), F.lit(1 + high))
        worse = F.greatest(-x["a"] * ratio, -x["a"] * clipped)
        return F.when(x["a"] < 0, F.least(worse, -x["a"] * dual)).otherwise(worse)

    return F.transform(z, one)


def policy_metrics(old: ColumnLike, new: ColumnLike, advantages: ColumnLike, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> dict[str, Column]:
    """Per token: clipped from above, clipped from below (negative advantages), the KL estimate
    and the entropy estimate (means over the mask give the reported figures)."""
    z = F.arrays_zip(_c(old).alias("o"), _c(new).alias("n"), _c(advantages).alias("a"))
    delta = lambda x: F.least(F.greatest(x["n"] - x["o"], F.lit(-20.0)), F.lit(20.0))

    def losses(x):
        ratio = F.exp(delta(x))
        clipped = F.least(F.greatest(ratio, F.lit(1 - low)), F.lit(1 + high))
        return -x["a"] * ratio, -x["a"] * clipped

    higher = F.transform(z, lambda x: (losses(x)[0] < losses(x)[1]).cast("double"))
    lower = F.transform(z, lambda x: ((F.greatest(*losses(x)) > -x["a"] * dual) & (x["a"] < 0)).cast("double"))
    return {"clip_higher": higher, "clip_lower": lower, "kl": F.transform(z, lambda x: -delta(x)), "entropy": F.transform(_c(new), lambda x: -x)}


def value_clipped(predicted: ColumnLike, returns: ColumnLike, values: ColumnLike, clip: float = 0.5) -> Column:
    """Per token 1 where the clipped prediction's loss is the larger one."""
    z = F.arrays_zip(_c(predicted).alias("p"), _c(returns).alias("r"), _c(values).alias("v"))
    held = lambda x: F.least(F.greatest(x["p"], x["v"] - clip), x["v"] + clip)
    return F.transform(z, lambda x: (F.pow(x["p"] - x["r"], 2) < F.pow(held(x) - x["r"], 2)).cast("double"))


def spans_masked(labels: ColumnLike, spans: ColumnLike, ignore: int = -100) -> Column:
    """Labels with all that lies outside ``spans`` (an array of (start, stop), from 0, half-open:
    the assistant's messages) ignored."""
    inside = lambda i: F.exists(_c(spans), lambda s: (i >= s["start"]) & (i < s["stop"]))
    return F.transform(_c(labels), lambda x, i: F.when(inside(i), x.cast("bigint")).otherwise(F.lit(ignore).cast("bigint")))


def value_loss(predicted: ColumnLike, returns: ColumnLike, values: ColumnLike, clip: float = 0.5) -> Column:
    z = F.arrays_zip(_c(predicted).alias("p"), _c(returns).alias("r"), _c(values).alias("v"))

    def one(x):
        held = F.least(F.greatest(x["p"], x["v"] - clip), x["v"] + clip)
        return F.greatest(F.pow(x["p"] - x["r"], 2), F.pow(held - x["r"], 2)) * 0.5

    return F.transform(z, one)


def masked_mean(values: ColumnLike, mask: ColumnLike) -> Column:
    z = F.zip_with(_c(values), _c(mask), lambda v, m: v.cast("double") * m.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return total(z) / (total(_c(mask)) + 1e-8)


def padded(ids: ColumnLike, size: int, pad: int, left: bool = False) -> Column:
    """Filled or cut to ``size``; a left fill keeps the end of what is too long."""
    a = _c(ids)
    fill = F.array_repeat(F.lit(pad).cast("bigint"), F.greatest(F.lit(size) - F.size(a), F.lit(0)))
    a = F.transform(a, lambda x: x.cast("bigint"))
    if left:
        return F.concat(fill, F.slice(a, F.greatest(F.lit(1), F.size(a) - size + 1), F.lit(size)))
    return F.concat(F.slice(a, 1, size), fill)


def prompt_masked(labels: ColumnLike, prompt_length: ColumnLike, ignore: int = -100) -> Column:
    """Labels with the prompt's part ignored."""
    return F.transform(_c(labels), lambda x, i: F.when(i < _c(prompt_length), F.lit(ignore).cast("bigint")).otherwise(x.cast("bigint")))


def subsequence_at(ids: ColumnLike, wanted: list[int], start: int = 1) -> Column:
    """1-based place of the first occurrence of ``wanted`` from ``start`` on, 0 if none."""
    a, n = _c(ids), len(wanted)
    sought = F.array(*(F.lit(w).cast("bigint") for w in wanted))
    places = F.filter(F.sequence(F.lit(start), F.greatest(F.size(a) - n + 1, F.lit(start))), lambda i: F.slice(a, i, F.lit(n)) == sought)
    return F.coalesce(F.try_element_at(places, F.lit(1)), F.lit(0))


def multiple_choice(best: ColumnLike, true: ColumnLike, false: ColumnLike) -> Column:
    """MC1, MC2, MC3 from log-probabilities of the best answer, true and false answers."""
    t, f = _c(true), _c(false)
    top = F.array_max(f)
    mass = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x))
    return F.struct(
        F.when(_c(best) > top, 1.0).otherwise(0.0).alias("mc1"),
        (mass(t) / (mass(t) + mass(f))).alias("mc2"),
        (F.size(F.filter(t, lambda x: x > top)) / F.size(t)).alias("mc3"),
        F.array_max(t).alias("max"),
        (F.array_max(t) - top).alias("diff"),
    )
