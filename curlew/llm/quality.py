"""Document quality by regularised quadratic discriminant analysis.

Each whole text gives a vector of transformed statistics (logarithms of counts,
logits of shares). The two classes have their own mean and covariance, from sums
over *all* labelled rows outside the held-out third; each covariance is shrunk
towards the pooled one and towards its diagonal. The Cholesky factor of each
covariance is computed once and cached with its log-determinant; a score is the
logistic function of the difference of the two log-densities (half the difference of
squared Mahalanobis distances and log-determinants) plus the log of the prior odds.

Labels, lang, source and doc_id are never inputs of a score.

Defined cases: a null or empty text has the statistics of an empty text and gets a
score like any other; rows without a label are scored and not learned from; labels
other than 0 and 1 are ignored; several labels of one document each count once; if
one of the classes has fewer than two rows, every score is the share of label 1
(0.5 without labels); an empty table gives no row; further columns are kept by
``filter_quality`` and ignored elsewhere.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import held_out, short_batches, staged, table, text_key, tidy, without_texts

FEATURES = (
    "log_chars", "log_words", "word_length", "word_length_spread", "distinct_words", "repeated_next",
    "top_word", "upper", "digits", "marks", "other_symbols", "bang", "pipes", "log_lines", "distinct_lines",
    "long_words", "word_marks", "compressed", "end_stops", "non_ascii",
)
N = len(FEATURES)
_CLASS = np.zeros((256, 7))
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (65 <= _b <= 90, 48 <= _b <= 57, _c in ".,;:'\"-()?", _c in "#$%&*+/<=>@[\\]^_`{}~", _b == 33, _b == 124, _b > 127)
_MARKED = re.compile(r"[^\w\s.,][^\w\s.,](?:\s|$)")


def _logit(share: float, n: float) -> float:
    """Log-odds of a share out of ``n``, finite at 0 and 1."""
    return math.log((share * n + 0.5) / ((1 - share) * n + 0.5))


def statistics(text: str | None) -> list[float]:
    """The vector of one whole text; see ``FEATURES``."""
    text = text or ""
    data = text.encode()
    n = len(data)
    by_class = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS if n else np.zeros(7)
    words = text.split()
    k = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    if k:
        lengths = np.fromiter(map(len, words), np.int64, k)
        mean, spread = float(lengths.mean()), float(lengths.std())
        long_words = float((lengths > 20).mean())
        kinds = set(words)
        distinct = len(kinds) / k
        after = sum(map(str.__eq__, words[1:], words)) / k
        top = max(map(words.count, kinds)) / k if len(kinds) <= 8 else _top(words) / k
    else:
        mean = spread = long_words = after = top = 0.0
        distinct = 1.0
    upper, digits, marks, symbols, bang, pipes, beyond = (float(x) / max(n, 1) for x in by_class)
    packed = len(zlib.compress(data, 1)) / n if n else 1.0
    return [
        math.log1p(n),
        math.log1p(k),
        mean,
        math.log1p(spread),
        _logit(distinct, k),
        _logit(after, k),
        _logit(top, k),
        _logit(upper, n),
        _logit(digits, n),
        _logit(marks, n),
        _logit(symbols, n),
        _logit(bang, n),
        _logit(pipes, n),
        math.log1p(len(lines)),
        _logit(len(set(lines)) / len(lines) if lines else 1.0, len(lines)),
        _logit(long_words, k),
        _logit(len(_MARKED.findall(text)) / max(k, 1) if symbols or bang else 0.0, k),
        math.log(packed),
        _logit(text.count(". ") / max(k, 1), k),
        _logit(beyond, n),
    ]


def _top(words: list[str]) -> int:
    from collections import Counter

    return Counter(words).most_common(1)[0][1]


def with_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``x``, the vector of each text (column ``text``)."""
    short_batches(docs.sparkSession)
    chosen = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = chosen.drop("text").schema.add("x", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            rest = batch.columns[:-1]
            yield pa.record_batch([*rest, pa.array(rows, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "x"])

    return chosen.mapInArrow(tidy(run), schema)


@dataclass(frozen=True)
class Discriminant:
    """Scores from cached Cholesky factors; ``None`` where a class was too small."""

    base: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None  # inverse of the lower Cholesky factors
    constants: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.base)
        density = [c - 0.5 * np.square((x - m) @ f.T).sum(1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def fit(labelled: DataFrame, shrink_pooled: float = 0.1, shrink_diagonal: float = 0.05) -> Discriminant:
    """``labelled(x, label)`` to a discriminant. Each task sums its rows, Spark adds up the
    tasks' sums, and the driver gets as many numbers as the two classes have moments."""
    width = 1 + N + N * N

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(-1, N)
            y = batch.column("label").to_numpy()
            for c in (0, 1):
                z = x[y == c]
                sums[c] += np.concatenate(([len(z)], z.sum(0), (z.T @ z).ravel()))
        yield pa.record_batch([pa.array([0, 1], pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], names=["label", "sums"])

    rows = labelled.select("x", F.col("label").cast("int").alias("label")).mapInArrow(tidy(run), "label int, sums array<double>")
    added = rows.select("label", F.posexplode("sums").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v"))
    total = np.zeros((2, width))
    for r in added.collect():
        total[r.label, r["at"]] = r.v
    n = total[:, 0]
    if min(n) < 2:
        return Discriminant(float(n[1] / n.sum()) if n.sum() else 0.5)
    means = total[:, 1 : 1 + N] / n[:, None]
    scatter = [total[c, 1 + N :].reshape(N, N) - n[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / n.sum()
    factors, constants = [], []
    for c in (0, 1):
        cov = scatter[c] / n[c]
        weight = max(shrink_pooled, min(1.0, 4 * N / n[c]))  # few rows lean on the pooled covariance
        cov = (1 - weight) * cov + weight * pooled
        cov = (1 - shrink_diagonal) * cov + shrink_diagonal * np.diag(np.diag(cov)) + 1e-3 * np.eye(N)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        constants.append(math.log(n[c] / n.sum()) - np.log(np.diag(low)).sum())
    return Discriminant(float(n[1] / n.sum()), means, np.array(factors), np.array(constants))


def learned_from(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """``rows`` joined to their labels of 0 or 1, without the held-out third."""
    known = labels.select(F.col("doc_id"), F.col(column).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out())
    return rows.join(known.distinct(), "doc_id")


def score_with(rows: DataFrame, model: Discriminant) -> DataFrame:
    """Replaces ``x`` by ``score``."""
    rest = [c for c in rows.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(-1, N)
            yield pa.record_batch([*batch.columns[:-1], pa.array(model.score(x), pa.float64())], names=[*rest, "score"])

    chosen = rows.select(*rest, "x")
    return chosen.mapInArrow(tidy(run), chosen.drop("x").schema.add("score", "double"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    rows = staged(with_statistics(docs), "statistics")
    scored = score_with(rows, fit(learned_from(rows, labels, "quality")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents with a score of at least ``threshold``, all their columns. Statistics are
    computed once and kept beside a text's name; rows then go by the names of the texts that
    were rejected (a score depends on the text alone)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *text_key(F.col("text")))
    rows = staged(with_statistics(rows, ("doc_id", "k0", "k1")), "statistics")
    model = fit(learned_from(rows.select("doc_id", "x"), labels, "quality"))
    return without_texts(docs, score_with(rows.select("k0", "k1", "x"), model).filter(F.col("score") < threshold))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)
