"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are lower-cased words and word beginnings of 4 to 7 letters (so that inflected
forms share a term). A vocabulary of terms that mark one label is chosen from labelled
examples (every term that passes the test, however many); inverse document frequencies are counted over all documents. Beside it stands
a common term that every text holds, once for each started run of 50 words: it keeps
one chance hit in a long text apart from many hits in a short one.
The labelled examples form an inverted index with postings in blocks; each block
knows its largest weight per term, which bounds the cosine of every example in it.
Blocks are visited from the largest bound down, until no bound can reach the k-th best
cosine: the neighbours are exact. Their votes weigh 1 / (distance + 0.05); a monotone
map from votes to probabilities, fitted leave-one-out on the examples, calibrates them.

Examples are a bounded sample: at most ``max_examples`` per label, those with the
smallest hash of the id, never of the held-out third. Labels, lang, source and doc_id
are never inputs of a score; equal texts have equal scores.

Defined cases: a null or empty text holds the common term alone, like any text without
a term of the vocabulary. Labels other than 0 and 1 are ignored. Among equal cosines the
example with the smallest doc_id is nearer. Without examples of both labels, or without
a term that marks one, scores are the share of label 1 (0 without labels). An empty
table gives no row; further columns are kept by ``filter_toxic`` and ignored elsewhere.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from .shared import held_out, partitions, short_batches, staged, table, text_key, tidy, without_texts

PREFIXES = (4, 5, 6, 7)
COMMON_WORDS = 50  # words for each occurrence of the common term
COMMON_WEIGHT = 3.0  # its weight, in place of an inverse document frequency
BLOCK = 64
MEMO = 200_000  # words that a task remembers, with a term and without one
SCORES = 20_000  # vectors whose neighbours it remembers
_WORDS = re.compile(r"[^\W\d_]+").findall


def terms_of(word: str) -> list[str]:
    """The word, and its beginnings marked with ``*``."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


class Vectoriser:
    """Texts to term counts over a vocabulary; the common term is numbered last."""

    def __init__(self, vocabulary: list[str]):
        self.place = {t: i for i, t in enumerate(vocabulary)}
        self._known: dict[str, tuple[int, ...]] = {}
        self._none: set[str] = set()

    def counts(self, text: str | None) -> tuple[tuple[int, int], ...]:
        """(term, count) pairs in ascending order of the term's number."""
        found: dict[int, int] = {}
        words = Counter(_WORDS((text or "").lower()))
        for word in words.keys() - self._none:
            at = self._known.get(word)
            if at is None:
                at = tuple(self.place[t] for t in terms_of(word) if t in self.place)
                if at:
                    if len(self._known) < MEMO:
                        self._known[word] = at
                else:
                    if len(self._none) >= MEMO:
                        self._none.clear()
                    self._none.add(word)
            for i in at:
                found[i] = found.get(i, 0) + words[word]
        return (*sorted(found.items()), (len(self.place), 1 + words.total() // COMMON_WORDS))


@dataclass
class Index:
    """Labelled examples as postings in blocks, with the largest weight of each block."""

    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # examples, weights, block starts
    largest: np.ndarray | None = None  # term x block
    first_ids: np.ndarray | None = None  # smallest doc_id of each block

    @staticmethod
    def ordered(examples: list[tuple[int, int, tuple]]) -> list[tuple[int, int, tuple]]:
        """Like vectors side by side, so that the bounds of a block are tight."""
        return sorted(examples, key=lambda e: (e[2], e[0], e[1]))

    @classmethod
    def build(cls, idf: np.ndarray, examples: list[tuple[int, int, tuple]]) -> Index:
        """``examples``: (doc_id, label, counts)."""
        examples = cls.ordered(examples)
        out = cls(idf, np.array([e[0] for e in examples], "i8"), np.array([e[1] for e in examples], "f8"))
        blocks = -(-len(examples) // BLOCK)
        out.first_ids = np.array([out.ids[b * BLOCK : b * BLOCK + BLOCK].min() for b in range(blocks)], "i8")
        lists: list[list[tuple[int, float]]] = [[] for _ in idf]
        for n, (_, _, counts) in enumerate(examples):
            for term, weight in out.vector(counts):
                lists[term].append((n, weight))
        out.largest = np.zeros((len(idf), max(blocks, 1)))
        for term, posts in enumerate(lists):
            rows = np.array([p[0] for p in posts], "i8")
            weights = np.array([p[1] for p in posts], "f8")
            starts = np.searchsorted(rows // BLOCK, np.arange(blocks + 1))
            np.maximum.at(out.largest[term], rows // BLOCK, weights)
            out.postings.append((rows, weights, starts))
        return out

    def vector(self, counts: tuple) -> list[tuple[int, float]]:
        raw = [(t, (1 + math.log(c)) * self.idf[t]) for t, c in counts]
        norm = math.sqrt(sum(w * w for _, w in raw))
        return [(t, w / norm) for t, w in raw]

    def nearest(self, counts: tuple, k: int, skip: int = -1) -> list[tuple[int, float]]:
        """The k nearest examples with a cosine over 0, as (place, cosine)."""
        query = self.vector(counts)
        bounds = np.zeros(self.largest.shape[1])
        for t, w in query:
            bounds += w * self.largest[t]
        best: list[tuple[float, int, int]] = []  # (-cosine, doc_id, place), ascending
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or len(best) == k and bounds[b] < -best[-1][0] - 1e-9:
                break
            if len(best) == k and bounds[b] <= -best[-1][0] + 1e-9 and self.first_ids[b] > best[-1][1]:
                continue  # at best as near, and of larger ids
            sums = np.zeros(BLOCK)
            for t, w in query:
                rows, weights, starts = self.postings[t]
                low, high = starts[b], starts[b + 1]
                sums[rows[low:high] - b * BLOCK] += w * weights[low:high]
            places = np.flatnonzero(sums)
            best += [(-round(float(sums[i]), 12), int(self.ids[b * BLOCK + i]), int(b * BLOCK + i)) for i in places if b * BLOCK + i != skip]
            best.sort()
            del best[k:]
        return [(place, -c) for c, _, place in best]

    def vote(self, near: list[tuple[int, float]]) -> float:
        weights = [1 / (1 - min(c, 1.0) + 0.05) for _, c in near]
        return sum(w * self.labels[p] for w, (p, _) in zip(weights, near, strict=True)) / sum(weights)


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: steps (x, value) of the best ascending map."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # largest x, mean, weight
    for i in order:
        pools.append([float(x[i]), float(y[i]), float(w[i])])
        while len(pools) > 1 and (pools[-2][1] >= pools[-1][1] or pools[-2][0] == pools[-1][0]):
            b, a = pools.pop(), pools.pop()
            weight = a[2] + b[2]
            pools.append([b[0], (a[1] * a[2] + b[1] * b[2]) / weight, weight])
    return np.array([p[0] for p in pools]), np.array([p[1] for p in pools])


@dataclass
class Model:
    vocabulary: list[str]
    index: Index | None
    base: float  # score where there is no index
    k: int = 15
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def __post_init__(self):
        self._begin()

    def _begin(self):
        self._vectoriser, self._memo = Vectoriser(self.vocabulary), {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_vectoriser", "_memo")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._begin()

    def calibrated(self, vote: float) -> float:
        x, y = self.steps
        # Between two steps the map is linear; the ends are held a little off 0 and 1.
        return float(np.clip(np.interp(vote, x, y), 0.001, 0.999))

    def explain(self, counts: tuple) -> tuple[float, np.ndarray, np.ndarray]:
        """Score, and the places and cosines of the neighbours that gave it; remembered for
        vectors that come again."""
        found = self._memo.get(counts)
        if found is None:
            if self.index is None:
                found = (self.base, np.zeros(0, np.int64), np.zeros(0))
            else:
                near = self.index.nearest(counts, self.k)
                found = (self.calibrated(self.index.vote(near)), np.array([p for p, _ in near], np.int64), np.array([c for _, c in near], float))
            if len(self._memo) >= SCORES:
                self._memo.clear()
            self._memo[counts] = found
        return found

    def explained(self, vectors: list[tuple]) -> tuple[pa.Array, pa.Array]:
        """Scores of vectors, and their evidence: lists of (doc_id, cosine, label)."""
        found = [self.explain(v) for v in vectors]
        places = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum([len(f[1]) for f in found]))).astype(np.int32)
        ids, labels = (self.index.ids[places], self.index.labels[places]) if self.index is not None else (places, places)
        cosines = np.concatenate([f[2] for f in found]) if found else np.zeros(0)
        kinds = [("doc_id", pa.int64(), ids), ("cosine", pa.float64(), cosines), ("label", pa.int32(), labels.astype(np.int32))]
        rows = pa.StructArray.from_arrays([pa.array(x, t) for _, t, x in kinds], names=[n for n, _, _ in kinds])
        return pa.array([f[0] for f in found], pa.float64()), pa.ListArray.from_arrays(pa.array(ends), rows)


def _pairs_of(terms: pa.Array, counts: pa.Array) -> list[tuple]:
    return [tuple(zip(t, c, strict=True)) for t, c in zip(terms.to_pylist(), counts.to_pylist(), strict=True)]


def _vectors(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, k0, k1 (the text's name), terms and counts over the vocabulary for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Vectoriser(vocabulary)
        for batch in batches:
            found = [made.counts(t) for t in batch.column(3).to_pylist()]
            cols = [pa.array([[p[i] for p in v] for v in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.record_batch([*batch.columns[:3], *cols], names=["doc_id", "k0", "k1", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(F.col("text")), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, k0 long, k1 long, terms array<int>, counts array<int>")


def _document_frequencies(rows: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Documents with each term (as many rows as there are terms), and all documents."""
    df = np.zeros(size, np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():
        df[r.t] = r.n
    return df, rows.count()


def _examples(labels: DataFrame, column: str, max_examples: int) -> tuple[dict[tuple[int, int], None], dict[int, int]]:
    """The chosen (doc_id, label) pairs, and how many labelled rows each label has."""
    known = labels.select(F.col("doc_id").cast("long"), F.col(column).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).distinct()
    totals = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    chosen = {}
    for label in (0, 1):
        rows = known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
        chosen |= dict.fromkeys((r.doc_id, label) for r in rows.collect())
    return chosen, totals


def _vocabulary(docs: DataFrame, least: int, lift: float, least_g: float) -> tuple[list[str], dict[int, int]]:
    """Terms that occur in enough examples and are at least ``lift`` times as frequent
    under one label, by the likelihood ratio. ``docs(text, label)`` are the examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter(), Counter()]
        n = [0, 0]
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[label] += 1
                seen[label].update({t for w in set(_WORDS((text or "").lower())) for t in terms_of(w)})
        keys = list(seen[0].keys() | seen[1].keys())
        for low in range(0, len(keys), 10_000):
            part = keys[low : low + 10_000]
            yield pa.record_batch([pa.array(part), pa.array([seen[0][t] for t in part], pa.int64()), pa.array([seen[1][t] for t in part], pa.int64())], names=["term", "a", "b"])
        yield pa.record_batch([pa.array([None], pa.string()), pa.array([n[0]], pa.int64()), pa.array([n[1]], pa.int64())], names=["term", "a", "b"])

    # Copies of a text under one label are one example of what marks the label.
    kinds = docs.select(F.col("text").cast("string").alias("text"), "label").withColumn("h", F.sha2("text", 256)).dropDuplicates(["h", "label"]).select("text", "label")
    counted = kinds.mapInArrow(tidy(run), "term string, a long, b long")
    counted = staged(counted.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "terms")
    total = counted.filter(F.col("term").isNull()).collect()
    n = (total[0].a, total[0].b) if total else (0, 0)
    if not min(n):
        return [], dict(enumerate(n))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    n0, n1 = float(n[0]), float(n[1])
    share = (a + b) / (n0 + n1)
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    g = 2 * (part(a, n0 * share) + part(b, n1 * share) + part(n0 - a, n0 * (1 - share)) + part(n1 - b, n1 * (1 - share)))
    rate0, rate1 = (a + 0.5) / n0, (b + 0.5) / n1
    kept = counted.filter(F.col("term").isNotNull() & (a + b >= least) & (F.greatest(rate1 / rate0, rate0 / rate1) >= lift))
    kept = kept.select("term", g.alias("g")).filter(F.col("g") >= least_g).orderBy(F.desc("g"), "term")
    return [r.term for r in kept.collect()], dict(enumerate(n))


def _votes(spark: SparkSession, index: Index, examples: list, k: int) -> list[float]:
    """The vote for each example from the others. Equal vectors of one label are searched once
    (leaving one of them out leaves equal others), by the executors."""
    first: dict[tuple, int] = {}
    for place, (_, label, counts) in enumerate(examples):
        first.setdefault((counts, label), place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(0).to_pylist()
            votes = [index.vote(index.nearest(examples[p][2], k, skip=p)) for p in places]
            yield pa.record_batch([batch.column(0), pa.array(votes, pa.float64())], names=["place", "vote"])

    asked = spark.createDataFrame([(p,) for p in first.values()], "place long").repartition(partitions(spark))
    known = {r.place: r.vote for r in asked.mapInArrow(tidy(run), "place long, vote double").collect()}
    return [known[first[counts, label]] for _, label, counts in examples]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    column: str = "toxic",
    max_examples: int = 4000,
    least_documents: int = 5,
    lift: float = 3.0,
    least_g: float = 15.0,
    k: int = 15,
) -> tuple[Model, DataFrame | None]:
    """The model, and the staged vectors of all documents."""
    short_batches(docs.sparkSession)
    spark = docs.sparkSession
    chosen, totals = _examples(labels, column, max_examples)
    n = sum(totals.values())
    base = totals.get(1, 0) / n if n else 0.0
    if not chosen or len(totals) < 2:
        return Model([], None, base), None
    # At most 2 * max_examples rows, whatever the input's size.
    wanted = F.broadcast(spark.createDataFrame(list(chosen), "doc_id long, label int"))
    vocabulary, _ = _vocabulary(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id"), least_documents, lift, least_g)
    if not vocabulary:
        return Model([], None, base), None
    rows = staged(_vectors(docs, vocabulary), "vectors")
    df, everything = _document_frequencies(rows, len(vocabulary) + 1)
    idf = np.log((everything + 1) / (df + 1)) + 1
    idf[-1] = COMMON_WEIGHT
    examples = [(r.doc_id, r.label, tuple(zip(r.terms, r.counts, strict=True))) for r in rows.select("doc_id", "terms", "counts").join(wanted, "doc_id").collect()]
    sampled = Counter(e[1] for e in examples)
    if min(sampled[0], sampled[1]) == 0 or len(examples) < 3:
        return Model([], None, base), rows
    weight = {c: totals.get(c, 0) / sampled[c] for c in (0, 1)}
    index = Index.build(idf, examples)
    examples = Index.ordered(examples)
    votes = _votes(spark, index, examples, k)
    x, y = monotone(np.array(votes), np.array([e[1] for e in examples], float), np.array([weight[e[1]] for e in examples]))
    return Model(vocabulary, index, base, k, (x, y)), rows


EVIDENCE = "array<struct<doc_id: long, cosine: double, label: int>>"


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted and the evidence of each document: its nearest
    examples with their cosine and label."""
    model, rows = fit(docs, labels, **options)
    if rows is None:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array().cast("array<int>").alias("terms"), F.array().cast("array<int>").alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, evidence = model.explained(_pairs_of(batch.column(1), batch.column(2)))
            yield pa.record_batch([batch.column(0), score, evidence], names=["doc_id", "score", "evidence"])

    # The vectors are small files that Spark reads as a few tasks; the search is spread out.
    dealt = rows.select("doc_id", "terms", "counts").repartition(partitions(docs.sparkSession))
    scored = dealt.mapInArrow(tidy(run), f"doc_id long, score double, evidence {EVIDENCE}")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def filter_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The documents whose score is below ``threshold``, with all their columns. Rows go by the
    names of the texts that were rejected (a score depends on the text alone)."""
    model, rows = fit(docs, labels, **options)
    if rows is None:
        return docs.filter(F.lit(model.base < threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = [model.explain(v)[0] >= threshold for v in _pairs_of(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(toxic, pa.bool_()))

    dealt = rows.select("k0", "k1", "terms", "counts").repartition(partitions(docs.sparkSession))
    return without_texts(docs, dealt.mapInArrow(tidy(run), "k0 long, k1 long"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)
