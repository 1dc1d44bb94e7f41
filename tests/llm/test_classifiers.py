import math
import random
import zlib

import numpy as np
import pytest

from curlew.llm import quality, toxicity


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.fixture(scope="module")
def scored(spark):
    """Held-out rows of the smallest table with enough labels."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}


@pytest.mark.parametrize(("module", "place", "least"), [(quality, 0, 0.97), (toxicity, 1, 0.93)])
def test_held_out_accuracy(scored, module, place, least):
    docs, labels, truth = scored
    rows = module.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == is_held_out(r.doc_id) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    mine = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id][place] for r in mine]) >= least


@pytest.mark.parametrize(("module", "column"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_labels_are_not_learned(spark, scored, module, column):
    docs, labels, _ = scored
    flipped = labels.withColumn(column, (1 - labels[column]).cast("int"))
    mixed = labels.filter(~quality.held_out()).unionByName(flipped.filter(quality.held_out()))
    a = {r.doc_id: round(r.score, 9) for r in module.classify(docs, labels).collect()}
    b = {r.doc_id: round(r.score, 9) for r in module.classify(docs, mixed).collect()}
    assert a == b


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edges(spark, edge, empty, module):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 10)] + [(5, None, None), (None, 1, 1), (6, 7, 7)], "doc_id long, quality int, toxic int")
    rows = module.classify(edge, labels).collect()
    assert len(rows) == 10
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert all(0 <= r.score <= 1 for r in rows)
    assert module.classify(empty, labels).collect() == []
    none = labels.limit(0)
    assert len({r.score for r in module.classify(edge, none).collect()}) == 1
    keep = quality.filter_quality if module is quality else toxicity.filter_toxic
    kept = keep(edge, labels)
    assert kept.columns == edge.columns
    assert kept.count() <= 10
    assert keep(empty, none).count() == 0


def test_statistics_are_finite():
    for t in (None, "", " ", "a", "!!!", "\n\n", "x" * 100_000, "日本語", "a " * 10_000):
        x = quality.statistics(t)
        assert len(x) == quality.N
        assert all(math.isfinite(v) for v in x)


def test_discriminant_matches_the_densities():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((5, quality.N))
    covs = []
    for _ in range(2):
        a = rng.standard_normal((quality.N, quality.N))
        covs.append(a @ a.T + np.eye(quality.N))
    means = rng.standard_normal((2, quality.N))
    lows = [np.linalg.cholesky(c) for c in covs]
    priors = (0.3, 0.7)
    model = quality.Discriminant(0.7, means, np.array([np.linalg.inv(low) for low in lows]), np.array([math.log(p) - np.log(np.diag(low)).sum() for p, low in zip(priors, lows, strict=True)]))
    logs = [math.log(p) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) for p, c, m in zip(priors, covs, means, strict=True)]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500))))


@pytest.mark.parametrize("seed", range(4))
def test_block_max_search_is_exact(seed):
    rng = random.Random(seed)
    terms = 12
    idf = np.array([rng.uniform(1, 5) for _ in range(terms)])
    made = lambda: tuple(sorted((t, rng.randint(1, 4)) for t in rng.sample(range(terms), rng.randint(1, 4))))
    examples = [(i * 3 % 1000, rng.randint(0, 1), made()) for i in range(400)]
    index = toxicity.Index.build(idf, examples)

    def cosine(a, b):
        a, b = dict(index.vector(a)), dict(index.vector(b))
        return round(sum(w * b.get(t, 0.0) for t, w in a.items()), 9)

    for _ in range(40):
        q = made()
        brute = sorted(((-cosine(q, c), i) for i, _, c in examples if cosine(q, c) > 0))[:7]
        got = [(-round(c, 9), int(index.ids[p])) for p, c in index.nearest(q, 7)]
        assert got == brute


def test_monotone():
    x, y = toxicity.monotone(np.array([0.1, 0.2, 0.2, 0.9]), np.array([1.0, 0.0, 1.0, 1.0]), np.ones(4))
    assert list(y) == sorted(y)
    assert y[-1] == 1.0


def test_evidence(scored):
    docs, labels, truth = scored
    rows = toxicity.classify(docs, labels).filter("predicted = 1").limit(5).collect()
    for r in rows:
        assert all(e.label == truth[e.doc_id][1] and not is_held_out(e.doc_id) for e in r.evidence)
        assert [e.cosine for e in r.evidence] == sorted((e.cosine for e in r.evidence), reverse=True)
