"""Nulls, empty tables, tiny groups and clashing names, as the modules' docstrings define them."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curlew import settings
from curlew.operators import advantages, balance, batches, bayes, centrality, clusters, dedup, embedding, evaluation, neighbours, noise, prompts, ratings
from curlew.plans.catalog import _QUERIES
from curlew.storage import fresh_folder

VECTORS = "id long, v array<float>, y int, x int"


@pytest.fixture(scope="module")
def vecs(spark):
    rows = [(i, [math.cos(i), math.sin(i), 1.0], i % 2, 7) for i in range(12)]
    rows += [(20, None, 1, 7), (None, [1.0, 0.0, 0.0], 1, 7), (21, [1.0, None, 0.0], 0, 7), (22, [0.0, 0.0, 0.0], 0, 7), (23, [1.0, 2.0], 1, 7), (24, [2.0, 1.0, 0.5], None, 7)]
    return spark.createDataFrame(rows, VECTORS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], VECTORS)


def test_neighbours(vecs, none):
    edges = neighbours.knn_edges(vecs, "id", "v", 3).collect()
    assert {r.id for r in edges} == {*range(12), 22, 24}  # 23 has no vector of its length beside it
    assert all(r.neighbour not in (20, 21, 23, None) for r in edges)
    assert neighbours.knn_edges(none, "id", "v", 3).collect() == []
    assert all(math.isclose(r.distance, 1.0) for r in edges if r.id == 22)
    pairs = neighbours.near_pairs(vecs, "id", "v", 0.9).collect()
    assert all({r.a, r.b} <= {*range(12), 24} for r in pairs)
    assert neighbours.near_pairs(none, "id", "v", 0.9).collect() == []


def test_noise(spark, vecs, none):
    labels = vecs.select("id", "y")
    dist = noise.label_distribution(vecs, "id", "v", "y", 4)
    assert not {20, 21, None} & {r.id for r in dist.collect()}
    assert noise.majority_noisy(dist, labels).filter("id IN (20, 21)").count() == 0
    assert noise.patterns(none, "id", "v", "y").collect() == []
    t = noise.transition_matrix(neighbours.knn_edges(none, "id", "v", 2), none.select("id", "y"), 2).collect()
    assert [round(r.prob, 6) for r in t] == [0.5] * 4
    assert noise.flag_noisy(spark.createDataFrame([], "id long, label int, score double"), {0: 0.2}).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1013])
@pytest.mark.parametrize("share", [0.05, 0.5, 0.85, 0.95])
def test_percentiles_are_exact(spark, n, share):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 50, n).astype(float)
    df = spark.createDataFrame([(1, float(v)) for v in values] + [(2, None), (3, 9.0)], "k int, v double")
    got = {r.k: r.cut for r in noise.exact_percentiles(df, "k", "v", {1: share, 2: 0.5}).collect()}
    assert got == {1: pytest.approx(np.percentile(values, 100 * share))}


def test_percentiles_of_many_values(spark):
    df = spark.range(300_000).select(F.lit(1).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("v"))
    values = np.array([r.v for r in df.select("v").collect()])
    for share in (0.05, 0.631, 0.95):
        assert noise.exact_percentiles(df, "k", "v", {1: share}).first().cut == pytest.approx(np.percentile(values, 100 * share))


def test_random_transition():
    t = noise.random_transition([0.7, 0.4, 1.0], 3)
    assert np.allclose(t.sum(1), 1)
    assert np.allclose(np.diag(t), [0.7, 0.4, 1.0])


def test_bayes(spark, vecs, none):
    library = bayes.build_library(vecs, "id", "v", "y", 2, k=3)
    asked = vecs.select("id", "v")
    found = bayes.score_queries(asked, library, 4)
    assert not {20, 21} & {r.q for r in found.collect()}
    whole = {r.q: r.reward for r in bayes.with_default(asked.filter("id IS NOT NULL"), found).collect()}
    assert whole[20] == 0.5
    assert set(whole) == {*range(12), 20, 21, 22, 23, 24}
    assert bayes.score_queries(none.select("id", "v"), library, 4).collect() == []
    assert bayes.class_index(none, "y").collect() == []


def test_clusters(vecs, none):
    near = clusters.similarities(vecs, "id", "v", np.eye(2, 3), 1).collect()
    assert not {20, 21, 23} & {r.id for r in near}
    found = clusters.capacity_clusters(vecs.filter("id < 12 OR id IS NULL OR id IN (20, 21)"), "id", "v", "y", 3, 4, 3, 1).collect()
    assert {r.id for r in found} == set(range(12))
    small = clusters.capacity_clusters(vecs.filter("id < 2"), "id", "v", "y", 5, 15, 10, 2).collect()
    assert sorted(r.id for r in small) == [0, 1]
    assert clusters.capacity_clusters(none, "id", "v", "y", 5, 15, 10, 2).collect() == []
    assert clusters.block_capacities(3, 5, 15, 10, 2) == [3]
    assert sum(clusters.block_capacities(17, 12, 13, 12, 1)) == 17
    assert clusters.size_histogram(none, "y").collect() == []


def test_balance(spark):
    assert sorted(map(len, balance.balanced([5, 0, 0], 3))) == [1, 1, 1]
    assert sorted(i for p in balance.balanced([0] * 7, 3) for i in p) == list(range(7))
    rows = [(0, i, n) for i, n in enumerate([5, None, 0, 7, 1])] + [(1, 9, 3)]
    df = spark.createDataFrame(rows, "batch long, id long, n long")
    got = balance.balance(df, "batch", "id", "n", 3).collect()
    assert len(got) == 6
    assert {r.part for r in got if r.batch == 0} == {0, 1, 2}
    assert balance.balance(df.limit(0), "batch", "id", "n", 3).collect() == []
    assert balance.micro_batches(df.limit(0), "batch", "id", "n", 10).collect() == []
    first = balance.imbalance(df.withColumn("even", F.col("id") % 2), "batch", "n", "even").first()
    assert (first["min"], first["max"], first.balanced_max) == (3, 13, 10)


def test_batches(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "row_id").withColumn("batch_", F.lit(1))
    some = batches.epoch_batches(df, 100, 2, 5)
    sizes = some.groupBy("epoch", "batch").count().collect()
    assert sum(r["count"] for r in sizes) == 2000
    assert len(sizes) == 20
    assert all(50 <= r["count"] <= 150 for r in sizes)
    at = fresh_folder(spark, "cursor")
    batches.Cursor(1, 4).save(spark, at)
    left = batches.Cursor.load(spark, at).rest(some)
    assert {(r.epoch, r.batch) for r in left.collect()} == {(1, b) for b in range(4, 10)}
    assert batches.epoch_batches(df.limit(0), 100, 2, 5).collect() == []
    assert batches.inverse_order([2, 0, 1]) == [1, 2, 0]
    assert batches.concat(df.limit(0), df).count() == 1000


def test_advantages(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("b", None), ("b", 5.0), ("b", 7.0)], "g string, s double")
    got = {(r.g, r.s): r.advantage for r in advantages.grpo(df, "g", "s").collect()}
    assert len(got) == 6
    assert got[None, 1.0] < 0 < got[None, 3.0]
    assert got["a", 2.0] is None
    assert got["b", None] is None
    assert advantages.rloo(df.limit(0), "g", "s").collect() == []
    masked = spark.createDataFrame([([1.0, 2.0, 9.0], [1, 1, 0]), ([], [])], "v array<double>, m array<int>")
    w = [r.w for r in advantages.masked_whitened(masked, "v", "m", "w").collect()]
    assert w[0][:2] == pytest.approx([-0.7071068, 0.7071068], abs=1e-6)
    assert w[1] == []


def test_groups_of_a_hot_key_are_spread(spark):
    """Nine of ten rows share one group: no task of the join has a third of them."""
    df = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 10 < 9, F.lit(0)).otherwise(F.col("id")).alias("g"), (F.col("id") % 3).cast("double").alias("s"), F.repeat(F.lit("x"), 60).alias("t"))
    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for out in (advantages.grpo(df, "g", "s"), advantages.informative_groups(df, "g", "s", -1, 9)):
            sizes = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
            assert sum(sizes) == 40_000
            assert max(sizes) < 40_000 / 3
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_evaluation_and_ratings(spark):
    df = spark.createDataFrame([("a", "x", "x"), ("a", None, "x"), (None, "y", "x")], "k string, p string, t string")
    assert evaluation.exact_match(df.limit(0), "p", "t").first()[0] is None
    assert evaluation.micro_accuracy(df.withColumn("c", F.coalesce(F.col("p") == F.col("t"), F.lit(False))), "c", "k").count() == 3
    assert ratings.score_counts(df, "p").count() == 3
    assert ratings.rate(df.limit(0).withColumn("output", F.lit("x")), str).collect() == []


def test_raters_have_a_time_limit(spark):
    def slow(prompt):
        import time

        if "slow" in prompt:
            time.sleep(5)
        return '{"Rarity": 1, "Complexity": 1, "Informativeness": 1, "Overall rating": 9}'

    df = spark.createDataFrame([(1, "slow"), (2, "quick"), (3, " "), (4, None)], "n int, output string")
    got = {r.n: (r.raw_reply == "exception", r.rating_detail.Overall) for r in ratings.rate(df, slow, timeout=0.5, retries=1).collect()}
    assert got == {1: (True, 0), 2: (False, 9)}


def test_centrality(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8)], "a long, b long, similarity double")
    got = {r.id: r.score for r in centrality.lexrank(pairs, spark.range(6), damping=0.85).collect()}
    assert set(got) == set(range(6))
    assert got[0] == got[5] == pytest.approx(1.0)
    assert sum(got.values()) == pytest.approx(6, abs=1e-4)
    with pytest.raises(RuntimeError):
        centrality.lexrank(pairs, max_rounds=1)


def test_prompts_and_embeddings(spark):
    df = spark.createDataFrame([(1, "a b c d", 5), (2, "a", 5), (3, None, 5)], "n int, text string, embedding_ int")
    cut = prompts.cut_to_tokens(df, "text", lambda t: t.split(" "), " ".join, 2)
    assert {r.n: r.text for r in cut.collect()} == {1: "a b", 2: "a", 3: None}
    got = {r.n: r.embedding for r in embedding.embed(df, "text", lambda: embedding.hashed_words(8), batch=2).collect()}
    assert np.allclose(np.linalg.norm(got[1]), 1)
    assert got[3] == [0.0] * 8
    assert embedding.embed(df.limit(0), "text", embedding.hashed_words).collect() == []


def test_leaders_without_pairs(spark, vecs):
    pairs = spark.createDataFrame([], "a long, b long")
    assert dedup.leaders(vecs.filter("id IS NOT NULL"), "id", pairs).count() == 17


def test_copies_go_with_their_first(spark):
    rows = [(i, [1.0, 0.0]) for i in range(5, 60)] + [(1, [0.99, 0.05]), (70, [0.0, 1.0]), (71, None), (72, [0.0, 0.0]), (73, [0.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    assert sorted((r.id for r in dedup.leader_dedup(df, "id", "v", 0.9).collect()), key=str) == [1, 70, 71, 72, 73, None]
    assert dedup.leader_dedup(df.limit(0), "id", "v", 0.9).collect() == []


def test_settings(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"a": {"b": 1, "c": [1]}, "root": "/data"}))
    (tmp_path / "run.json").write_text(json.dumps({"_base_": str(tmp_path / "base.json"), "a": {"c": ["${a.b}"]}, "path": "${root}/x"}))
    found = settings.load(str(tmp_path / "run.json"), {"a.d.e": 2.5})
    assert found == {"a": {"b": 1, "c": [1], "d": {"e": 2.5}}, "root": "/data", "path": "/data/x"}
    assert settings.named("curlew.settings.load") is settings.load


def test_every_query_is_registered_once():
    assert len(_QUERIES) == len(set(_QUERIES))
