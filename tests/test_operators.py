import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curlew.operators import advantages, balance, batches, bayes, centrality, clusters, dedup, diversity, evaluation, neighbours, noise, prompts, ratings, selection


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((60, 8))
    v[40:50] = v[:10] + 0.01 * rng.standard_normal((10, 8))
    rows = [(i, [float(x) for x in v[i]], int(i % 3)) for i in range(60)]
    return spark.createDataFrame(rows, "id long, v array<double>, y int").cache(), v


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("block", [7, 4096])
@pytest.mark.parametrize("metric", neighbours.METRICS)
def test_knn_is_exact(points, block, metric):
    df, v = points
    d = {"cosine": 1 - unit(v) @ unit(v).T, "euclidean": np.linalg.norm(v[:, None] - v[None], axis=2), "manhattan": np.abs(v[:, None] - v[None]).sum(2)}[metric].copy()
    np.fill_diagonal(d, np.inf)
    got = {(r.id, r.rank): (r.neighbour, r.distance) for r in neighbours.knn_edges(df, "id", "v", 4, metric, block=block).collect()}
    assert len(got) == 240
    for i in range(60):
        for rank, j in enumerate(np.argsort(d[i], kind="stable")[:4], 1):
            assert got[i, rank][0] == j
            assert got[i, rank][1] == pytest.approx(d[i, j])


@pytest.mark.parametrize("block", [16, 4096])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_distances_are_sums_in_order_and_ties_go_to_the_smaller_id(spark, block, kind):
    """As DuckDB adds them, to the last bit; many copies, zero vectors and one half as long."""
    rng = np.random.default_rng(5)
    v = rng.standard_normal((120, 24)).astype("f4" if kind == "float" else "f8").astype(float)
    v[rng.permutation(120)[:50]] = v[3]
    v[[7, 8, 90]] = 0
    v[60] = v[20] / 2
    total, size = np.zeros((120, 120)), np.zeros(120)
    for x in v.T:
        total += np.outer(x, x)
        size += x * x
    root = np.sqrt(np.outer(size, size))
    d = 1 - np.where(root > 0, np.clip(total / np.where(root > 0, root, 1), -1, 1), 0)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], f"id long, v array<{kind}>")
    for own in (True, False):
        got = neighbours.knn_edges(df, "id", "v", 5, include_self=own, block=block).collect()
        want = {(i, r): (int(j), d[i, j]) for i in range(120) for r, j in enumerate([j for j in np.lexsort((np.arange(120), d[i])) if own or j != i][:5], 1)}
        assert {(r.id, r.rank): (r.neighbour, r.distance) for r in got} == want
    pairs = {(r.a, r.b): r.similarity for r in neighbours.near_pairs(df, "id", "v", 0.3, block).collect()}
    assert pairs == {(i, j): 1 - d[i, j] for i in range(120) for j in range(i + 1, 120) if 1 - d[i, j] >= 0.3}


def test_near_ties_are_told_apart_in_double_precision(spark):
    v = np.ones((300, 8)) + np.random.default_rng(6).standard_normal((300, 8)) * 1e-7
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    d = np.stack([((v - x) ** 2).sum(1) - ((v - x).sum(1)) ** 2 / 8 for x in v])  # as the angle, for nearly equal vectors
    np.fill_diagonal(d, np.inf)
    got = {r.id: r.neighbour for r in neighbours.knn_edges(df, "id", "v", 1, "euclidean", block=64).collect()}
    e = np.stack([((v - x) ** 2).sum(1) for x in v])
    np.fill_diagonal(e, np.inf)
    assert got == dict(enumerate(e.argmin(1)))
    wide = {(r.id, r.neighbour) for r in neighbours.knn_edges(df, "id", "v", 40, block=64).collect()}
    assert np.mean([(i, j) in wide for i, j in enumerate(d.argmin(1))]) > 0.9


def test_tiles_are_dealt_out_evenly(points):
    chunks = neighbours.packed(points[0], 7)
    found = neighbours.tiles(chunks, chunks).groupBy(F.spark_partition_id().alias("p")).count().collect()
    n = chunks.count()
    assert sum(r["count"] for r in found) == n * n
    assert max(r["count"] for r in found) <= -(-n // 4)


def test_knn_edges_of_small_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    assert diversity.long_tail(df, "id", "v", 5).collect()[0].score == 0.0
    assert diversity.long_tail(df.filter("id > 1"), "id", "v", 5).collect() == []


@pytest.mark.parametrize("block", [9, 4096])
def test_leader_dedup(points, block):
    df, v = points
    s = unit(v) @ unit(v).T
    kept = []
    for i in range(60):
        if not any(s[i, j] >= 0.9 for j in kept):
            kept.append(i)
    pairs = neighbours.near_pairs(df, "id", "v", 0.9, block)
    assert sorted(r.id for r in dedup.leaders(df, "id", pairs).collect()) == kept
    assert len(kept) <= 50


@pytest.mark.parametrize("twice", [False, True])
@pytest.mark.parametrize("threshold", [0.3, 0.95])
def test_leader_dedup_in_rounds(spark, monkeypatch, twice, threshold):
    """Several rounds and pieces, with zero vectors, copies and (as pairs) an id of two rows; but for
    the latter, no pair is written."""
    monkeypatch.setattr(dedup, "PIECE", 16)
    monkeypatch.setattr(dedup, "ROUND", 64)
    if not twice:
        monkeypatch.setattr(dedup, "near_pairs", None)
    rng = np.random.default_rng(9)
    v = rng.standard_normal((400, 6))
    v[100:140] = v[:40] * 2
    v[rng.permutation(400)[:30]] = v[5]
    v[[50, 399]] = 0
    ids = rng.permutation(400)
    rows = [(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)]
    kept = []
    for j in np.argsort(ids):
        size = np.linalg.norm(v[j])
        if not size or not any(v[j] @ v[i] / (size * np.linalg.norm(v[i])) >= threshold - 1e-12 for i in kept if v[i].any()):
            kept.append(j)
    if twice:
        rows += [(500, [1.0] + [0.0] * 5), (500, [0.0] * 5 + [1.0])]
    df = spark.createDataFrame([*rows, (600, None)], "id long, v array<double>")
    got = sorted(r.id for r in dedup.leader_dedup(df, "id", "v", threshold).collect() if r.id != 500)
    assert got == sorted([*(int(ids[j]) for j in kept), 600])


def test_leaders_of_a_long_chain(spark):
    df = spark.range(1001)
    chain = df.filter("id < 1000").selectExpr("id AS a", "id + 1 AS b")
    assert [r.id for r in dedup.leaders(df, "id", chain).orderBy("id").collect()] == list(range(0, 1001, 2))


def test_leaders_follow_the_order(spark):
    df = spark.range(5)
    chain = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4)], "a long, b long")
    assert sorted(r.id for r in dedup.leaders(df, "id", chain).collect()) == [0, 2, 4]


def test_place_is_total(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("x"))
    got = {r.id: r.p for r in diversity.place(df, [F.desc("x"), F.asc("id")], "p").collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda kv: kv[1])] == sorted(range(100), key=lambda i: (-(i % 7), i))
    assert sorted(got.values()) == list(range(1, 101))


@pytest.mark.parametrize(("share", "kept"), [(0.5, [1, 2, 50]), (0.35, [1, 2, 35]), (0.07, [1, 1, 8])])
def test_stratified_top(spark, share, kept):
    rows = [(i, None if i < 1 else "b" if i < 4 else "c", i) for i in range(104)]
    df = spark.createDataFrame(rows, "id long, t string, s int")
    got = diversity.stratified_top(df, "t", "s", "id", share).collect()
    assert [sum(r.t == t for r in got) for t in (None, "b", "c")] == kept


def test_constant_scores_normalise_to_zero(spark):
    df = spark.range(3).select(F.lit(2.0).alias("s"))
    assert {r.n for r in diversity.min_max(df, "s", "n").collect()} == {0.0}


def test_consensus_solver_recovers_the_matrix():
    t = np.array([[0.8, 0.1, 0.1], [0.1, 0.7, 0.2], [0.05, 0.15, 0.8]])
    p = np.array([0.5, 0.3, 0.2])
    c1, c2, c3 = p @ t, np.einsum("y,yi,yj->ij", p, t, t), np.einsum("y,yi,yj,yk->ijk", p, t, t, t)
    found, prior = noise.solve_consensus(c1, c2, c3, steps=3000, rate=0.02)
    assert np.abs(found - t).max() < 0.03
    assert np.abs(prior - p).max() < 0.03


def test_transition_rows_sum_to_one(points):
    df, _ = points
    t = noise.transition_matrix(neighbours.knn_edges(df, "id", "v", 5), df.select("id", "y"), 4)
    assert {round(r.s, 9) for r in t.groupBy("i").agg(F.sum("prob").alias("s")).collect()} == {1.0}
    assert t.count() == 16


def test_vote(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "id long, y int")
    drawn = spark.createDataFrame([(1, 3), (2, 3)], "id long, times long")
    flags = spark.createDataFrame([(1, 2), (1, 2), (1, 0)], "id long, suggested int")
    got = {r.id: r for r in noise.vote(flags, drawn, labels, 3).collect()}
    assert (got[1].noisy_avg, got[1].noisy, got[1].suggested) == (0.8, True, 2)
    assert got[1].confidence == pytest.approx(0.5 * 0.8)
    assert (got[2].noisy, got[2].suggested) == (False, 0)


def test_detection_finds_planted_errors(spark):
    rng = np.random.default_rng(3)
    centres = np.eye(3, 8) * 5
    rows = []
    for i in range(150):
        y = i % 3
        rows.append((i, [float(x) for x in centres[y] + 0.3 * rng.standard_normal(8)], (y + 1) % 3 if i < 12 else y))
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    got = {r.id: r for r in noise.detect(df, "id", "v", "y", 3, epochs=3, method="majority").collect()}
    assert all(got[i].noisy and got[i].suggested == i % 3 for i in range(12) if i in got)
    assert not any(got[i].noisy for i in range(12, 150) if i in got)


@pytest.mark.parametrize(("share", "method"), [(0.9, "majority"), (0.2, "majority"), (0.6, "rank")])
def test_detection_equals_brute_force_on_every_row(spark, monkeypatch, share, method):
    rng = np.random.default_rng(4)
    n, k, epochs = 120, 5, 4
    y = rng.integers(0, 3, n)
    v = np.eye(3, 6)[y] * 3 + rng.standard_normal((n, 6))
    y[:15] = (y[:15] + 1) % 3
    monkeypatch.setattr(noise, "estimate_transition", lambda *a, **b: (np.eye(3) * 0.8, np.ones(3) / 3, np.ones(3) / 3))
    df = spark.createDataFrame([(i, v[i].tolist(), int(y[i])) for i in range(n)], "id long, v array<double>, y int")
    got = {r.id: r for r in noise.detect(df, "id", "v", "y", 3, epochs=epochs, k=k, share=share, method=method).collect()}
    assert sorted(got) == list(range(n))
    d = 1 - unit(v) @ unit(v).T
    times, flags = np.zeros(n, int), np.zeros((n, 3), int)
    for e in range(epochs):
        part = sorted(r.id for r in df.filter(F.pmod(F.xxhash64("id", F.lit(e)), F.lit(1000)) < int(1000 * share)).collect())
        x = np.zeros((n, 3))
        for i in part:
            near = sorted(part, key=lambda j: d[i, j])[:k]
            w = [1 - d[i, j] for j in near]
            w[0] = 1 - (2 * d[i, near[1]] - d[i, near[2]])
            np.add.at(x[i], y[near], w)
            x[i] = np.where(np.isin(np.arange(3), y[near]), x[i] / np.linalg.norm(x[i]), -np.inf)
        times[part] += 1
        score = -np.log(np.maximum(x[np.arange(n), y], 0) + 1e-8)
        for c in range(3):
            mine = [i for i in part if y[i] == c]
            cut = np.percentile(score[mine], 80)
            for i in mine:
                if (score[i] >= cut) if method == "rank" else (x[i].argmax() != c):
                    flags[i, x[i].argmax()] += 1
    average = (flags.sum(1) + 1) / (times + 2)
    assert [got[i].noisy_avg for i in range(n)] == pytest.approx(average.tolist())
    assert [got[i].noisy for i in range(n)] == (average > 0.5).tolist()
    conf = (flags + 1) / (flags.sum(1, keepdims=True) + 3)
    conf[np.arange(n), y] = -1
    assert [got[i].suggested for i in range(n)] == conf.argmax(1).tolist()


def test_synthetic_noise_follows_the_matrix(spark):
    t = np.array([[0.7, 0.3], [0.0, 1.0]])
    df = spark.range(4000).select("id", (F.col("id") % 2).cast("int").alias("y"))
    got = noise.synthetic_noise(df, "id", "y", t, 1).groupBy("y").agg(F.avg("noisy_label").alias("m")).collect()
    means = {r.y: r.m for r in got}
    assert abs(means[0] - 0.3) < 0.04
    assert means[1] == 1.0


def test_library_round_trip(points, spark, tmp_path):
    df, _ = points
    library = bayes.build_library(df, "id", "v", "y", 3, k=3)
    bayes.write_library(library, "qa", str(tmp_path))
    again = bayes.read_library(spark, str(tmp_path), "qa")
    queries = df.select("id", "v")
    a = {r.q: round(r.expected, 9) for r in bayes.score_queries(queries, library, 5).collect()}
    assert a == {r.q: round(r.expected, 9) for r in bayes.score_queries(queries, again, 5).collect()}
    assert len(a) == 60
    assert [r["class"] for r in bayes.class_index(df, "y").orderBy("value").collect()] == [0, 1, 2]


@pytest.mark.parametrize("n", [10, 57, 500])
def test_capacities(n):
    sizes = clusters.sample_capacities(n, 3, 9, 6, 2, seed=n)
    assert sum(sizes) == n
    assert min(sizes) >= 3
    assert max(sizes) <= 9


def test_impossible_capacities():
    with pytest.raises(ValueError, match="cannot be split"):
        clusters.sample_capacities(1, 2, 9, 6, 2)
    assert clusters.sample_capacities(0, 2, 9, 6, 2) == []


def test_capacity_clusters(points):
    df, _ = points
    got = clusters.capacity_clusters(df.withColumn("b", F.lit("x")), "id", "v", "b", 5, 12, 8, 2).collect()
    sizes = np.bincount([r.cluster for r in got])
    assert len(got) == 60
    assert sorted(sizes.tolist()) == sorted(clusters.sample_capacities(60, 5, 12, 8, 2))
    centre = clusters.centres(df, "v", 3)
    assert np.allclose(np.linalg.norm(centre, axis=1), 1)
    assert clusters.similarities(df, "id", "v", centre, 2).count() == 120


def test_merge_groups(spark):
    rows = [(1, 0, "p", "a", "d1"), (0, 0, "q", "b", "d0"), (2, None, "x", "y", "d2")]
    df = spark.createDataFrame(rows, "id long, c int, p string, a string, d string")
    got = clusters.merge_groups(df, "c", "id", "p", "a", "d", separator="|").collect()
    assert [(r.dataset, r.input) for r in got] == [("d0", "Q: q\n A: b|Q: p\n A: a")]


def test_tiers(spark):
    rows = list(zip(range(6), [5, 5, 4, 4, 4, 3], [0.1, 0.2, 0.9, 0.5, 0.7, 0.3], strict=True))
    df = spark.createDataFrame(rows, "id long, s int, r double")
    assert sorted(r.id for r in selection.tiered(df, "s", "r", "id", 4).collect()) == [0, 1, 2, 4]


def test_selection(spark):
    df = spark.createDataFrame([(0, "1.5"), (1, "x"), (2, "7"), (3, None)], "id long, n string")
    assert [r.id for r in selection.top_by(df, "n", "id", 3).collect()] == [2, 0, 1]
    assert [r.id for r in selection.low_quality(df, "n", 8).collect()] == [2]
    done = spark.createDataFrame([(0,)], "id long")
    assert sorted(r.id for r in selection.pending(df, done, "id").collect()) == [1, 2, 3]
    gaps = spark.createDataFrame([(0, 5), (1, None)], "row_id long, id long")
    assert [r.row_id for r in selection.pending(gaps, done, "id").collect()] == [1]
    assert selection.same_keys(df, df, "id")
    assert not selection.same_keys(df, done, "id")
    assert selection.sample_per(df.withColumn("g", F.lit(1)), "g", "id", 2).count() == 2
    assert selection.from_sources(df.withColumn("s", F.lit("Web")), "s", ["web "]).count() == 4


def test_advantages(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 3.0)], "uid string, s double")
    got = sorted((r.uid, r.advantage) for r in advantages.grpo(df.filter("uid = 'a'"), "uid", "s").collect())
    assert [x for _, x in got] == pytest.approx([-0.7071058, 0.7071058], abs=1e-6)
    assert sorted(r.advantage for r in advantages.rloo(df.filter("uid = 'a'"), "uid", "s").collect()) == [-1.0, 1.0]
    assert advantages.rloo(df.filter("uid = 'b'"), "uid", "s").first().advantage is None
    with pytest.raises(ValueError, match="fewer than two"):
        advantages.grpo(df, "uid", "s", strict=True)
    assert [r.uid for r in advantages.informative_groups(df, "uid", "s", 1, 5).collect()] == ["b"]
    k = advantages.KlController(0.1, target=0.1, horizon=100)
    assert k.update(1.0, 10) == pytest.approx(0.1 * 1.02)
    assert advantages.KlController(0.2).update(5.0, 10) == 0.2


def test_losses_and_metrics(spark):
    df = spark.createDataFrame([([1.0, 3.0], [1, 1]), ([5.0, 9.0], [1, 0])], "l array<double>, m array<int>")
    assert advantages.mean_loss(df, "l", "m").first().loss == pytest.approx(3.0)
    assert advantages.mean_loss(df, "l", "m", by="sequence").first().loss == pytest.approx(3.5)
    n = spark.createDataFrame([(10,), (20,)], "n int")
    assert advantages.flops_estimate(n, "n", 1.0, 1, 1).first().flops == 6 * 30 + 12 * 500
    v = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "r double, v double")
    assert advantages.explained_variance(v, "r", "v").first().explained_variance == 1.0


def test_batch_algebra(spark):
    df = spark.createDataFrame(list(zip(range(6), range(1, 7), "abcdef", strict=True)), "row_id long, obs long, label string")
    with pytest.raises(ValueError, match="equal parts"):
        batches.chunk(df, 5)
    parts = batches.chunk(df, 2)
    assert [r.obs for r in parts.filter("part = 0").orderBy("row_id").collect()] == [1, 2, 3]
    assert [r.label for r in batches.reorder(df, [3, 4, 2, 0, 1, 5]).orderBy("row_id").collect()] == list("decabf")
    two = df.filter("row_id < 2")
    assert [r.obs for r in batches.repeat(two, 2).orderBy("row_id").collect()] == [1, 1, 2, 2]
    assert [r.obs for r in batches.repeat(two, 2, interleave=False).orderBy("row_id").collect()] == [1, 2, 1, 2]
    three = df.filter("row_id < 3")
    padded = batches.pad_to(three, 2)
    assert [r.obs for r in padded.orderBy("row_id").collect()] == [1, 2, 3, 1]
    assert batches.unpad(padded).count() == 3
    assert batches.pad_to(three, 3).count() == 3
    assert [r.obs for r in batches.pad_to(two, 5).orderBy("row_id").collect()] == [1, 2, 1, 2, 1]
    back = batches.concat(df.filter("row_id < 3"), df.filter("row_id >= 3").withColumn("row_id", F.col("row_id") - 3))
    assert [r.obs for r in back.orderBy("row_id").collect()] == [1, 2, 3, 4, 5, 6]
    other = df.select("row_id", "obs", F.lit(1).alias("act"))
    assert set(batches.union_columns(df, other).columns) == {"row_id", "obs", "label", "act"}
    with pytest.raises(ValueError, match="disagree"):
        batches.union_columns(df, other.withColumn("obs", F.col("obs") + 1))
    assert batches.select(df, ["obs", "nothing"]).columns == ["obs"]
    assert batches.batch_ids(df, 4, drop_last=True).count() == 4
    assert [r.obs for r in batches.collate(batches.batch_ids(df, 4), "batch", "obs").orderBy("batch").collect()] == [[1, 2, 3, 4], [5, 6]]
    steps = spark.createDataFrame([(s,) for s in (5, 10, 15, 20, 25)], "step long")
    assert sorted(r.step for r in batches.retained_checkpoints(steps, "step", 2, best=10).collect()) == [10, 25]


@pytest.mark.parametrize("equal", [False, True])
def test_partitions(equal):
    rng = random.Random(4)
    for _ in range(30):
        k = rng.randint(1, 5)
        n = [rng.randint(1, 100) for _ in range(k * rng.randint(1, 6))]
        for f in (balance.balanced, balance.greedy):
            parts = f(n, k, equal)
            assert sorted(itertools.chain(*parts)) == list(range(len(n)))
            if equal:
                assert {len(p) for p in parts} == {len(n) // k}
    n = [8, 7, 6, 5, 4]
    assert sorted(sum(n[i] for i in p) for p in balance.differencing(n, 2)) == [14, 16]


def test_micro_batches(spark):
    df = spark.range(20).select(F.lit(0).alias("b"), "id", (F.col("id") * 7 % 50 + 10).alias("n"))
    got = balance.micro_batches(df, "b", "id", "n", 200).join(df, "id").groupBy("part").agg(F.sum(F.col("n") ** 2).alias("s")).orderBy("part").collect()
    total = sum(r["n"] for r in df.collect())
    assert len(got) == -(-total // 200)
    assert [r.s for r in got] == sorted((r.s for r in got), reverse=True)


def test_rate(spark):
    df = spark.createDataFrame([("qa-1", "text", None), ("x", " ", "later"), ("y", None, None)], "id string, output string, other string")

    def rater(prompt):
        if "later" in prompt:
            raise RuntimeError("no answer")
        return '{"Rarity": 1, "Complexity": 2, "Informativeness": 3, "Overall rating": 9}'

    got = {r.id: r for r in ratings.rate(df, rater, "output", ("other",)).collect()}
    assert set(got) == {"qa-1", "x"}
    assert (got["qa-1"].rating_detail.Overall, got["qa-1"].rating_detail.Overall_compressed) == (9, 5)
    assert got["x"].raw_reply == "exception"
    assert got["x"].rating_detail.Overall == 0


def test_evaluation(spark):
    df = spark.createDataFrame([("A red cat", ["the red cat", "x"]), ("dog", ["cat"]), ("", [""])], "p string, t array<string>")
    got = [(r.f1, r.exact, r.recall) for r in evaluation.best_f1(df, "p", "t").collect()]
    assert got == [(100.0, 100.0, 0.0), (0.0, 0.0, 0.0), (100.0, 100.0, 100.0)]
    row = spark.createDataFrame([("a b b", "b b c")], "p string, t string").select(evaluation.token_f1("p", "t").alias("f")).first()
    assert row.f == pytest.approx(0.8)
    em = spark.createDataFrame([("3.5", "35"), ("x", "y")], "p string, t string")
    assert evaluation.exact_match(em, "p", "t").first().exact_match == 0.5
    top = spark.createDataFrame([([1, 2, 3], 2), ([3, 2, 1], 3)], "r array<int>, y int")
    assert tuple(evaluation.top_k_accuracy(top, "r", "y", 1, 2).first()) == (0.5, 1.0)
    lp = spark.createDataFrame([("p", "a", -1.0), ("p", "a", -2.0), ("p", "b", -5.0)], "p string, c string, l double")
    assert evaluation.completion_scores(lp, "p", "c", "l").first().scores == {"a": -3.0, "b": -5.0}
    j = spark.createDataFrame([("m", 0.9, 0.1), ("m", 0.8, 0.7)], "model string, a double, b double")
    assert tuple(evaluation.joint_accuracy(j, "model", "a", "b").first())[1:] == (1.0, 0.5, 0.5)


def test_place_within_groups(spark):
    rows = [(i, None if i % 5 == 0 else "b" if i % 3 else "c", i % 4) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, g string, x int")
    got = {r.id: r.p for r in diversity.place(df, [F.desc("x"), F.asc("id")], "p", within="g").collect()}
    for g in (None, "b", "c"):
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        assert [got[r[0]] for r in mine] == list(range(1, len(mine) + 1))


def test_prompts(spark):
    demos = "Q: a\nA: Let's think step by step. x. So the answer is 1.\n\nQ: b\nA: 2"
    got = spark.createDataFrame([(demos,)], "d string").select(prompts.without_reasoning(F.col("d")).alias("x")).first().x
    assert got == "Q: a\nA: 1.\n\nQ: b\nA: 2"
    ex = spark.createDataFrame([("s", 2, "two "), ("s", 1, "one "), ("s", 3, "three ")], "subject string, id int, t string")
    shots = prompts.demonstrations(ex, "subject", "id", F.col("t"), 2)
    q = spark.createDataFrame([("s", "q1"), ("z", "q2")], "subject string, q string")
    assert sorted(r.prompt for r in prompts.few_shot(q, shots, "subject", F.col("q"), "> ").collect()) == ["> one two q1", "> q2"]
    words = spark.createDataFrame([("s", "hello")], "lang string, hi string")
    assert prompts.by_language(q.withColumnRenamed("subject", "lang"), words).filter("hi IS NOT NULL").count() == 1


def test_lexrank(spark):
    star = spark.createDataFrame([(0, i, 0.5) for i in range(1, 6)], "a long, b long, similarity double")
    got = {r.id: r.score for r in centrality.lexrank(star).collect()}
    w = np.eye(6)
    w[0, 1:] = w[1:, 0] = 0.5
    p = w / w.sum(1, keepdims=True)
    x = np.ones(6)
    for _ in range(500):
        x = x @ p
    assert [got[i] for i in range(6)] == pytest.approx(x.tolist(), abs=1e-3)


def test_lexrank_of_vectors(spark, monkeypatch):
    """Equals that over pairs; links in several rows and chunks, zero vectors, a row without a vector,
    and an id of two rows."""
    monkeypatch.setattr(centrality, "LINKS", 50)
    v = np.random.default_rng(2).standard_normal((90, 5))
    v[[4, 70]] = 0
    df = spark.createDataFrame([*((i, x.tolist()) for i, x in enumerate(v)), (200, None), (None, [1.0] * 5)], "id long, v array<double>")
    for rows in (df, df.unionByName(df.filter("id = 7").selectExpr("id", "transform(v, x -> x + 0.5D) AS v"))):
        want = {r.id: r.score for r in centrality.lexrank(neighbours.near_pairs(rows, "id", "v", 0.4), rows.select("id").filter("id IS NOT NULL"), 0.4, 1e-4).collect()}
        with monkeypatch.context() as m:
            if rows is df:
                m.setattr(centrality, "lexrank", None)
                m.setattr(centrality, "near_pairs", None)
            got = {r.id: r.score for r in centrality.lexrank_of_vectors(rows, "id", "v", 0.4, 0.4, 1e-4, block=40).collect()}
        assert got == pytest.approx(want, abs=1e-3)
    with pytest.raises(RuntimeError):
        centrality.lexrank_of_vectors(df, "id", "v", 0.4, 0.4, 1e-5, max_rounds=1)


def test_clusters_hold_few_similarities_at_a_time(monkeypatch):
    """The same clusters as over the whole matrix, whose rows and columns both grow with the block."""
    monkeypatch.setattr(clusters, "SIMILARITIES", 60)
    rng = np.random.default_rng(4)
    s, ids, sizes, seen = rng.integers(0, 6, (100, 12)).astype(float), rng.permutation(100), [9] * 8 + [7] * 4, []
    room, want = sizes.copy(), np.full(100, -1)
    for i in np.lexsort((ids, -s.max(1))):
        want[i] = next(c for c in np.argsort(-s[i], kind="stable") if room[c])
        room[want[i]] -= 1

    def similar(at):
        seen.append(s[at].size)
        return s[at]

    assert clusters.constrained_assign(ids, similar, sizes).tolist() == want.tolist()
    assert max(seen) <= 60
