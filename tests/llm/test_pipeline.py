import random

import corpus_pipeline
import pytest

from curlew.llm.shared import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], folder), name))
    return out


def test_stages_keep_the_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "simhash", "suffix", "packing"]
    assert all(s.columns == COLUMNS for s in stages[:-1])


def test_stages_take_effect(stages):
    docs, quality, clean, single, cut, packed = stages
    n = [s.count() for s in stages[:-1]]
    assert n[0] > n[1] > n[2] > n[3] == n[4]
    assert single.select("text").distinct().count() == n[3]
    before = {r.doc_id: r.text for r in single.collect()}
    after = {r.doc_id: r for r in cut.collect()}
    assert before.keys() == after.keys()
    assert any(len(after[i].text) < len(t) for i, t in before.items())
    assert all(len(r.text) == r.n_chars for r in after.values())
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(after)
    labels = {r.doc_id: r for r in docs.sparkSession.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = {r.doc_id for r in clean.collect()}
    good = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(i in kept for i in good) / len(good) > 0.97
    bad = [i for i, r in labels.items() if r.quality == 0]
    assert sum(i in kept for i in bad) / len(bad) < 0.1


def test_run_equals_the_stages(spark, stages):
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, "/root/testdata/sf0.01")) == key(stages[-1])


@pytest.mark.parametrize("place", range(5))
def test_stages_take_odd_and_empty_tables(spark, edge, empty, place, tmp_path):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 10)], "doc_id long, quality int, toxic int")
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    _, stage = corpus_pipeline.STAGES[place]
    odd = edge.select(COLUMNS)
    rows = stage(spark, odd, folder).collect()
    if place < 4:
        assert {r.doc_id for r in rows} <= set(range(1, 10))
        assert stage(spark, odd, folder).columns == COLUMNS
    else:
        assert len({r.doc_id for r in rows}) == 9
    assert stage(spark, empty, folder).collect() == []


def edited_pairs(spark, edits, pairs=100):
    """Texts of 400 random words with odd ids, and copies with ``edits`` words changed far apart."""
    rng = random.Random(edits)
    rows = []
    for i in range(pairs):
        words = [f"w{rng.randrange(50_000)}" for _ in range(400)]
        copy = list(words)
        for k in range(edits):
            copy[400 // edits * k + 10] = f"new{rng.randrange(50_000)}"
        rows += [(2 * i + 1, " ".join(words), "en", "a", 0), (2 * i + 2, " ".join(copy), "en", "a", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


# Similarity of five-word shingles: (396 - 5 edits) / (396 + 5 edits).
@pytest.mark.parametrize(("edits", "least"), [(1, 0.98), (4, 0.95), (8, 0.9)])
def test_simhash_stage_finds_planted_edits(spark, edits, least):
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, edited_pairs(spark, edits), "").collect()}
    assert kept >= set(range(1, 200, 2))
    assert sum(i not in kept for i in range(2, 201, 2)) / 100 >= least
