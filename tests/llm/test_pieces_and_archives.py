import hashlib
import random

import pyarrow as pa
import pytest
import sentencepiece

from curlew.llm import piece_bpe, warc
from curlew.llm.shared import fresh_path


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_path())


PARTS = ["a", "b", "lo", " ", "  ", "\n", "\t", "日本", "🙂", chr(0x301), "\r\n", ".", ", ", "in", "ing", chr(0x200B), "Haus"]


def test_without_dropout_ids_are_the_librarys(library, texts):
    bpe = piece_bpe.PieceBpe(piece_bpe.default_path())
    rng = random.Random(2)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9))) for _ in range(5000)]
    for t in [*made, *list(texts.values())[:80]]:
        assert bpe.encode(t).tolist() == library.encode(t), repr(t)


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_decoding_is_lossless(dropout, texts, library):
    bpe = piece_bpe.PieceBpe(piece_bpe.default_path(), dropout, seed=3)
    rng = random.Random(3)
    made = ["".join(rng.choice([*PARTS, piece_bpe.SPACE]) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    for i, t in enumerate([*made, *list(texts.values())[:40]]):
        ids = bpe.encode(t, i)
        assert bpe.decode(ids) == t
        if piece_bpe.SPACE not in t:
            assert library.decode(ids.tolist()) == t


def brute_force(bpe, text, key):
    """One agenda for each segment, with a draw for each candidate from its own hash."""
    base = int.from_bytes(hashlib.blake2b(f"{bpe.seed}:{key}".encode(), digest_size=8).digest(), "little")
    mask, out = (1 << 64) - 1, []

    def mixed(h):
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & mask
        return h ^ (h >> 31)

    for place, segment in enumerate(bpe._split(pa.array([text]))[0].as_py()):
        if segment is None:
            out += [bpe.byte[b] for b in piece_bpe.SPACE.encode()]
            continue
        own, parts, draws = mixed((base + place * 0xD1342543DE82EF95) & mask), list(segment), 0
        passed = [False] * len(parts)  # the candidate of this part and the next was skipped
        while True:
            open_ = [(bpe.cost[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if not passed[i] and parts[i] + parts[i + 1] in bpe.cost]
            if not open_:
                break
            i = min(open_)[1]
            draws += 1
            if (mixed((own + draws * 0x9E3779B97F4A7C15) & mask) >> 11) * 2.0**-53 < bpe.dropout:
                passed[i] = True
                continue
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del passed[i + 1]
            passed[i] = False
            if i:
                passed[i - 1] = False
        for p in parts:
            out += [bpe.ids[p]] if p in bpe.ids else [bpe.byte[b] for b in p.encode()]
    return out


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_equals_brute_force(dropout, texts):
    bpe = piece_bpe.PieceBpe(piece_bpe.default_path(), dropout, seed=5)
    rng = random.Random(6)
    made = ["".join(rng.choice([*PARTS, piece_bpe.SPACE]) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    made += [t for t in texts.values() if len(t) < 20_000][:60] + ["lo" * 90, "ab" * 24, "x" * 500]
    for i, t in enumerate(made):
        assert bpe.encode(t, i).tolist() == brute_force(bpe, t, i), repr(t)


def test_batches_equal_single_texts(texts):
    bpe = piece_bpe.PieceBpe(piece_bpe.default_path(), 0.2, 1)
    some = [*list(texts.values())[:40], None, ""]
    for part in (some, some[:40], some[40:], []):
        ids, at = bpe.encode_batch(pa.array(part, pa.string()), list(range(len(part))))
        for i, t in enumerate(part):
            assert ids[at[i] : at[i + 1]].tolist() == bpe.encode(t, i).tolist()


def test_dropout_varies_by_key_and_seed(texts):
    text = max(texts.values(), key=len)
    plain = piece_bpe.PieceBpe(piece_bpe.default_path()).encode(text)
    made = lambda seed: piece_bpe.PieceBpe(piece_bpe.default_path(), 0.2, seed)
    a = made(1).encode(text, 7).tolist()
    assert a == made(1).encode(text, 7).tolist()
    assert a != made(1).encode(text, 8).tolist()
    assert a != made(2).encode(text, 7).tolist()
    assert len(a) > len(plain)


def test_each_occurrence_has_its_own_draws():
    word = "internationalisation"
    bpe = piece_bpe.PieceBpe(piece_bpe.default_path(), 0.1, 1)
    seen = [bpe.encode(word, i).tobytes() for i in range(4000)]
    plain = piece_bpe.PieceBpe(piece_bpe.default_path()).encode(word).tobytes()
    n = 1 + len(word) - len(piece_bpe.PieceBpe(piece_bpe.default_path()).encode(word))
    assert len(set(seen)) > 8
    assert seen.count(plain) / 4000 >= 0.9**n - 0.03
    once = piece_bpe.PieceBpe(piece_bpe.default_path(), 0.1, 1)
    pair = next(m for m in sorted(once.cost) if len(m) == 2 and m[0] == piece_bpe.SPACE and m[1].isalpha())
    kept = [len(once.encode(pair[1], i)) == 1 for i in range(4000)]
    assert abs(sum(kept) / 4000 - 0.9) < 0.02


def test_encoded_table(spark, edge, empty):
    rows = piece_bpe.decode(piece_bpe.encode(edge, dropout=0.3)).collect()
    truth = sorted((r.doc_id, r.text or "") for r in edge.select("doc_id", "text").collect())
    assert sorted((r.doc_id, r.text) for r in rows) == truth
    assert all(r.n_tokens == 0 for r in rows if not r.text)
    assert piece_bpe.decode(piece_bpe.encode(empty)).collect() == []


def pages_truth(rows, least=1000):
    keep = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= least and i is not None:
            keep[p] = max(keep.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        to = keep.get(p) if len(p) >= least else None
        to = None if to == i else to
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


def test_archives(spark):
    big, other = "<p>ä</p>" * 200, "<b>x</b>" * 500
    rows = [(1, "u", big), (2, "u\r\nv", big), (3, None, big), (4, "u", other), (5, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", other), (9, "u", "x" * 999), (10, "u", "x" * 999)]
    rows += [(100 + i, f"http://h/{i}", f"<html><body>page {i} " + "text " * i + "</body></html>") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS key", "2 AS keeper")
    folder = fresh_path(spark, "warc")
    assert warc.write_archives(df, folder) >= 1
    got = sorted((tuple(r) for r in warc.read_archives(spark, folder).collect()), key=str)
    assert got == pages_truth(rows)


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_archives(df, fresh_path(spark, "warc")) == 0


def test_archive_layout():
    rng = random.Random(4)
    records = [warc.record(i, f"http://h/{i}", (f"<p>{rng.random()}</p>" + "common words of every page " * 30).encode()) for i in range(200)]
    data = warc.archive(records)
    magic, size = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
    assert magic == warc.DICTIONARY_MAGIC
    assert data[8 : 8 + size] == warc.build_dictionary(records)
    assert size > 0
    import zstandard

    kept = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    first = zstandard.ZstdDecompressor(dict_data=kept).decompressobj().decompress(data[8 + size :])
    assert first == records[0]  # a frame of its own
    assert len(list(warc.read_archive(data))) == 200
    bad = records[0].replace(b"common", b"uncommon"[:6], 1)
    with pytest.raises(ValueError, match="differs from its digest"):
        warc.page_of(*next(iter(warc.read_archive(warc.archive([bad])))))


@pytest.mark.parametrize("text", ["'short'", "repeat('a popular page ', 100)"])
def test_popular_and_short_pages_are_spread(spark, text):
    """Nine of ten pages share one payload: no task has a third of the rows."""
    pages = spark.range(0, 20_000, 1, 8).selectExpr("id AS page_id", "'u' AS url", f"IF(id % 10 = 0, repeat(CAST(id AS STRING), 300), {text}) AS html")
    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sizes = [r[0] for r in warc.with_referral(pages).selectExpr("spark_partition_id() AS p", "refers").rdd.map(lambda r: (r.p, 1)).reduceByKey(lambda a, b: a + b).map(lambda x: (x[1],)).collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(sizes) == 20_000
    assert max(sizes) < 20_000 / 3
