import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from curlew.llm import components as cc
from curlew.llm import embeddings, ranks, simhash, sketch, suffix_dedup
from curlew.llm.shared import fresh_path


def find_components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("links", [[], [(0, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(3, 3), (5, 2), (2, 9), (8, 7)]])
@pytest.mark.parametrize("few", [0, 200_000])
def test_components(spark, links, few, monkeypatch):
    monkeypatch.setattr(cc, "FEW", few)
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in cc.components(df).collect()}
    brute = find_components(60, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: brute[i] for i in touched}


def brute_fingerprint(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("k", [1, 3, 5])
def test_fingerprints(texts, k):
    for t in [*list(texts.values())[:60], None, "", "A b", "a B c", "Ä\x0bB\x1cC d e f g"]:
        assert simhash.fingerprint(t, k) == (brute_fingerprint(t, k), len((t or "").encode().split()))


@pytest.mark.parametrize("sized", [False, True])
@pytest.mark.parametrize("bits", [0, 1, 3, 4, 7])
def test_near_pairs(spark, bits, sized):
    rng = random.Random(bits)
    found = {0, 1, (1 << 64) - 1}
    for _ in range(60):
        x = rng.getrandbits(64)
        found.add(x)
        for _ in range(4):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 10)):
                y ^= 1 << b
            found.add(y)
    rows = sorted({(x, rng.randint(-2, 3) if sized else 0) for x in [*found, *found]})
    signed = [(x - (1 << 64) if x >> 63 else x, s) for x, s in rows]
    df = spark.createDataFrame(signed, "fp long, size int")
    pairs = simhash.near_pairs(df if sized else df.drop("size"), bits).collect()
    got = [frozenset(((r.fp_a % (1 << 64), r.size_a), (r.fp_b % (1 << 64), r.size_b))) for r in pairs]
    assert len(got) == len(set(got))
    near = lambda a, b: (a[0] ^ b[0]).bit_count() <= bits and abs(a[1] - b[1]) <= 1
    assert set(got) == {frozenset((a, b)) for a in rows for b in rows if a < b and near(a, b)}


def brute_shingles(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


@pytest.mark.parametrize("k", [1, 3, 5])
def test_shingle_sets(texts, k):
    some = [*list(texts.values())[:40], None, "", "a", "A b", "a B c", "a b c d e a b c d e a b"]
    for t in some:
        assert len(simhash.shingle_set(t, k)) == len(brute_shingles(t, k))
    for t, u in zip(some, some[1:], strict=False):
        both = len(np.intersect1d(simhash.shingle_set(t, k), simhash.shingle_set(u, k)))
        assert both == len(brute_shingles(t, k) & brute_shingles(u, k))


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_similar_groups_against_brute_force(spark):
    """Links are exactly the verified ones, and hardly any pair of that similarity is missed."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets = [brute_shingles(r.text, 5) for r in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and jaccard(sets[a], sets[b]) >= 0.8]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows)).collect()}
    place = {r.doc_id: i for i, r in enumerate(rows)}
    brute = find_components(len(rows), near)
    assert all(brute[place[i]] == brute[place[c]] for i, c in got.items())  # nothing else is linked
    met = sum(got[rows[a].doc_id] == got[rows[b].doc_id] for a, b in near)
    assert met >= 0.9 * len(near)


def test_repeated_bodies_are_grouped(spark):
    rng = random.Random(3)
    rows = []
    for i in range(0, 40, 2):
        body = " ".join(f"w{rng.randrange(50_000)}" for _ in range(1_000))
        rows += [(i, body), (i + 1, "\n".join([body] * 3))]
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(0, 40, 2))


@pytest.mark.parametrize("bits", [2, 3, 7])
def test_pairs_across_groups(spark, bits):
    rng = random.Random(bits)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(8):
            y = x
            for b in rng.sample(range(64), rng.randint(0, 9)):
                y ^= 1 << b
            prints.add(y)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, rng.randint(0, 30), rng.randint(1, 4), fp, [rng.getrandbits(64) & rng.getrandbits(64) for _ in range(8)]) for i, fp in enumerate(sorted(prints))]
    df = spark.createDataFrame([(i, o, s, signed(fp), *map(signed, p)) for i, o, s, fp, p in rows], "first long, own long, size int, fp long, " + ", ".join(f"{c} long" for c in simhash.SKETCHED))
    got = [(r.a, r.b) for r in simhash._across(df, bits, 190).collect()]
    far = lambda p, q: sum((x ^ y).bit_count() for x, y in zip(p, q, strict=True))
    near = lambda a, b: (a[3] ^ b[3]).bit_count() <= bits and abs(a[2] - b[2]) <= 1 and a[1] != b[1] and far(a[4], b[4]) <= 190
    assert len(got) == len(set(got))
    assert set(got) == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and near(a, b)}


def test_large_groups_of_near_copies(spark):
    """Each copy has edits of its own; all come together, and few pairs are compared."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.component_id == 0 for r in got) >= 396


def test_simhash_groups(spark, documents, texts):
    got = {r.doc_id: r.component_id for r in simhash.grouped(documents, 3).collect()}
    ids = sorted(texts)
    fps = [brute_fingerprint(texts[i], 3) for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    assert got == {ids[i]: ids[c] for i, c in enumerate(find_components(len(ids), links))}


def test_simhash_edges(spark, edge, empty):
    got = {r.doc_id: r.component_id for r in simhash.grouped(edge).collect()}
    assert got[1] == got[2] == 1
    assert got[3] == got[4] == got[9] == 3
    assert simhash.grouped(empty).collect() == []
    kept = simhash.deduplicate(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1, 3, 5, 6, 7, 8]
    assert simhash.deduplicate(empty).collect() == []
    lost = edge.selectExpr("CAST(NULL AS LONG) AS doc_id", "text")
    assert simhash.deduplicate(lost).count() == 10


def brute_removed(texts, length):
    data = {i: t.encode() for i, t in texts.items()}
    seen = Counter(d[s : s + length] for d in data.values() for s in range(len(d) - length + 1))
    out = {}
    for i, d in data.items():
        covered = np.zeros(len(d) + 1, int)
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                covered[s] += 1
                covered[s + length] -= 1
        gone = np.cumsum(covered)[:-1] > 0
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        starts = np.diff(np.concatenate(([0], gone.astype(int)))) == 1
        out[i] = (len(d), int(gone.sum()), int(starts.sum()), hashlib.sha256(kept).hexdigest())
    return out


def removed(df, length=200):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed_spans(df, length).collect()}


def test_repeats_of_documents(documents, texts):
    assert removed(documents) == brute_removed(texts, 200)


@pytest.mark.parametrize("seed", range(2))
def test_repeats_of_cut_and_edited_texts(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(150, 900))) for _ in range(12)]
    texts = {}
    for i in range(60):
        t = rng.choice(base)
        kind = rng.randint(0, 5)
        if kind == 0:
            a = rng.randint(0, len(t))
            t = t[a:] + rng.choice(base)[: rng.randint(0, 400)]
        elif kind == 1:
            for _ in range(rng.randint(1, 4)):
                a = rng.randint(0, len(t))
                t = t[:a] + rng.choice("xyz") + t[a + rng.randint(0, 2) :]
        elif kind == 2:
            t = "ab" * rng.randint(50, 300) + t
        elif kind == 3:
            t = (t[:70] + "\n") * rng.randint(1, 12)
        elif kind == 4:
            t = "q" * rng.randint(150, 800)
        texts[i] = t
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert removed(df) == brute_removed(texts, 200)


def test_segments_do_not_change_the_result(spark, monkeypatch):
    rng = random.Random(9)
    passage = "".join(rng.choice("abc") for _ in range(700))
    texts = {i: "".join(rng.choice("abc") for _ in range(rng.randint(0, 3000))) + passage + "".join(rng.choice("abc") for _ in range(500)) for i in range(6)}
    whole = [[x.tolist() for x in p] for p in suffix_dedup.spans(texts[0].encode())]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 257)
    pieces = list(suffix_dedup.spans(texts[0].encode()))
    starts = sorted(s for p in pieces for a, m in zip(p[2].tolist(), p[3].tolist(), strict=True) for s in range(a, a + m + 1))
    assert starts == list(range(len(texts[0]) - 199))
    assert len(whole) == 1
    monkeypatch.undo()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert removed(df) == brute_removed(texts, 200)


def test_suffix_edges(spark, edge, empty):
    rows = suffix_dedup.removed_spans(edge).collect()
    assert len(rows) == 10
    assert all(r.n_removed == (r.n_bytes if r.doc_id in (6, 7) else 0) for r in rows)
    assert suffix_dedup.removed_spans(empty).collect() == []
    cut = suffix_dedup.remove_repeats(edge)
    assert cut.columns == edge.columns
    assert {r.doc_id: r.text for r in cut.collect()}[6] == ""
    clash = edge.selectExpr("*", "1 AS _run_id", "2 AS _runs", "3 AS runs", "4 AS id_", "5 AS row")
    assert suffix_dedup.remove_repeats(clash).columns == clash.columns
    assert suffix_dedup.remove_repeats(clash).count() == 10
    twice = spark.createDataFrame([(1, "a" * 10 + "é" * 300), (1, "b" * 10 + "é" * 300), (None, None)], "doc_id long, text string")
    assert sorted(str(r.text) for r in suffix_dedup.remove_repeats(twice).collect()) == ["None", "a" * 10, "b" * 10]


@pytest.mark.parametrize("parts", [1, 3, 8])
@pytest.mark.parametrize("keep", [False, True])
def test_ranks(spark, parts, keep):
    rng = random.Random(parts)
    rows = [(rng.choice([5, 5, 5, 9, rng.randint(0, 400)]), rng.randint(0, 1), i, 1 + (i % 50 == 0)) for i in range(1500)]
    df = spark.createDataFrame(rows, "a long, b long, i long, n long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = ranks.reranked(df, ["a", "b"], "t", ["i"], weight="n", keep_unique=keep).collect()
        assert ranks.reranked(df.limit(0), ["a", "b"], "t", ["i"]).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    n = Counter()
    for a, b, _, m in rows:
        n[a, b] += m
    assert sorted(r.i for r in got) == sorted(i for a, b, i, _ in rows if keep or n[a, b] > 1)
    assert all(r.alone == (n[r.a, r.b] == 1) for r in got)
    names = {(r.a, r.b): r["rank"] for r in got}
    assert all(names[r.a, r.b] == r["rank"] for r in got)
    assert [names[k] for k in sorted(names)] == sorted(names.values())
    assert len(set(names.values())) == len(names)
    assert Counter((r.a, r.b) for r in got if r.first) == dict.fromkeys(names, 1)


@pytest.mark.parametrize("cut", [2, 5, 16])
def test_doubling_pairs_ranks(spark, cut, monkeypatch):
    """Against brute force, also where positions lie in other stretches than their partners."""
    monkeypatch.setattr(suffix_dedup, "CUT", cut)
    rng = random.Random(cut)
    rows = sorted({(rng.choice([1, 2, None]), rng.randint(0, 1), rng.randint(0, 60)) for _ in range(150)}, key=str)
    rows = [(*r, rng.randint(0, 2), rng.randint(0, 2)) for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, tag long, pos long, level int, rank long")
    got = suffix_dedup._doubled(df, 3, 1).collect()
    at = {r[:3]: r for r in rows}
    pairs = {r[:3]: (r[4], at[r[0], r[1], r[2] + 3][4]) for r in rows if r[3] >= 1 and (r[0], r[1], r[2] + 3) in at}
    n = Counter(pairs.values())
    assert {(r.doc_id, r.tag, r.pos): (r.a, r.b) for r in got} == {k: v for k, v in pairs.items() if n[v] > 1}


def brute_sketch(text, k=5, scale=8):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    if not words:
        return ""
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]

    def chain(hs, seed):
        for h in hs:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
        return seed

    if len(words) >= k:
        found = [chain(hashes[i : i + k], 42) >> 16 for i in range(len(words) - k + 1)]
    else:
        seed = 42
        for h in hashes:
            seed = chain([seed, h], 42)
        found = [seed >> 16]
    kept = sorted({h for h in found if h < (1 << 48) // scale})
    return "".join(f"{h:012x}" for h in kept) or f"~{min(found):012x}"


def test_sketches(spark, documents, sf, texts):
    rows = {r.doc_id: r for r in sketch.op10_scaled_sketch(spark, sf).collect()}
    order = sorted(texts)
    for i, nxt in zip(order, order[1:] + order[:1], strict=True):
        t, q = texts[i], len(texts[i]) // 4
        edited = t[: len(t) - q] + texts[nxt][:q]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (brute_sketch(t), brute_sketch(edited))
        parts = lambda f: {f[k : k + 12] for k in range(0, len(f), 12)} if f[:1] != "~" else {f}
        for got, other in ((r.near_edited, edited), (r.near_next, texts[nxt])):
            a, b = parts(brute_sketch(t)), parts(brute_sketch(other))
            assert got == pytest.approx(1.0 if a == b else len(a & b) / min(len(a), len(b)) if a and b else 0.0)


@pytest.mark.parametrize("odd", [[""], [None], [" \n\t "], ["", None, "a", " ", "\x0b", "b c", "a b c d e", "", "a b c d e f g h", None]])
def test_sketches_of_texts_without_words(spark, odd, tmp_path):
    rows = [(i, t) for i, t in enumerate([*odd, "one two three four five six seven eight", *odd])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in sketch.op10_scaled_sketch(spark, str(tmp_path)).collect()}
    texts = [t or "" for _, t in rows]
    assert sorted(got) == list(range(len(texts)))
    for i, (t, after) in enumerate(zip(texts, texts[1:] + texts[:1], strict=True)):
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (brute_sketch(t), brute_sketch(edited))
        for near, other in ((got[i].near_edited, edited), (got[i].near_next, after)):
            if not t.split() or not other.split():
                assert near == float(not t.split() and not other.split())


def test_containment_estimates(spark):
    rng = random.Random(1)
    long = [f"w{rng.randint(0, 10**6)}" for _ in range(8000)]
    df = spark.createDataFrame([(" ".join(long), " ".join(long[:2000]), " ".join(f"v{i}" for i in range(3000)))], "a string, b string, c string")
    s = df.select(sketch.sketch(df.a).alias("a"), sketch.sketch(df.b).alias("b"), sketch.sketch(df.c).alias("c"))
    row = s.select(sketch.likeness(s.a, s.b).alias("ab"), sketch.likeness(s.a, s.c).alias("ac")).first()
    assert row.ab > 0.98
    assert row.ac == 0.0


@pytest.mark.parametrize("rows", [[], [(5, None)], [(5, "a"), (5, "b"), (None, "c"), (9, "d")]])
def test_neighbours_in_order(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.after) for r in sketch.with_neighbour(df).collect())
    known = sorted((i, t or "") for i, t in rows if i is not None)
    assert got == [(*a, b[1]) for a, b in zip(known, known[1:] + known[:1], strict=True)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 9, 10, 50])
def test_places_among_cuts(spark, n):
    cuts = [3 * i for i in range(n)]
    rows = spark.range(-2, 160).select("id", sketch._place(sketch.F.col("id"), cuts).alias("p")).collect()
    assert all(r.p == sum(c <= r.id for c in cuts) for r in rows)


def vector_rows(seed, n=300, dim=16):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim)).astype("f4")
    for i in range(n // 2):
        v[i + n // 2] = v[rng.integers(0, 20)] + rng.choice([0, 0.05, 0.3]) * rng.standard_normal(dim)
    rows = [(int(i), [float(x) for x in v[i]], int(i % 2)) for i in range(n)]
    rows += [(1000, None, 1), (1001, [0.0] * dim, 1), (1002, [float("nan")] + [1.0] * (dim - 1), 1), (1003, [float("inf")] * dim, 0), (1004, [None] + [1.0] * (dim - 1), 1), (1005, rows[0][1], None), (1006, [], 1), (1007, [1.0, 2.0], 0), (1008, [2.0, 4.0], 0)]
    return rows


@pytest.mark.parametrize("tile", [16, 2048])
def test_embedding_links(spark, tile):
    rows = vector_rows(tile)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS key", "2 AS v")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, 0.93, tile).collect()}
    ids = [r[0] for r in rows]
    good = lambda v, y: y is not None and v and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(v)
    vs = [np.array(v, "f4").astype("f8") if good(v, y) else None for _, v, y in rows]
    links = []
    for a in range(len(rows)):
        for b in range(a):
            if vs[a] is not None and vs[b] is not None and rows[a][2] == rows[b][2] and len(vs[a]) == len(vs[b]):
                if vs[a] @ vs[b] / (np.linalg.norm(vs[a]) * np.linalg.norm(vs[b])) >= 0.93:
                    links.append((a, b))
    n = Counter(x for p in links for x in p)
    roots = find_components(len(rows), links)
    assert got == {ids[i]: (n[i], ids[roots[i]], roots[i] == i) for i in range(len(rows))}


def test_embedding_links_equal_their_sql(spark):
    import duckdb

    rows = [r for r in vector_rows(3) if r[0] not in (1006,)]
    rows += [(2000 + i, rows[i][1], rows[i][2]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    folder = fresh_path(spark, "vectors")
    df.write.parquet(folder)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder.removeprefix('file://')}/*.parquet')")
    told = sorted(db.execute(embeddings.OP8_SQL).fetchall())
    assert sorted(tuple(r) for r in embeddings.near_duplicates(df).collect()) == told
    assert sum(r[1] for r in told) > 50


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(df).collect() == []
