"""Operators on whole tables against brute force and their defined cases."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from redpen.llm import mixing, near_dedup, nearest, sharding
from redpen.llm.components import components


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    made = [(i, None if i % 97 == 0 else " ".join(rnd.choice(base) for _ in range(rnd.randrange(40))), f"s{i % 3}") for i in range(300)]
    made += [(400 + i, "hot copy of a text that repeats", "s0") for i in range(200)]
    template = [f"t{i}" for i in range(60)]
    for i in range(150):  # near copies of one template, at all similarities
        words = list(template)
        for _ in range(rnd.randrange(8)):
            words[rnd.randrange(60)] = f"e{rnd.random()}"
        made.append((700 + i, " ".join(words), None))
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({"size": F.lit("clash"), "key": F.lit("clash"), "digest": F.lit("clash")})


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, width):
    words = (text or "").lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_components(rows, width, percent=80):
    sets = {i: shingles(text, width) for i, text, _ in rows}
    part = {i: i for i in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(sets)
    for at, a in enumerate(ids):
        for b in ids[:at]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = find(a), find(b)
                part[max(a_, b_)] = min(a_, b_)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_by_brute_force(docs, rows):
    found = near_dedup.near_duplicates(docs, width=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_block_groups_lose_no_link(monkeypatch, docs, rows):
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "CHUNK", 16)
    found = near_dedup.near_duplicates(docs, width=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, 4)


def test_keep_first(spark, docs, rows):
    twice = docs.unionByName(docs.where("doc_id = 700"))
    kept = near_dedup.keep_first(twice)
    assert kept.columns == docs.columns
    expected = {i for i, (_, c) in brute_components(rows, 5).items() if c == i}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected)
    assert near_dedup.keep_first(docs.limit(0)).count() == 0


def test_null_and_repeated_ids_lose_no_document(spark):
    base = [f"a{i}" for i in range(60)]
    near = " ".join([*base[:59], "b"])
    unique = [" ".join(f"{c}{i}" for i in range(30)) for c in "uvwx"]
    rows = [
        (None, unique[0], 0), (None, unique[1], 1), (None, unique[1], 2), (None, None, 3), (None, "", 4),
        (5, unique[2], 5), (5, unique[3], 6), (5, unique[3], 7), (None, near, 8), (9, " ".join(base), 9),
        (3, None, 10), (3, None, 11),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    kept = sorted((str(r.doc_id), str(r.text)) for r in near_dedup.keep_first(df).collect())
    expected = [(None, unique[0]), (None, unique[1]), (None, None), (None, ""), (5, unique[2]), (5, unique[3]), (9, " ".join(base)), (3, None)]
    assert kept == sorted((str(i), str(t)) for i, t in expected)
    found = near_dedup.near_duplicates(df).collect()
    assert len(found) == len(rows) and all(r.kept is not None for r in found)
    assert sorted(str(r.component_id) for r in found if r.n_shingles > 30) == ["9", "9"]
    assert [r.doc_id for r in found if r.n_shingles > 30 and r.kept] == [9]


def test_pruning_keeps_likely_pairs():
    table = near_dedup.fewest_matches(0.8, 128, 32, 1e-4)
    assert [n for n, _ in table] == [32, 64, 96, 128]
    assert all(m < 0.8 * n for n, m in table)


def test_shards(docs, rows):
    found = sharding.shard(docs, shards=5).collect()
    sizes, slots = {}, {}
    text = {i: t for i, t, _ in rows}
    for r in found:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(found) == len(rows) and set(sizes) == set(range(5))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 0.1 * sum(sizes.values()) / 5
    assert sharding.shard(docs.limit(0)).count() == 0
    assert sharding.shard(docs.where("doc_id = 1")).count() == 1


def test_range_of(spark):
    df = spark.range(-3, 60).select("id", sharding.range_of(F.col("id"), list(range(0, 50, 2))).alias("n"))
    assert all(r.n == sum(b <= r.id for b in range(0, 50, 2)) for r in df.collect())


def test_mix_equals_sql(docs, rows):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    expected = sorted(db.execute(mixing.mix_sql()).fetchall())
    found = sorted(tuple(r) for r in mixing.mix(docs).collect())
    assert found == [pytest.approx(e) for e in expected]
    by_source = {}
    for _, size, of, target, taken in found:
        assert taken in (0, size, 2 * size)
        by_source.setdefault((of, target), []).append(taken)
    assert all(abs(sum(t) - target) <= 40 for (_, target), t in by_source.items())


def mixed_by_hand(rows):
    """Copies per row of a plain version of the mix: the sources' targets by stepwise capping, odds in one sorted list."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_source = {}
    for i, (_, text, source) in enumerate(rows):
        by_source.setdefault(source, []).append((i, size(text)))

    def filled(caps, weights, whole):
        free, got = set(caps), {}
        while free:
            level = max(whole - sum(got.values()), 0) / (sum(weights[k] for k in free) or 1)
            over = {k for k in free if weights[k] * level > caps[k]}
            for k in over or free:
                got[k] = caps[k] if over else weights[k] * level
            free -= over or set(free)
        return got

    sizes = {s: sum(n for _, n in own) for s, own in by_source.items()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = filled({s: 2 * sizes[s] for s in sizes}, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    taken, draws = {}, []
    for s, own in by_source.items():
        words = {}
        for _, n in own:
            words[len(f"{n:b}")] = words.get(len(f"{n:b}"), 0) + n
        shares = filled({k: 2 * w for k, w in words.items()}, {k: k * w for k, w in words.items()}, targets[s])
        p, ranked = {}, []
        for i, n in own:
            copies = shares[len(f"{n:b}")] / words[len(f"{n:b}")] if words[len(f"{n:b}")] else 0
            taken[i], p[i] = math.floor(copies), copies - math.floor(copies)
            doc, text, _ = rows[i]
            text = "n" if text is None else hashlib.md5(text.encode()).hexdigest()
            digest = hashlib.md5(f"{'n' if doc is None else doc}:{text}".encode()).hexdigest()
            u = (int(digest[:13], 16) + 0.5) / 2**52
            if p[i] > 0:
                ranked.append((u / (1 - u) / (p[i] / (1 - p[i])), u, i, n))
        ranked.sort()
        draws.append([u for _, u, _, _ in ranked])
        need, before = sum(p[i] * n for i, n in own), 0
        for _, same in itertools.groupby(ranked, key=lambda r: r[:2]):
            same = list(same)
            alike = sum(n for *_, n in same)
            if 2 * before + alike <= 2 * need:
                for _, _, i, _ in same:
                    taken[i] += 1
            before += alike
    return taken, targets, draws


@pytest.mark.parametrize("bucket_rows", [7, 10_000])
def test_mix_by_hand_with_unequal_probabilities(monkeypatch, spark, rows, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    rnd = random.Random(2)
    long = [(2000 + i, " ".join(["w"] * int(rnd.paretovariate(0.7)) + [str(i)]), f"s{i % 3}") for i in range(200)]
    many = [*rows, *long, *[(None, f"text {'x ' * i}", "s1") for i in range(40)], *[(5, f"other {i}", "s2") for i in range(40)]]
    many += [(9000, "", "nothing but spaces"), (9001, None, "nothing but spaces"), *[(None, None, None)] * 3, *[(77, "the same row", "s1")] * 9]
    taken, targets, draws = mixed_by_hand(many)
    found = mixing.mix(spark.createDataFrame(many, "doc_id long, text string, source string")).collect()
    size = lambda t: len((t or "").split())
    expected = sorted((str(d), size(t), round(targets[s], 6), taken[i] * size(t)) for i, (d, t, s) in enumerate(many))
    assert sorted((str(r.doc_id), r.size, round(r.target, 6), r.taken) for r in found) == expected
    assert any(own != sorted(own) for own in draws)


def test_mixed_rows(docs):
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(docs).collect() if r.size}
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(counts.get(i, 0) == n for i, n in taken.items())
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_nearest(spark):
    random_ = np.random.Generator(np.random.PCG64(3))
    vectors = random_.normal(size=(400, 24)).round(3).astype(np.float32)
    vectors[50:90] = vectors[50]
    data = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    data += [(900, None, "x"), (920, [0.0] * 24, "x"), (940, [float("nan")] * 24, "x"), (960, [], "x"), (980, [1.0, None], "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, ids string")
    found = {}
    for r in nearest.search(df, F.col("vec_id") % 20 == 0, k=20).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 400, 20))
    exact, hits = vectors.astype(float), 0
    for q, own in found.items():
        scores = np.cumsum(exact * exact[q], axis=1)[:, -1]
        order = [i for i in np.lexsort((np.arange(400), -scores)) if i != q][:20]
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in [v for _, v, _ in own]
        assert all(s == scores[v] for _, v, s in own)
        hits += len(set(order) & {v for _, v, _ in own})
    assert hits >= 0.9 * 20 * len(found)
    assert [v for _, v, _ in found[60]] == [i for i in range(50, 71) if i != 60]
    few = nearest.search(df.where("vec_id < 3"), F.col("vec_id") == 0, k=20).collect()
    assert {r.vec_id for r in few} <= {1, 2}
    assert nearest.search(df.limit(0), F.lit(True)).count() == 0


def test_nearest_completes_few_candidates_and_long_vectors(spark):
    random_ = np.random.Generator(np.random.PCG64(5))
    vectors = random_.normal(size=(10, 64))
    vectors[3] *= 20
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = {}
    for r in nearest.search(df, F.lit(True), k=20).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    scores = vectors @ vectors.T
    assert found == {q: [i for i in np.argsort(-scores[q]).tolist() if i != q] for q in range(10)}
    unit = nearest._lifted(vectors, np.linalg.norm(vectors, axis=1).max(), False)
    assert np.linalg.norm(unit, axis=1) == pytest.approx(1)


def test_pipeline_applies_its_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    result = corpus_pipeline.run(spark, sf_dir)
    assert result.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert result.count() == counts[4]
