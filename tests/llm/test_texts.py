"""Operators on single texts against brute force and their defined cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from redpen.llm import bpe, cross_entropy, html_text, licenses, repetition, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " \n\t ", "word", "The the THE. x", "naïve ß 漢字 \U0001f600 \x1c \x85",
    "a" * 5000, "one two three " * 400, "one two three " * 400, "line one here\nline one here\nother\n",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text, "clash", "clash") for i, text in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, kept string")


def by_id(df, key="doc_id"):
    return {row[key]: row for row in df.collect()}


def test_bpe_equals_the_public_library(docs):
    ranks = bpe.read_ranks(PATH)
    real = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = by_id(bpe.digests(docs, PATH, public_tokenizers.PATTERN))
    for i, text in enumerate(TEXTS):
        ids = real.encode_ordinary(text or "")
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_round_trip_is_one_pass(docs, monkeypatch):
    pattern = public_tokenizers.PATTERN
    plan = bpe.digests(docs, PATH, pattern)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    monkeypatch.setattr(bpe, "SLICE_CHARACTERS", 40)
    once, apart = bpe.round_trip(docs, PATH, pattern), bpe.decode(bpe.encode(docs, PATH, pattern), PATH)
    assert by_id(once) == by_id(apart)


def test_bpe_of_no_rows(docs):
    assert bpe.digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_bpe_refuses_gaps():
    with pytest.raises(ValueError):
        bpe.sentencepiece_model({b"a": 1})


def test_longest_repeats_by_brute_force():
    rnd = random.Random(3)
    for _ in range(150):
        words = [rnd.randrange(3) for _ in range(rnd.randrange(1, 30))]
        expected = [
            max(
                (next((k for k in range(len(words)) if max(a, b) + k >= len(words) or words[a + k] != words[b + k]), 0)
                 for b in range(len(words)) if b != a),
                default=0,
            )
            for a in range(len(words))
        ]
        tokens = np.unique(np.array([*words, 99]), return_inverse=True)[1]
        assert repetition.longest_repeats(tokens)[:-1].tolist() == expected


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    inside = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
        len(inside), len(words) < 50 or 100 * len(inside) > 50 * len(words),
    )


def test_quality_counts(spark, docs):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("ab cd# e\n f|g é".split(" ")) for _ in range(rnd.randrange(80))) for _ in range(60)]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = by_id(repetition.quality_rules(docs.select("doc_id", "text").union(more)))
    for i, text in [*enumerate(TEXTS), *enumerate(texts, 100)]:
        row = found[i]
        own = (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed)
        assert own == brute_quality(text)
        assert not (row.kept and row.base_failed)


def test_quality_limits_and_filter(spark):
    rnd = random.Random(9)
    fresh = [f"w{rnd.random()}" for _ in range(400)]
    clean, copied = " ".join(fresh), " ".join(fresh[:100] + fresh[50:100] + fresh[100:120])
    df = spark.createDataFrame([(1, clean, "x"), (2, copied, "y"), (3, None, "z")], "doc_id long, text string, kept string")
    assert [r.doc_id for r in repetition.keep_good(df).collect()] == [1]
    assert repetition.keep_good(df).columns == df.columns


def test_licenses():
    found = licenses.Scanner().scan("MIT  License; see the Apache-License, Version 2.0 or CC-BY-SA 4.0. GNU General Public License")
    assert (found["n_words"], found["n_base"]) == (19, 4)
    assert (found["first_word"], found["last_word"]) == (0, 15)
    assert found["base_labels"] == "apache,cc-by,gpl,mit"
    assert set(found["labels"].split(",")) >= {"apache-2.0", "cc-by-sa", "mit", "gpl"}
    assert len(licenses.RULES) > 200


def test_license_places_by_brute_force(docs):
    rnd = random.Random(2)
    pool = "cc by mit license apache gnu general public é".split()
    for _ in range(100):
        text = rnd.choice(" -").join(rnd.choice(pool) for _ in range(40))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        places = [i for p in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        got = licenses.Scanner().scan(text)
        assert (got["n_base"], got["first_word"], got["last_word"]) == (
            len(places), min(places, default=None), max(places, default=None)
        )
    assert by_id(licenses.scan(docs))[0].score == 0.0


def test_contained_matches_are_suppressed():
    kept = licenses.suppress([(0, 3, 1, "a", 0), (0, 8, 3, "b", 1), (2, 4, 5, "c", 2), (7, 9, 2, "d", 3), (0, 8, 3, "e", 4)])
    assert [k[3] for k in kept] == ["b", "c", "d"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/>Home</a></li></ul></nav><div class="ad">Buy this now please</div>
<article><h1>Title &amp; more</h1><p><b>First   paragraph
of the text.<br><p>Short.</p><div class="comments"><p>A reader says a lot of things</p></div></article>
<footer>&copy; someone</footer></body></html>"""


def test_html_main_text(spark):
    text = "Title & more\nFirst paragraph of the text.\nShort."
    assert html_text.main_text(PAGE) == text
    assert html_text.main_text(PAGE[: PAGE.index("<footer")] + "<foot") == text
    assert [html_text.main_text(x) for x in (None, "", "<nav>a</nav>", "plain")] == ["", "", "", "plain"]
    plain = '<body><div id="menu">a b</div><div><p>A long paragraph with a lot of words.<p>Tiny.</div><div class=ad>x</div>'
    assert html_text.main_text(plain) == "A long paragraph with a lot of words.\nTiny."
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", None, "t")], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in html_text.extract(pages).collect()) == [0, len(text)]


def test_cross_entropy_by_brute_force(spark, docs):
    good = spark.createDataFrame([(7,), (7,), (4,)], "doc_id long")
    found = by_id(cross_entropy.score(docs, good, size=3))
    words = {i: (t or "").encode().lower().split() for i, t in enumerate(TEXTS)}
    counts = {}
    for own in words.values():
        for w in own:
            counts[w] = counts.get(w, 0) + 1
    known = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w))[:3], 1)}
    tables = np.zeros((2, 4, 4))
    pairs = {}
    for i, own in words.items():
        ids = [0] + [known.get(w, 0) for w in own]
        pairs[i] = list(zip(ids, ids[1:]))
        for a, b in pairs[i]:
            tables[0, a, b] += i in (7, 4)
            tables[1, a, b] += 1
    target, background = map(cross_entropy.losses, tables)
    for i, own in words.items():
        expected = np.mean([target[p] - background[p] for p in pairs[i]]) if own else None
        assert found[i].score == (pytest.approx(expected, abs=1e-6) if own else None)


def test_cross_entropy_tells_all_words_apart(monkeypatch, spark):
    monkeypatch.setattr(cross_entropy, "BLOCK_WORDS", 700)
    rnd = random.Random(6)
    rows = [(i, " ".join(f"w{rnd.randrange(4000)}" for _ in range(rnd.randrange(120)))) for i in range(100)] + [(100, None)]
    chosen = set(range(0, 100, 3))
    good = spark.createDataFrame([(i,) for i in chosen], "doc_id long")
    found = by_id(cross_entropy.score(spark.createDataFrame(rows, "doc_id long, text string"), good))
    pairs = {i: list(zip([None, *(t or "").split()], (t or "").split())) for i, t in rows}
    size = len({w for own in pairs.values() for _, w in own}) + 1
    assert size > 2500

    def model(ids):
        both = [p for i in ids for p in pairs[i]]
        n, before, after = Counter(both), Counter(v for v, _ in both), Counter(w for _, w in both)
        base = lambda w: (after[w] + 1) / (len(both) + size)
        return lambda v, w: -math.log((n[v, w] + 50 * base(w)) / (before[v] + 50))

    target, background = model(chosen), model(pairs)
    assert set(found) == set(pairs)
    for i, own in pairs.items():
        row = found[i]
        assert row.n_tokens == len(own)
        for got, loss in ((row.target_loss, target), (row.background_loss, background)):
            assert got == (pytest.approx(sum(loss(*p) for p in own) / len(own)) if own else None)


def test_cross_entropy_items_travel_whole():
    random_ = np.random.Generator(np.random.PCG64(9))
    common = np.unique(np.append(random_.integers(1, 1 << 63, 3000).astype(np.uint64), np.uint64(0)))
    words = np.concatenate([common[:2000], random_.integers(1, 1 << 63, 2000).astype(np.uint64), [cross_entropy.ANY]])
    v, w = (words[random_.integers(0, len(words), 20000)] for _ in range(2))
    items = np.unique(cross_entropy.coded(v, w, common))
    assert len(items) == len(set(zip(v.tolist(), w.tolist())))
    single = {(a, b) for a, b in zip(v.tolist(), w.tolist()) if a == int(cross_entropy.ANY)}
    assert np.count_nonzero(items & np.uint64(1)) == len(single)
    part = items >> np.uint64(61)
    for p in range(8):
        own = items[part == p]
        assert (cross_entropy.received(*cross_entropy.sent(own, p, 3), p, 3) == own).all()
    none = np.empty(0, np.uint64)
    assert len(cross_entropy.received(*cross_entropy.sent(none, 5, 3), 5, 3)) == 0


@pytest.mark.parametrize(("common", "often"), [(65_535, 1), (40, 2), (1, 1)])
def test_cross_entropy_is_the_same_however_items_are_written(monkeypatch, spark, docs, common, often):
    good = spark.createDataFrame([(7,), (4,)], "doc_id long")
    expected = by_id(cross_entropy.score(docs, good))
    monkeypatch.setattr(cross_entropy, "OFTEN", often)
    monkeypatch.setattr(cross_entropy, "COMMON", common)
    monkeypatch.setattr(cross_entropy, "BLOCK_WORDS", 50)
    found = by_id(cross_entropy.score(docs, good))
    assert found.keys() == expected.keys()
    for i, row in found.items():
        assert row.score == (None if expected[i].score is None else pytest.approx(expected[i].score))


def test_cross_entropy_of_no_rows(spark, docs):
    good = spark.createDataFrame([(7,)], "doc_id long")
    assert cross_entropy.score(docs.limit(0), good).count() == 0
    assert {r.score is None for r in cross_entropy.score(docs, good.limit(0)).collect() if r.n_tokens == 0} == {True}


def test_losses_are_probabilities():
    counts = np.random.Generator(np.random.PCG64(1)).integers(0, 9, (6, 6)).astype(float)
    assert np.exp(-cross_entropy.losses(counts)).sum(axis=1) == pytest.approx(1)


@pytest.fixture(scope="module")
def labelled():
    rnd = random.Random(4)
    prose = lambda n: ["".join(rnd.choice("anerthiost") for _ in range(rnd.randrange(2, 8))) for _ in range(n)]
    rows = []
    for i in range(400):
        words = prose(rnd.randrange(30, 200))
        if toxic := i % 4 == 0:
            for _ in range(4):
                words.insert(rnd.randrange(len(words)), rnd.choice(["blockhead", "numbskull", "vexu" + prose(1)[0]]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_unseen_texts(labelled):
    score = toxicity.fit(labelled[:320]).scorer()
    right = sum((score(text) >= 0.5) == bool(y) for _, text, y in labelled[320:])
    assert right >= 74
    assert 0 <= score(None) <= 1 and score("") == score(None)


def test_toxicity_defined_cases(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.5}


def test_held_out_rows_train_nothing(spark, labelled):
    df = spark.createDataFrame(labelled, "doc_id long, text string, toxic int")
    flipped = df.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    a, b = (toxicity.train(df, x) for x in (df, flipped))
    assert a.weights.tolist() == b.weights.tolist() and a.toxic == b.toxic


def test_toxicity_defined_cases(spark, labelled):
    rows = [(i, text, "clash", 7) for i, text, _ in labelled[:120]] + [(500, None, "clash", 7), (501, "", "clash", 7)]
    rows += [(5, "another text under the same id", "clash", 7), (None, "no id", "clash", 7), (600, labelled[0][1] * 300, "clash", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled[:120]] + [(0, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    found = toxicity.score(docs, model).collect()
    score = model.scorer()
    assert sorted((str(r.doc_id), r.score) for r in found) == sorted((str(i), score(text)) for i, text, *_ in rows)
    assert all(r.predicted == (r.score >= 0.5) for r in found)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in found)
    assert toxicity.score(docs.limit(0), model).count() == 0
    nothing = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.5}


def test_toxicity_learns_words_of_two_characters():
    """Of two bytes or three a match saves too little to tell; two characters of six bytes are enough."""
    rnd, rows = random.Random(4), []
    for i in range(400):
        words = ["".join(rnd.choice("anerthiost") for _ in range(rnd.randrange(2, 8))) for _ in range(rnd.randrange(30, 200))]
        for _ in range(4 * (i % 4 == 0)):
            words.insert(rnd.randrange(len(words)), "漢字")
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    score = toxicity.fit(rows[:320]).scorer()
    assert sum((score(text) >= 0.5) == bool(y) for _, text, y in rows[320:]) >= 76
