"""Word families mined from a vocabulary, and categories by them, against literal rows."""

import pytest
from pyspark.sql import functions as F

from redpen.operators import classify as C
from redpen.operators import edits as E
from redpen.operators.families import known_words, proposals, word_families

WORDS = (
    "bake bakes baked baking walk walks walked walking stop stops stopped stopping carry carries carried "
    "dog dogs city cities box boxes tall taller tallest large larger happy happier happily quick quickly slow slowly thing string "
    "the a in on he she and but to not hello goodbye ran Mice"
).split()

#: word: lemma, part of speech, tag.
FAMILIES = {
    "bake": ("bake", "VERB", "VB"), "bakes": ("bake", "VERB", "VBZ"), "baked": ("bake", "VERB", "VBD"), "baking": ("bake", "VERB", "VBG"),
    "stop": ("stop", "VERB", "VB"), "stopped": ("stop", "VERB", "VBD"), "stopping": ("stop", "VERB", "VBG"),
    "carry": ("carry", "VERB", "VB"), "carries": ("carry", "VERB", "VBZ"), "carried": ("carry", "VERB", "VBD"),
    "dog": ("dog", "NOUN", ""), "dogs": ("dog", "NOUN", "s"), "cities": ("city", "NOUN", "s"), "boxes": ("box", "NOUN", "s"),
    "tall": ("tall", "ADJ", ""), "taller": ("tall", "ADJ", "er"), "tallest": ("tall", "ADJ", "est"), "larger": ("large", "ADJ", "er"),
    "happier": ("happy", "ADJ", "er"), "happily": ("happy", "ADV", "ly"), "quickly": ("quick", "ADV", "ly"), "quick": ("quick", "ADJ", ""),
    "thing": None, "string": None, "hello": None, "the": None, "ran": None, "Mice": None,
}

#: op, original, correction, category.
GOLDEN = [
    ("R", "dog", "dogs", "NOUN:NUM"), ("R", "doges", "dogs", "NOUN:INFL"), ("R", "dogs", "boxes", "NOUN"), ("M", "", "'s", "NOUN:POSS"),
    ("M", "", "'", "NOUN:POSS"), ("R", "walk", "walks", "VERB:SVA"), ("R", "walk", "walking", "VERB:FORM"), ("R", "walk", "walked", "VERB:TENSE"),
    ("R", "walkes", "walks", "VERB:INFL"), ("R", "stoped", "stopped", "VERB:INFL"), ("R", "walked", "stopped", "VERB"), ("M", "", "walks", "VERB"),
    ("R", "tall", "taller", "ADJ:FORM"), ("R", "taller", "larger", "ADJ"), ("R", "quick", "quickly", "MORPH"), ("R", "quickly", "slowly", "ADV"),
    ("U", "slowly", "", "ADV"), ("R", "the", "a", "DET"), ("R", "in", "on", "PREP"), ("R", "he", "she", "PRON"), ("R", "and", "but", "CONJ"),
    ("R", "to", "not", "PART"), ("R", "'ll", "'ve", "CONTR"), ("R", ",", ";", "PUNCT"), ("R", "Dog", "dog", "ORTH"),
    ("R", "best friend", "bestfriend", "ORTH"), ("R", "dog box", "box dog", "WO"), ("R", "teh", "the", "SPELL"), ("R", "hello", "goodbye", "OTHER"),
    ("R", "hello", "taller", "OTHER"), ("R", "dog hello", "tall slow", "OTHER"),
]


@pytest.fixture(scope="module")
def vocabulary(spark):
    return spark.createDataFrame([(w, 2) for w in WORDS], "word string, n long")


def test_families(vocabulary):
    found = {r.word: (r.feature and tuple(r.feature)) for r in known_words(vocabulary, word_families(vocabulary, 1, ("the", "he", "she"))).collect()}
    assert set(found) == set(WORDS)
    assert {w: found[w] for w in FAMILIES} == FAMILIES


def test_endings_on_few_words_drop_out(spark, vocabulary):
    # -s and -ly show on two base words or more, a doubled letter before -ed and -ily on one.
    kept = {r.word for r in word_families(vocabulary, 2).collect()}
    assert {"bakes", "dogs", "cities", "quickly"} <= kept and not {"stopped", "happily"} & kept
    assert word_families(vocabulary, 50).count() == 0
    assert word_families(vocabulary.limit(0)).count() == 0


def test_proposals_of_one_word(spark):
    row = spark.range(1).select(proposals(F.lit("stopped")).alias("p")).first()
    assert {(p.lemma, p.kind) for p in row.p} == {("stopp", "ed"), ("stoppe", "ed"), ("stop", "ed")}
    assert spark.range(1).select(proposals(F.lit("is")).alias("p")).first().p == []


def test_golden_categories(spark, vocabulary):
    assert {category for *_, category in GOLDEN} == set(C.CATEGORIES)
    rows = [(i, 0, op, o, c, 1, 2) for i, (op, o, c, _) in enumerate(GOLDEN)]
    edits = spark.createDataFrame(rows, "sent_id long, edit_no int, op string, o_str string, c_str string, o_start int, o_end int")
    got = C.classify_by_families(edits, vocabulary, min_stems=1).orderBy("sent_id").collect()
    assert [(r.op, r.o_str, r.c_str, r.category) for r in got] == GOLDEN
    assert [r.type for r in got] == [f"{op}:{category}" for op, _, _, category in GOLDEN]


def test_report_by_families(spark, vocabulary):
    flags = [(op, o, c, 1, 2, 3) for op, o, c, _ in GOLDEN] * 2
    counted = C.classify_counts(spark.createDataFrame(flags, "op string, o_str string, c_str string, tp int, fp int, fn int"), vocabulary, 1)
    got = {(r.o_str, r.c_str): (r.category, r.tp, r.fp, r.fn) for r in counted.collect()}
    assert got == {(o, c): (category, 2, 4, 6) for _, o, c, category in GOLDEN}


FEATS = "array<struct<lemma:string,pos:string,tag:string>>"


def test_features_beside_the_texts(spark, vocabulary):
    f = lambda lemma, pos, tag="-": {"lemma": lemma, "pos": pos, "tag": tag}
    he, tall = f("he", "PRON"), f("tall", "ADJ")
    rows = [
        (1, "he go tall", "he goes tall", [he, f("go", "VERB", "VB"), tall], [he, f("go", "VERB", "VBZ"), tall]),
        (2, "he tall", "he taller", [he, tall], [he, tall]),
        (3, "he walkz tall", "he walks tall", [he, f("walk", "VERB"), tall], [he, f("walk", "VERB"), tall]),
        (4, "he walk", "he hello", None, [he, f("hello", "INTJ")]),
        (5, "same", "same", [], []),
        (6, "he", "he walks", [he], [he]),  # fewer features than tokens
    ]
    df = spark.createDataFrame(rows, f"sent_id long, original string, corrected string, o_feats {FEATS}, c_feats {FEATS}")
    words = vocabulary.unionByName(spark.createDataFrame([("go", 2), ("goes", 2)], "word string, n long"))
    want = {1: "R:VERB:SVA", 2: "R:ADJ:FORM", 3: "R:VERB:INFL", 4: "R:OTHER", 6: "M:OTHER"}
    for extraction in ({}, {"merge": "rules", "cost": "likeness"}):
        got = C.classify_pairs(df, words, ("o_feats", "c_feats"), **extraction)
        assert {r.sent_id: r.type for r in got.collect()} == want


def test_features_are_cut_out_where_the_pair_is_read(spark, vocabulary, tmp_path):
    rows = [(i, "he go tall", "he goes tall", None, None) for i in range(50)]
    path = str(tmp_path / "pairs")
    spark.createDataFrame(rows, f"sent_id long, original string, corrected string, o_feats {FEATS}, c_feats {FEATS}").write.parquet(path)
    pairs = spark.read.parquet(path)
    plan = C.classify_pairs(pairs, vocabulary, ("o_feats", "c_feats"))._jdf.queryExecution().optimizedPlan().toString()
    # The pairs are written as edits before anything is planned here; features are gone by then.
    assert "o_feats" not in plan and "tok_no" not in plan
    narrow = E.with_edits(pairs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in narrow and "Generate" not in narrow


def test_row_features_equal_the_token_table(spark, vocabulary):
    f = lambda w: {"lemma": w.rstrip("s"), "pos": "VERB" if len(w) % 2 else "NOUN", "tag": "VBZ" if w.endswith("s") else "VB"}
    texts = [(i, f"walk dog tall{i % 3} box", f"walks dogs tall{i % 2} boxes x") for i in range(12)]
    arrays = [(i, a, b, [f(w) for w in a.split()], [f(w) for w in b.split()]) for i, a, b in texts]
    df = spark.createDataFrame(arrays, f"sent_id long, original string, corrected string, o_feats {FEATS}, c_feats {FEATS}")
    tokens = [(i, s, k, *f(w).values()) for i, a, b in texts for s, t in (("o", a), ("c", b)) for k, w in enumerate(t.split())]
    table = spark.createDataFrame(tokens, "sent_id long, side string, tok_no int, lemma string, pos string, tag string")
    columns = ["sent_id", "edit_no", "type", "o_str", "c_str"]
    by_table = C.classify_with_features(E.extract_edits(df, merge="all-split"), vocabulary, table).select(columns)
    by_row = C.classify_pairs(df, vocabulary, ("o_feats", "c_feats"), merge="all-split").select(columns)
    assert sorted(map(tuple, by_row.collect())) == sorted(map(tuple, by_table.collect()))
