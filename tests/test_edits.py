import random

from pyspark.sql import functions as F

from redpen.operators import classify as C
from redpen.operators import edits as E


def pairs(spark, rows):
    return spark.createDataFrame(
        [(i, o, c) for i, (o, c) in enumerate(rows)], "sent_id LONG, original STRING, corrected STRING"
    )


def found(spark, rows, merge="all-merge"):
    got = E.extract_edits(pairs(spark, rows), merge=merge).orderBy("sent_id", "edit_no").collect()
    return [(r.sent_id, r.op, r.o_str, r.o_start, r.o_end, r.c_str, r.c_start, r.c_end) for r in got]


def test_operations_and_offsets(spark):
    rows = [
        ("I has a dog .", "I have a dog ."),
        ("I dog", "I see dog"),
        ("the the cat", "the cat"),
        ("same", "same"),
        ("same  spacing", "same spacing"),
        ("", "new"),
        ("gone", ""),
    ]
    assert found(spark, rows) == [
        (0, "R", "has", 1, 2, "have", 1, 2),
        (1, "M", "", 1, 1, "see", 1, 2),
        (2, "U", "the", 1, 2, "", 1, 1),
        (5, "M", "", 0, 0, "new", 0, 1),
        (6, "U", "gone", 0, 1, "", 0, 0),
    ]


def test_merging(spark):
    rows = [("a b c d", "a x y z d")]
    assert [e[2] for e in found(spark, rows)] == ["b c"]
    assert len(found(spark, rows, "all-split")) == 3
    assert len(found(spark, rows, "all-equal")) == 2


def test_rebuilding_random_pairs(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("abcdé") for _ in range(rng.randint(0, 25)))
    rows = [(text(), text()) for _ in range(300)] + [("", ""), ("a", "a")]
    for merge in E.MERGES:
        edited = E.with_edits(pairs(spark, rows), merge=merge)
        bad = edited.where(E.apply_edits(F.col("original"), F.col("edits")) != F.col("corrected"))
        assert bad.count() == 0


def test_edit_keys_parse_back(spark):
    edits = E.extract_edits(pairs(spark, [("a b", "a c")])).withColumn("type", F.lit("R:OTHER"))
    row = E.with_edit_key(edits).select("edit_key", E.parse_edit_key(F.col("edit_key")).alias("e")).first()
    assert row.edit_key == "1 2|||R:OTHER|||c"
    assert (row.e.o_start, row.e.o_end, row.e.type, row.e.c_str) == (1, 2, "R:OTHER", "c")


RULES = [
    ("Ice cream", "icecream", "ORTH"),
    ("the", "The", "ORTH"),
    ("", "'s", "NOUN:POSS"),
    (",", ".", "PUNCT"),
    ("…", "", "PUNCT"),
    ("is it", "It is", "WO"),
    ("ca", "n't", "CONTR"),
    ("in", "on", "PREP"),
    ("", "the", "DET"),
    ("he", "him", "PRON"),
    ("and", "or", "CONJ"),
    ("to", "", "PART"),
    ("recieve", "receive", "SPELL"),
    ("dog", "cat", "OTHER"),
]


def test_string_and_lexicon_rules(spark):
    words = spark.createDataFrame([(w,) for w in ("dog", "in", "he", "and", "the", "to")], "word STRING")
    rows = [(i, o, c) for i, (o, c, _) in enumerate(RULES)]
    edits = spark.createDataFrame(rows, "sent_id LONG, o_str STRING, c_str STRING").select(
        "*", F.lit(0).alias("o_start"), F.lit(1).alias("o_end"), E.operation(F.col("o_str"), F.col("c_str")).alias("op")
    )
    got = {r.sent_id: r.category for r in C.classify(edits, words).collect()}
    assert [got[i] for i in range(len(RULES))] == [r[2] for r in RULES]
    assert {r[2] for r in RULES} <= set(C.CATEGORIES)


FEATURES = [
    ("cats", "cat", ("cat", "NOUN", "NNS"), ("cat", "NOUN", "NN"), "NOUN:NUM"),
    ("informations", "information", ("information", "NOUN", "NNS"), ("information", "NOUN", "NN"), "NOUN:INFL"),
    ("go", "goes", ("go", "VERB", "VBP"), ("go", "VERB", "VBZ"), "VERB:SVA"),
    ("go", "going", ("go", "VERB", "VB"), ("go", "VERB", "VBG"), "VERB:FORM"),
    ("go", "went", ("go", "VERB", "VBP"), ("go", "VERB", "VBD"), "VERB:TENSE"),
    ("getted", "got", ("get", "VERB", "VBD"), ("get", "VERB", "VBD"), "VERB:INFL"),
    ("big", "bigger", ("big", "ADJ", "JJ"), ("big", "ADJ", "JJR"), "ADJ:FORM"),
    ("quick", "quickly", ("quick", "ADJ", "JJ"), ("quick", "ADV", "RB"), "MORPH"),
    ("dog", "cat", ("dog", "NOUN", "NN"), ("cat", "NOUN", "NN"), "NOUN"),
    ("dog", "ran", ("dog", "NOUN", "NN"), ("run", "VERB", "VBD"), "OTHER"),
]


def test_feature_rules(spark):
    known = ["cats", "go", "big", "quick", "dog"]
    words = spark.createDataFrame([(w,) for w in known], "word STRING")
    texts = pairs(spark, [(f[0], f[1]) for f in FEATURES])
    rows = []
    for i, (_, _, o, c, _) in enumerate(FEATURES):
        rows += [(i, "o", 0, *o), (i, "c", 0, *c)]
    features = spark.createDataFrame(
        rows, "sent_id LONG, side STRING, tok_no INT, lemma STRING, pos STRING, tag STRING"
    )
    got = C.classify_with_features(E.extract_edits(texts), words, features).collect()
    named = {r.sent_id: r.category for r in got}
    assert [named[i] for i in range(len(FEATURES))] == [f[4] for f in FEATURES]


def test_single_span_of_null_text(spark):
    rows = [(1, "a b", None), (2, None, "c"), (3, None, None), (4, None, "")]
    found = E.single_span(spark.createDataFrame(rows, "sent_id int, original string, corrected string")).collect()
    assert sorted(tuple(r) for r in found) == [(1, 0, 2, "a b", ""), (2, 0, 0, "", "c")]


def test_texts_are_split_and_trimmed_in_the_batch_function(spark):
    pairs = spark.createDataFrame([(1, " a b\tc ", "a x c"), (2, None, "new"), (3, "", None)], "sent_id long, original string, corrected string")
    rows = E.align(pairs)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "zip_with" not in plan
    got = {r.sent_id: [(e.o_start, e.o_end, e.o_str, e.c_str) for e in r.spans] for r in rows.collect()}
    assert got == {1: [(1, 2, "b", "x")], 2: [(0, 0, "", "new")], 3: []}


def test_rules_split_and_lower_each_side_once(spark):
    edits = spark.createDataFrame([("Cat dog", "dog cat")], "o_str string, c_str string")
    row = edits.select(C.category_rules(F.col("o_str"), F.col("c_str"), F.lit(True)).alias("category"))
    assert row._jdf.queryExecution().analyzed().toString().count("lower(") == 2
    assert row.first().category == "WO"
