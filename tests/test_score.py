import pytest
from pyspark.sql import functions as F

from redpen.functions import metrics
from redpen.operators import score as S
from redpen.sources.sinks import results_document

# Published counts and scores, (category, tp, fp, fn, p, r, f0.5).
PUBLISHED = [
    (None, 2404, 3193, 7085, 0.4295, 0.2533, 0.3771),
    ("OTHER", 83, 1260, 1408, 0.0618, 0.0557, 0.0605),
    ("DET", 230, 205, 804, 0.5287, 0.2224, 0.4146),
    ("PREP", 144, 155, 465, 0.4816, 0.2365, 0.3989),
    ("ADJ:FORM", 4, 0, 22, 1.0, 0.1538, 0.4762),
    ("NOUN:NUM", 205, 117, 365, 0.6366, 0.3596, 0.5517),
    ("PUNCT", 216, 173, 594, 0.5553, 0.2667, 0.4565),
    ("PRON", 35, 39, 205, 0.473, 0.1458, 0.3265),
    ("VERB:TENSE", 58, 97, 249, 0.3742, 0.1889, 0.3128),
    ("NOUN", 27, 183, 296, 0.1286, 0.0836, 0.1161),
    ("VERB:SVA", 99, 69, 87, 0.5893, 0.5323, 0.5769),
    ("VERB:FORM", 92, 89, 170, 0.5083, 0.3511, 0.4665),
    ("MORPH", 66, 72, 183, 0.4783, 0.2651, 0.412),
    ("ORTH", 312, 150, 295, 0.6753, 0.514, 0.6354),
    ("SPELL", 672, 187, 802, 0.7823, 0.4559, 0.6843),
    ("ADV", 15, 53, 208, 0.2206, 0.0673, 0.1515),
    ("ADJ", 14, 78, 114, 0.1522, 0.1094, 0.1411),
    ("VERB", 69, 176, 478, 0.2816, 0.1261, 0.2259),
    ("WO", 12, 26, 85, 0.3158, 0.1237, 0.241),
    ("NOUN:POSS", 5, 7, 33, 0.4167, 0.1316, 0.2907),
    ("CONJ", 6, 25, 142, 0.1935, 0.0405, 0.1103),
    ("CONTR", 3, 5, 22, 0.375, 0.12, 0.2632),
    ("PART", 17, 11, 41, 0.6071, 0.2931, 0.5),
    ("NOUN:INFL", 14, 10, 10, 0.5833, 0.5833, 0.5833),
    ("VERB:INFL", 6, 6, 7, 0.5, 0.4615, 0.4918),
]


def test_published_counts_give_published_scores(spark):
    counts = [(c, tp, fp, fn) for c, tp, fp, fn, *_ in PUBLISHED if c]
    flags = spark.createDataFrame(counts, "category STRING, tp LONG, fp LONG, fn LONG")
    report = S.by_category(flags)
    assert {tuple(r) for r in report.collect()} == set(PUBLISHED)
    document = results_document(report).first()
    assert document.overall["f0.5"] == 0.3771 and len(document.cats) == 24


@pytest.mark.parametrize(
    "counts,expected",
    [((0, 0, 0), (1.0, 1.0, 1.0)), ((0, 1, 1), (0.0, 0.0, 0.0)), ((0, 0, 3), (1.0, 0.0, 0.0)), ((0, 2, 0), (0.0, 1.0, 0.0))],
)
def test_edge_rules(spark, counts, expected):
    df = spark.createDataFrame([counts], "tp LONG, fp LONG, fn LONG")
    row = S.with_scores(df).first()
    assert (row.p, row.r, row.f05) == expected
    assert df.select(metrics.f_beta(F.lit(0.5), F.lit(0.25), 1.0)).first()[0] == pytest.approx(1 / 3)


def edits(spark, rows):
    df = spark.createDataFrame(rows, "sent_id LONG, o_start INT, o_end INT, type STRING, c_str STRING")
    key = F.concat_ws("|||", F.concat_ws(" ", "o_start", "o_end"), "type", "c_str")
    return df.withColumn("edit_key", key).withColumn("category", F.substring("type", 3, 99))


@pytest.fixture(scope="module")
def sides(spark):
    gold = edits(spark, [(0, 1, 2, "R:SPELL", "the"), (0, 1, 2, "R:SPELL", "the"), (0, 3, 3, "M:DET", "a"), (1, -1, -1, "noop", "-NONE-")])
    hyp = edits(spark, [(0, 1, 2, "R:OTHER", "the"), (0, 3, 3, "M:DET", "a"), (2, 0, 1, "U:ADV", "")])
    return gold, hyp


def test_strict_and_span_scoring(sides):
    counts = lambda row: (row.tp, row.fp, row.fn)
    assert counts(S.score_strict(*sides).first()) == (1, 2, 1)
    assert counts(S.score_strict(*sides, ignore_noop=False).first()) == (1, 2, 2)
    assert counts(S.score_span(*sides).first()) == (2, 1, 0)


def test_category_comes_from_gold_on_a_match(sides):
    gold, hyp = sides
    flags = S.match_edits(S.drop_noop(gold), hyp, S.SPAN_KEY, ("category",))
    got = {r.category: (r.tp, r.fp, r.fn) for r in S.by_category(flags).collect()}
    assert got == {"SPELL": (1, 0, 0), "DET": (1, 0, 0), "ADV": (0, 1, 0), None: (2, 1, 0)}


def test_per_sentence_counts_agree(spark, sides):
    gold, hyp = sides
    flags = S.match_edits(gold, hyp, S.STRICT_KEY)
    by_join = {tuple(r) for r in S.per_sentence(flags).select("sent_id", "tp", "fp", "fn").collect()}
    keys = lambda df, name: df.groupBy("sent_id").agg(F.collect_set("edit_key").alias(name))
    none = F.array().cast("array<string>")
    both = keys(gold, "gold").join(keys(hyp, "hyp"), "sent_id", "full").select(
        "sent_id", F.coalesce("gold", none).alias("gold"), F.coalesce("hyp", none).alias("hyp")
    )
    assert {tuple(r) for r in S.per_sentence_sets(both).collect()} == by_join


def test_zip_needs_matching_ids(spark):
    left = spark.range(5).withColumnRenamed("id", "sent_id")
    assert S.zip_on_id(left, left.withColumn("x", F.lit(1))).count() == 5
    for right in (left.where("sent_id <> 3"), left.unionByName(left.where("sent_id = 2")), left.selectExpr("nullif(sent_id, 1) AS sent_id")):
        for pair in ((left, right), (right, left)):
            zipped = S.zip_on_id(*pair)  # nothing runs yet
            with pytest.raises(Exception, match="do not line up"):
                zipped.count()


def test_zip_reads_each_side_once(spark, tmp_path):
    path = str(tmp_path / "side")
    spark.range(5).withColumnRenamed("id", "sent_id").write.parquet(path)
    left, right = spark.read.parquet(path), spark.read.parquet(path).withColumn("x", F.lit(1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = S.zip_on_id(left, right)._jdf.queryExecution().sparkPlan().toString()
        executed = S.zip_on_id(left, right)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("FileScan") == 2 and executed.count("Exchange hashpartitioning") == 2
