import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from redpen.operators import predict as P
from redpen.operators.skew import lookup

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def shout():
    return lambda texts: [t.upper() for t in texts]


@pytest.fixture(scope="module")
def texts(spark):
    """A third of all rows share one text."""
    text = F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t "), (F.col("id") % 50).cast("string")))
    return spark.range(3000).select(F.col("id").alias("sent_id"), text.alias("input_text"))


def test_prediction_equals_prediction_without_dedup(texts):
    tagged = P.tag(texts, shout, "Grammar", tokenize_output=False)
    assert tagged.count() == 3000
    wrong = tagged.where(F.col("prediction") != F.upper(F.concat(F.lit("Grammar: "), "input_text")))
    assert wrong.count() == 0


def test_each_text_is_predicted_once_and_models_load_per_task(spark, texts):
    calls, loads = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def predictor():
        loads.add(1)

        def predict(batch):
            calls.add(len(batch))
            assert len(batch) <= 7
            return batch

        return predict

    tagged = P.tag(texts, predictor, "Grammar", batch_size=7, predict_partitions=3)
    assert tagged.count() == tagged.count() == 3000
    assert calls.value == texts.select("input_text").distinct().count()
    assert loads.value <= 3


def test_tokenized_output_and_missing_text(spark):
    df = spark.createDataFrame([(0, "it's done."), (1, None)], "sent_id LONG, input_text STRING")
    same = lambda: lambda batch: batch
    got = {r.sent_id: r.prediction for r in P.tag(df, same, "G").collect()}
    assert got == {0: "G : it 's done .", 1: "G : "}
    plain = {r.sent_id: r.prediction for r in P.tag(df, same, "G", tokenize_output=False).collect()}
    assert plain[0] == "G: it's done."


def test_lookup_equals_plain_join_with_hot_and_missing_keys(spark, texts):
    rows = texts.withColumn("input_text", F.when(F.col("sent_id") % 11 != 0, F.col("input_text")))
    unique = texts.select("input_text").distinct().where("input_text <> 't 7'").withColumn("v", F.length("input_text"))
    counts = rows.groupBy("input_text").agg(F.count("*").alias("n"))
    joined = lookup(rows, unique, "input_text", F.col("sent_id"), counts)
    plain = rows.join(unique, "input_text", "left")
    assert joined.select(plain.columns).exceptAll(plain).count() == 0
    assert joined.count() == 3000


def test_frequent_key_is_spread(spark, texts):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = texts.groupBy("input_text").agg(F.count("*").alias("n"))
        unique = texts.select("input_text").distinct()
        joined = lookup(texts, unique, "input_text", F.col("sent_id"), counts)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in sizes) < 1000


def test_one_hot_and_many_warm_keys_are_balanced(spark):
    key = F.when(F.col("sent_id") % 10 < 3, "hot").otherwise(F.concat(F.lit("w"), F.col("sent_id") % 1000))
    rows = spark.range(40_000).withColumnRenamed("id", "sent_id").withColumn("key", key)
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup(rows, counts.select("key", F.length("key").alias("v")), "key", F.col("sent_id"), counts)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 40_000 and max(sizes) < 2.5 * 40_000 / len(sizes)


def test_lexicon(spark):
    rows = [("teh", "the")] * 3 + [("teh", "ten")] * 2 + [("very", "")] * 2 + [("", "a")] * 5 + [("rare", "x")]
    edits = spark.createDataFrame(rows, "o_str STRING, c_str STRING")
    lexicon = P.fit_lexicon(edits, 2)
    assert {tuple(r) for r in lexicon.collect()} == {("teh", "the", 3), ("very", "", 2)}


@pytest.mark.parametrize("limit", [P.BROADCAST_ROWS, 0])
def test_lexicon_prediction_is_the_same_by_broadcast_and_by_shuffle(spark, monkeypatch, limit):
    monkeypatch.setattr(P, "BROADCAST_ROWS", limit)
    lexicon = spark.createDataFrame(
        [("teh", "the", 3), ("very", "", 2), ("a lot", "much", 2)], "o_str STRING, c_str STRING, n LONG"
    )
    df = spark.createDataFrame(
        [(0, "teh very  teh dog"), (1, "nothing here"), (2, ""), (3, "very")], "sent_id LONG, original STRING"
    )
    got = {r.sent_id: r.prediction for r in P.predict_lexicon(df, lexicon).collect()}
    assert got == {0: "the the dog", 1: "nothing here", 2: "", 3: ""}


@pytest.mark.parametrize("limit", [P.BROADCAST_ROWS, 0])
def test_longest_phrase_wins_from_left_to_right(spark, monkeypatch, limit):
    monkeypatch.setattr(P, "BROADCAST_ROWS", limit)
    entries = [("a", "A"), ("a b", "AB"), ("a b c d", "ABCD"), ("b c", "BC"), ("very very", ""), ("x", "y z"), ("", "never")]
    lexicon = spark.createDataFrame(entries, "o_str STRING, c_str STRING")
    texts = ["a b c", "a b c d", "b c a", "a a b", "very very very", "x x", "q", "", None, "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "sent_id LONG, original STRING")
    got = {r.sent_id: r.prediction for r in P.predict_lexicon(df, lexicon).collect()}
    want = ["AB c", "ABCD", "BC A", "A AB", "very", "y z y z", "q", "", None, "A"]
    assert got == dict(enumerate(want))
    assert P.predict_lexicon(df, lexicon.limit(0)).where("sent_id = 1").first().prediction == "a b c d"


def test_small_lexicon_moves_no_text(spark):
    lexicon = spark.createDataFrame([("a b", "c")], "o_str STRING, c_str STRING")
    df = spark.range(9).selectExpr("id AS sent_id", "'a b' AS original")
    plan = P.predict_lexicon(df, lexicon)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
