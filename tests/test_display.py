import sys

import pytest
from pyspark import cloudpickle

from redpen.operators import display as D
from redpen.streaming.check import check_stream, tag_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CASES = [
    ("I has a dog", "I have a dog", "I <c type='OTHER' edit='have'>has</c> a dog"),
    ("I see dog", "I see the dog", "I <a type='DET' edit='see the'>see</a> dog"),
    ("so very good", "so good", "so <d type='OTHER' edit=''>very</d> good"),
    ("yes I can", "yes , I can", "<a type='PUNCT' edit=','>yes</a> I can"),
    ("he go home", "he is going home", "he <c type='OTHER' edit='is going'>go</c> home"),
    ("one two three", "one four", "one <c type='OTHER' edit='four'>two three</c>"),
    ("it 's ok", "it 's not ok", "it <a type='PART' edit=''s not'>'s</a> ok"),
    ("same", "same", "same"),
    ("dogs bark", "All dogs bark", "<a type='DET' edit='All dogs'>dogs</a> bark"),
    ("dogs", "All dogs", "<a type='DET' edit='All dogs'>dogs</a>"),
    ("", "new", "<a type='OTHER' edit='new'></a>"),
]


def pairs(spark, cases):
    rows = [(i, c[0], c[1]) for i, c in enumerate(cases)]
    return spark.createDataFrame(rows, "sent_id LONG, original STRING, corrected STRING")


def test_markup(spark):
    got = {r.sent_id: r.markup for r in D.highlight(pairs(spark, CASES)).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[2] for c in CASES]


def test_compat_markup(spark):
    expected = [c[2] for c in CASES[:8]] + ["dogs <a type='DET' edit='bark All'>bark</a>", None, None]
    got = {r.sent_id: r.markup for r in D.highlight(pairs(spark, CASES), compat=True).collect()}
    assert [got[i] for i in range(len(CASES))] == expected


def test_segments_from_edits_and_from_markup_agree(spark):
    df = pairs(spark, CASES)
    direct = {tuple(r) for r in D.segments(df).collect()}
    parsed = {tuple(r) for r in D.segments_of_markup(D.highlight(df)).collect()}
    assert direct == parsed
    second = sorted(s[1:] for s in direct if s[0] == 2)
    strike = "".join(ch + "̶" for ch in "very")
    assert second == [(0, "so ", None, None), (1, strike, "OTHER", "#faa"), (2, " good", None, None)]


def fix():
    return lambda texts: [t.replace("teh", "the") for t in texts]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(0, "see teh dog."), (1, "fine."), (2, "teh end")]
    return spark.createDataFrame(rows, "sent_id LONG, input_text STRING")


def test_check(texts):
    got = {r.sent_id: r for r in D.check(texts, fix).collect()}
    assert got[0].output_text == "see the dog."
    assert got[0].markup == "see <c type='OTHER' edit='the'>teh</c> dog ."
    assert got[1].markup == "fine ."


def test_check_stream_equals_batch_and_resumes(spark, texts, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    texts.write.parquet(source)

    def run():
        stream = spark.readStream.schema(texts.schema).parquet(source)
        check_stream(stream, fix, out, progress).awaitTermination()
        return spark.read.parquet(out)

    assert {tuple(r) for r in run().collect()} == {tuple(r) for r in D.check(texts, fix).collect()}
    texts.where("sent_id = 0").selectExpr("sent_id + 10 AS sent_id", "input_text").write.mode("append").parquet(source)
    assert run().count() == 4


def test_tag_stream_predicts_per_batch(spark, texts, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    texts.unionByName(texts.selectExpr("sent_id + 10 AS sent_id", "input_text")).write.parquet(source)
    stream = spark.readStream.schema(texts.schema).parquet(source)
    tag_stream(stream, fix, "G", out, progress).awaitTermination()
    got = {r.sent_id: r.prediction for r in spark.read.parquet(out).collect()}
    assert got == {0: "G : see the dog .", 10: "G : see the dog .", 1: "G : fine .", 11: "G : fine .", 2: "G : the end", 12: "G : the end"}


def test_tag_stream_predicts_a_text_once_per_stream(spark, texts, tmp_path):
    source, out, progress, once = (str(tmp_path / n) for n in ("in", "out", "progress", "once"))
    asked = spark.sparkContext.accumulator(0)

    def counting():
        model = fix()

        def predict(batch):
            asked.add(len(batch))
            return model(batch)

        return predict

    def run():
        stream = spark.readStream.schema(texts.schema).parquet(source)
        tag_stream(stream, counting, "G", out, progress, predictions=once).awaitTermination()
        return {r.sent_id: r.prediction for r in spark.read.parquet(out).collect()}

    texts.unionByName(texts.selectExpr("sent_id + 10 AS sent_id", "input_text")).write.parquet(source)
    first = run()
    assert asked.value == 3 and len(first) == 6
    again = texts.selectExpr("sent_id + 20 AS sent_id", "input_text")
    again.unionByName(texts.limit(1).selectExpr("99L AS sent_id", "'teh new' AS input_text")).write.mode("append").parquet(source)
    second = run()
    assert asked.value == 4
    assert {k - 20: v for k, v in second.items() if 20 <= k < 30} == {k: v for k, v in first.items() if k < 10}
    assert second[99] == "G : the new" and len(second) == 10
