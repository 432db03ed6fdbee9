"""Steps that the jobs over large tables share: computed once, by batch."""

import glob

from pyspark.sql import functions as F

from redpen.functions import text as T
from redpen.operators import alignment as A
from redpen.operators import classify as C
from redpen.operators import edits as E
from redpen.operators import predict as P
from redpen.plans import evaluate as V
from redpen.session import materialize
from redpen.sources import sinks

ODD = ["it'sn't 're 'm x", "a.b,c?d!e:f;g", "... etc. Mr. U.S.A. s' ", "'s 's ", "", None, "😀's é.", "years' n'tn't'd"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def native(text):
    return T.replace_all(text, [(joined, spaced) for spaced, joined in T.TOKEN_SPELLINGS] + list(T.TOKENIZE_REPAIRS))


def test_tokenizing_by_batch_equals_the_native_replacements(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t STRING")
    rows = df.select(T.tokenize(F.col("t")).alias("batch"), native(F.col("t")).alias("native")).collect()
    assert [r.batch for r in rows] == [r.native for r in rows]


def test_filters_on_tokenized_texts_do_not_tokenize_twice(spark):
    df = spark.createDataFrame([(1, "a.", "b.")], "sent_id LONG, i STRING, t STRING")
    pairs = df.select("sent_id", T.tokenize(F.col("i")).alias("original"), T.tokenize(F.col("t")).alias("corrected"))
    edits = E.extract_edits(pairs)
    assert plan(edits).count("_tokenized(") == 2
    assert [(r.o_str, r.c_str) for r in edits.collect()] == [("a", "b")]


def test_vocabulary_is_counted_by_batch(spark, monkeypatch):
    texts = ["The the cat ", "ΟΔΟΣ οδος İ", None, "", "cat\tTHE"]
    df = spark.createDataFrame([(t,) for t in texts], "corrected STRING")
    words = C.build_vocabulary(df, min_count=2)
    assert {r.word: r.n for r in words.collect()} == {"the": 3, "cat": 2, "οδος": 2}
    assert "MapInArrow" in words._jdf.queryExecution().executedPlan().toString()
    lowered = df.select(F.explode(T.tokens(F.lower("corrected"))).alias("w")).groupBy("w").count()
    assert {r.word: r.n for r in C.build_vocabulary(df).collect()} == {r.w: r["count"] for r in lowered.collect()}
    monkeypatch.setattr(A, "TEXT_BUDGET", 4)
    import pyarrow as pa

    found = [dict(zip(w.to_pylist(), n.to_pylist())) for w, n in A.word_counts(pa.array(["a b", "a a", None, "c" * 9]))]
    assert found == [{"a": 1, "b": 1}, {"a": 2}, {"c" * 9: 1}]


def test_no_texts_have_no_words(spark):
    assert C.build_vocabulary(spark.createDataFrame([], "corrected STRING")).count() == 0


def test_only_words_that_edits_look_up_are_joined(spark, monkeypatch):
    schema = "sent_id LONG, edit_no INT, op STRING, o_str STRING, o_start INT, o_end INT, c_str STRING"
    rows = [(1, 0, "R", "teh", 0, 1, "the"), (2, 0, "R", "Cat", 0, 1, "dog"), (3, 0, "M", "", 0, 0, "very")]
    edits = spark.createDataFrame(rows, schema)
    words = spark.createDataFrame([(w, 2) for w in ("cat", "the", "dog")], "word STRING, n LONG")
    typed = C.classify(edits, words)
    assert "BroadcastHashJoin" in typed._jdf.queryExecution().sparkPlan().toString()
    near = sorted((r.sent_id, r.type) for r in typed.collect())
    monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
    assert near == sorted((r.sent_id, r.type) for r in C.classify(edits, words).collect())
    assert near == [(1, "R:SPELL"), (2, "R:OTHER"), (3, "M:OTHER")]


def test_a_broadcast_lexicon_reads_the_text_itself(spark):
    df = spark.createDataFrame([(1, " teh  cat "), (2, None)], "sent_id LONG, original STRING")
    lexicon = spark.createDataFrame([("teh", "the")], "o_str STRING, c_str STRING")
    made = P.predict_lexicon(df, lexicon)
    assert "translate" not in plan(made)
    assert {r.sent_id: r.prediction for r in made.collect()} == {1: "the cat", 2: None}


def test_evaluation_with_a_vocabulary_stores_no_targets(spark, tmp_path):
    pairs = spark.createDataFrame([(0, "teh cat", "the cat"), (1, "a", "a")], "sent_id LONG, input_text STRING, target_text STRING")
    csv, hyp, gold = (str(tmp_path / n) for n in ("csv", "hyp", "gold"))
    sinks.write_pair_csv(pairs.orderBy("sent_id"), csv)
    sinks.write_lines(pairs, hyp, "target_text")
    tokenized = pairs.select("sent_id", F.col("input_text").alias("original"), F.col("target_text").alias("corrected"))
    words = spark.createDataFrame([("the", 1), ("cat", 1)], "word STRING, n LONG")
    sinks.write_m2(tokenized, C.classify(E.extract_edits(tokenized), words), gold)
    before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/rows-*"))
    record = V.evaluate_files(spark, csv, hyp, gold, words, ignore_noop=True).first()
    made = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/rows-*")) - before
    assert not [p for p in made if "target_text" in spark.read.parquet(p).columns]
    assert (record.tp, record.fp, record.fn) == (1, 0, 0)


def test_intermediates_are_compressed_by_zstd(spark):
    stored = materialize(spark.range(3).toDF("sent_id"))
    assert all(f.endswith(".zstd.parquet") for f in stored.inputFiles())
