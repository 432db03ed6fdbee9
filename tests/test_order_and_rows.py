from hashlib import md5

import pytest
from pyspark.sql import functions as F

from redpen.operators import order as O
from redpen.operators import rows as R
from redpen.plans.prepare import PrepareConfig, prepare
from redpen.sources import corpora


def ids(df):
    return {r.sent_id for r in df.select("sent_id").collect()}


def test_split_parts_are_disjoint_and_complete(spark):
    df = spark.range(500).withColumnRenamed("id", "sent_id")
    for n, gap in ((0, 0), (0, 1), (100, 0), (100, 1), (499, 1), (600, 0)):
        head, tail = (ids(x) for x in O.head_tail_split(df, n, 42, gap))
        assert not head & tail
        assert len(head) == min(n, 500) and len(tail) == max(500 - n - gap, 0)
    assert ids(O.head_tail_split(df, 100, 42)[0]) == ids(O.seeded_head(df, 100, 42))


@pytest.mark.parametrize("digits", (1, 4))
def test_boundaries_are_those_of_the_sorted_keys(spark, monkeypatch, digits):
    df = spark.range(700).withColumnRenamed("id", "sent_id")
    order = sorted(range(700), key=lambda i: md5(f"7:{i}".encode()).hexdigest())
    monkeypatch.setattr(O, "PREFIX_DIGITS", digits)
    for n in (1, 350, 699, 700, 900):
        head, tail = O.head_tail_split(df, n, 7, 1)
        assert (ids(head), ids(tail)) == (set(order[:n]), set(order[n + 1 :]))


def test_no_boundary_is_found_by_top_k(spark):
    head, tail = O.head_tail_split(spark.range(10).withColumnRenamed("id", "sent_id"), 3, 42)
    for part in (head, tail):
        assert "TakeOrdered" not in part._jdf.queryExecution().executedPlan().toString()


def test_both_boundaries_take_two_passes(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    pool = spark.range(1000).withColumnRenamed("id", "sent_id").mapInArrow(count, "sent_id long")
    head, tail = O.head_tail_split(pool, 200, 42, 1)
    assert read.value == 2000
    assert head.count() == 200 and tail.count() == 799 and read.value == 4000


def test_seeds_give_other_but_repeatable_orders(spark):
    df = spark.range(200).withColumnRenamed("id", "sent_id")
    order = lambda seed: [r.sent_id for r in O.seeded_shuffle(df.repartition(3), seed).collect()]
    assert order(1) == order(1) != order(2)
    assert sorted(order(1)) == list(range(200))


def test_split_needs_no_shuffle_of_the_large_part(spark):
    _, tail = O.head_tail_split(spark.range(10).withColumnRenamed("id", "sent_id"), 3, 42)
    plan = tail._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Exchange" not in plan and "Join" not in plan


def test_prefix_and_lookup(spark):
    df = spark.range(50).withColumnRenamed("id", "sent_id")
    assert ids(O.prefix_take(df, 3)) == {0, 1, 2}
    assert O.prefix_take(df, None) is df
    assert ids(O.rows_at(df, df.where("sent_id IN (4, 9)").union(df.where("sent_id = 4")))) == {4, 9}


def test_exploded_references_keep_unique_ids(spark):
    df = spark.createDataFrame(
        [(1, "s", ["a", "b"]), (2, "t", []), (3, "u", None)], "sent_id LONG, sentence STRING, corrections ARRAY<STRING>"
    )
    got = R.explode_references(df, "corrections", "corrected").collect()
    assert sorted((r.sent_id, r.corrected) for r in got) == [(1 << 20, "a"), ((1 << 20) + 1, "b")]


def test_corpora_clean_as_documented(spark):
    raw = spark.createDataFrame(
        [(0, " It 's x . ", "It is x .\n"), (1, "same .", " same . "), (2, "gone", " \t"), (3, "a , b", "a b")],
        "sent_id LONG, original STRING, corrected STRING",
    )
    got = {r.sent_id: r for r in corpora.MERLIN.pairs(raw).collect()}
    assert set(got) == {0, 3}
    assert got[0].input_text == "It's x." and got[0].target_text == "It is x." and got[0].original == "It 's x ."
    assert corpora.PIE.pairs(raw).count() == 4
    plain = spark.createDataFrame([(0, "It's x.", "It is x.")], "sent_id LONG, input STRING, output STRING")
    row = corpora.C4_200M.pairs(plain).first()
    assert (row.source, row.original, row.target_text) == ("c4_200m", "It 's x .", "It is x.")
    edited = spark.createDataFrame([(0, "I has\na dog", ([2], [5], ["have"]))], f"sent_id LONG, {corpora.WI.schema}")
    row = corpora.LOCNESS.pairs(edited).first()
    assert (row.source, row.input_text, row.target_text) == ("locness", "I has a dog", "I have a dog")


def test_prepare(spark):
    pool = corpora.C4_200M.pairs(
        spark.range(50).select(F.col("id").alias("sent_id"), F.lit("a").alias("input"), F.lit("b").alias("output"))
    )
    splits = prepare(pool, pool, (pool,), PrepareConfig(n_eval=10, gap=1))
    assert {k: v.count() for k, v in splits.items()} == {"train": 39 + 50, "eval": 10, "test": 50}
    assert R.stack_pairs(splits).groupBy("split").count().count() == 3
    assert set(R.training_frame(splits["train"], "Grammar:").columns) == {"prefix", "input_text", "target_text"}


def test_ids_stay_apart_over_sources(spark):
    a = spark.createDataFrame([(0, "x"), (5, "y")], "sent_id long, source string")
    union = R.concatenate(R.apart([a, a, a])).collect()
    assert len({r.sent_id for r in union}) == 6


def test_references_that_do_not_fit_fail(spark):
    df = spark.createDataFrame([(1 << 44, ["a", "b"])], "sent_id long, corrections array<string>")
    with pytest.raises(Exception, match="too large"):
        R.explode_references(df, "corrections", "corrected").collect()


def test_batches_of_several_columns(spark):
    df = spark.createDataFrame([(1, "ab", None, 0.5), (2, None, "c", 1.5), (3, "d", "ef", None)], "sent_id long, a string, `b.c` string, keep double")

    def make():
        return lambda c: {"joined": [f"{x}{y}" for x, y in zip(c["a"].to_pylist(), c["b.c"].to_pylist())], "keep": c["a"].is_null()}

    got = R.map_batches(df, make, ["a", "b.c"], "joined string, keep boolean")
    assert {tuple(r) for r in got.select("sent_id", "joined", "keep").collect()} == {(1, "abNone", False), (2, "Nonec", True), (3, "def", False)}
    assert got.columns == ["sent_id", "a", "b.c", "keep", "joined"]
    assert R.map_batches(df.limit(0), make, ["a", "b.c"], "joined string, keep boolean").count() == 0
    for wrong in ({"other": [1]}, {"x": []}):
        with pytest.raises(Exception, match="a batch must give"):
            R.map_batches(df, lambda w=wrong: lambda c: w, ["a"], "x int").select("x").collect()
