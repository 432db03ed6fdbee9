from dataclasses import dataclass
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from redpen.operators import score as S
from redpen.plans import evaluate as V
from redpen.plans.prepare import PrepareConfig
from redpen.plans.stages import ChainConfig, run_chain
from redpen.session import scratch_root
from redpen.operators import classify as C
from redpen.operators import edits as E
from redpen.sources import corpora, files, lines, m2, sinks

M2_TEXT = """S This are gramamtical sentence .
A 1 2|||R:VERB:SVA|||is|||REQUIRED|||-NONE-|||0
A 2 2|||M:DET|||a|||REQUIRED|||-NONE-|||0

S A fine sentence .
A -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||0

S Too too many .
A 1 2|||U:ADV||||||REQUIRED|||-NONE-|||0

S No line at all .
"""


def test_m2_is_parsed(spark, tmp_path):
    (tmp_path / "a.m2").write_text(M2_TEXT)
    parsed = m2.read_m2(spark, str(tmp_path / "a.m2"))
    rows = {r.sent_id: r for r in parsed.collect()}
    assert [rows[i].sentence for i in range(4)] == [
        "This are gramamtical sentence .", "A fine sentence .", "Too too many .", "No line at all ."
    ]
    assert [len(rows[i].edits) for i in range(4)] == [2, 1, 1, 0]
    assert tuple(rows[2].edits[0]) == (1, 2, "U:ADV", "")
    edits = m2.m2_edits(parsed)
    assert edits.count() == 3 and m2.m2_edits(parsed, ignore_noop=False).count() == 4
    assert {r.category for r in edits.collect()} == {"VERB:SVA", "DET", "ADV"}


def test_m2_is_read_whatever_its_line_ends_and_blank_lines(spark, tmp_path):
    (tmp_path / "a.m2").write_text(M2_TEXT)
    plain = sorted(map(str, m2.read_m2(spark, str(tmp_path / "a.m2")).collect()))
    loose = {
        "crlf": M2_TEXT.replace("\n", "\r\n"),
        "dense": M2_TEXT.replace("\n\n", "\n"),
        "wide": "A 0 1|||R:X|||lost|||REQUIRED|||-NONE-|||0\n\n" + M2_TEXT.replace("\n\n", "\n\n\n\n"),
    }
    for name, text in loose.items():
        (tmp_path / name).write_bytes(text.encode())
        assert sorted(map(str, m2.read_m2(spark, str(tmp_path / name)).collect())) == plain


def test_files_that_do_not_line_up_are_refused(spark, tmp_path):
    (tmp_path / "pairs.csv").write_text("input_text,target_text\nI has it .,I have it .\nFine .,Fine .\n")
    (tmp_path / "gold").write_text("S I has it .\nA 1 2|||R:SPELL|||have|||REQUIRED|||-NONE-|||0\n\nS Fine .\n" + m2.NOOP_LINE)
    (tmp_path / "good").write_text("I have it .\nFine .\n")
    (tmp_path / "short").write_text("I have it .\n")
    path = lambda name: str(tmp_path / name)
    score = lambda name, **kw: V.evaluate_files(spark, path("pairs.csv"), path(name), path("gold"), **kw).first()
    assert (score("good").tp, score("good").fp, score("good").fn) == (1, 0, 1)
    assert (score("good", ignore_noop=True).tp, score("good", ignore_noop=True).fn) == (1, 0)
    with pytest.raises(Exception, match="line up"):
        score("short")


def test_line_numbers_follow_file_order_over_many_splits(spark, tmp_path):
    texts = [f"line {i} " + "x" * (i % 37) for i in range(5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "sent_id LONG, t STRING").repartition(7)
    path = str(tmp_path / "lines")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_lines(df, path, "t")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(Path(path).glob("part-*"))) > 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = lines.read_lines(spark, path).orderBy("sent_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.sent_id, r.text) for r in got] == [(i, t.strip()) for i, t in enumerate(texts)]


def test_line_breaks_do_not_shift_parallel_files(spark, tmp_path):
    df = spark.createDataFrame(
        [(0, "a\nb", "c"), (1, "d", "e\r\nf"), (2, "", "g")], "sent_id LONG, original STRING, corrected STRING"
    )
    left, right = str(tmp_path / "l"), str(tmp_path / "r")
    sinks.write_parallel_text(df, left, right)
    both = S.zip_on_id(lines.read_lines(spark, left, "o"), lines.read_lines(spark, right, "c"))
    assert {tuple(r) for r in both.collect()} == {(0, "a b", "c"), (1, "d", "e f"), (2, "", "g")}


def test_csv_keeps_awkward_text(spark, tmp_path):
    rows = [('say "hi", ok', " edges "), ("two\nlines", "NA"), ("", "x"), ("back\\slash", "tab\t"), ("😀", "'")]
    df = spark.createDataFrame(rows, "input_text STRING, target_text STRING")
    sinks.write_pair_csv(df, str(tmp_path / "pairs"))
    assert {tuple(r) for r in files.read_pair_csv(spark, str(tmp_path / "pairs")).collect()} == set(rows)


def test_first_rows_read_the_first_files_only(spark, tmp_path):
    path = tmp_path / "c4"
    rows = spark.range(10_000).selectExpr("concat('in ', id) AS input", "concat('out ', id) AS output")
    rows.repartitionByRange(10, F.length("input"), "input").write.parquet(str(path))
    parts = sorted(path.glob("part-*.parquet"))
    sizes = [spark.read.parquet(str(f)).count() for f in parts]
    whole = {r.sent_id: r.input_text for r in corpora.C4_200M.load(spark, str(path)).collect()}
    for part in parts[3:]:  # nobody may open these
        part.write_bytes(b"broken")
        (path / f".{part.name}.crc").unlink(missing_ok=True)
    for n in (1, sizes[0], sizes[0] + 5, sizes[0] + sizes[1] + 1):
        got = {r.sent_id: r.input_text for r in corpora.C4_200M.load(spark, str(path), take_n=n).collect()}
        assert got == {k: v for k, v in whole.items() if k < n} and len(got) == n
    scan, read = spark.read.schema("input string, output string").parquet(str(path)), lambda f: spark.read.parquet(*f)
    assert len(lines.first_files(scan, sizes[0], read)) == 1 and len(lines.first_files(scan, sizes[0] + 1, read)) == 2


def test_first_rows_of_few_files(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.createDataFrame([(f"l{i}",) for i in range(7)], "value string").coalesce(1).write.text(path)
    scan, read = spark.read.text(path), spark.read.text
    assert lines.first_files(scan, 3, read) is None and lines.first_files(scan, 100, read) is None
    for n in (0, 3, 100):
        assert {r.value for r in lines.first_rows(scan, n, read).collect()} == {f"l{i}" for i in range(min(n, 7))}


def test_sources_without_a_key_are_numbered(spark, tmp_path):
    path = corpora.merlin_path(str(tmp_path), "german")
    df = spark.createDataFrame([("a", "b"), ("same", "same"), ("c", "d")], "original STRING, corrected STRING")
    df.coalesce(1).write.json(path)
    got = corpora.MERLIN.load(spark, path, "json")
    assert {(r.sent_id, r.original) for r in got.collect()} == {(0, "a"), (2, "c")}
    df.write.option("header", True).csv(str(tmp_path / "csv"))
    assert corpora.PIE.load(spark, str(tmp_path / "csv"), "csv", take_n=2).count() == 2


@dataclass
class Model:
    name: str = "t5"
    batch_size: int = 16


@dataclass
class Data:
    out: Path = Path("x.txt")
    batch_size: int = 8


def test_config_and_run_tables(spark, tmp_path):
    flat = files.flatten_config(Model(), Data())
    assert flat == {"name": "t5", "batch_size": "8", "out": str(Path("x.txt").resolve())}
    sinks.write_config(spark, str(tmp_path / "args"), Model(), Data())
    assert spark.read.schema("config MAP<STRING, STRING>").json(str(tmp_path / "args")).first().config == flat
    (tmp_path / "results.json").write_text('{"overall": {"tp": 1}}')
    (tmp_path / "preds.txt").write_text("a \nb\n")
    for run in ("one", "two"):
        sinks.log_run(spark, str(tmp_path / "log"), run, flat, str(tmp_path / "results.json"), str(tmp_path / "preds.txt"))
    runs = {r.run_id: r for r in spark.read.parquet(str(tmp_path / "log/runs")).collect()}
    assert set(runs) == {"one", "two"} and runs["one"].results == '{"overall":{"tp":1}}'
    texts = spark.read.parquet(str(tmp_path / "log/run_predictions")).where("run_id = 'one'").collect()
    assert sorted((r.sent_id, r.text) for r in texts) == [(0, "a"), (1, "b")]


def test_files_compare_like_tables(spark, tmp_path):
    texts = [("I has a teh dog .", "I have a the dog .", "I have a teh dog ."), ("fine .", "fine .", "fine , .")] * 20
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "sent_id LONG, original STRING, corrected STRING, prediction STRING")
    path = lambda name: str(tmp_path / name)
    for column in ("original", "corrected", "prediction"):
        sinks.write_lines(df, path(column), column)
    V.parallel_to_m2(spark, path("original"), path("corrected"), path("gold"))
    V.parallel_to_m2(spark, path("original"), path("prediction"), path("hyp"))
    report = {r.category: (r.tp, r.fp, r.fn) for r in V.compare_m2(spark, path("hyp"), path("gold"), path("json")).collect()}
    assert report[None] == (20, 20, 20) and report["PUNCT"] == (0, 20, 0)
    document = files.read_json_document(spark, path("json")).first()
    assert document.overall["f0.5"] == 0.5 and document.cats["PUNCT"].fp == 20


def test_split_files_and_evaluation_files(spark, tmp_path):
    df = corpora.C4_200M.pairs(
        spark.range(6).select(F.col("id").alias("sent_id"), F.lit("a.").alias("input"), F.lit("b.").alias("output"))
    )
    sinks.write_splits({"train": df, "test": df}, str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["test-input.txt", "test-target.txt", "test.csv", "train.csv"]
    assert lines.read_lines(spark, str(tmp_path / "test-input.txt")).first().text == "a ."
    sinks.write_evaluation(df.withColumn("prediction", F.lit("p")), str(tmp_path), "run-1")
    assert lines.read_lines(spark, str(tmp_path / "run-1/targets")).count() == 6


def test_chain_learns_the_planted_error(spark, tmp_path):
    text = F.concat(F.lit("so teh "), F.col("id").cast("string"))
    raw = spark.range(300).select(
        F.col("id").alias("sent_id"), text.alias("input"), F.replace(text, F.lit("teh"), F.lit("the")).alias("output")
    )
    pairs = corpora.C4_200M.pairs(raw)
    config = ChainConfig(prepare=PrepareConfig(n_eval=50))
    report = run_chain(spark, str(tmp_path), pairs, pairs, config=config)
    assert {(r.category, r.tp, r.fp, r.fn) for r in report.collect()} == {("SPELL", 300, 0, 0), (None, 300, 0, 0)}


def test_cluster_sessions_need_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        scratch_root(Session())


def test_m2_straight_from_pairs_equals_the_grouped_one(spark, tmp_path):
    rows = [(1, "a teh b", "a the b"), (2, "same", "same"), (3, "x b a y", "x a b , y"), (4, "", "new one"), (5, "old", "")]
    pairs = spark.createDataFrame(rows, "sent_id long, original string, corrected string")
    for extraction in ({}, {"merge": "rules", "cost": "likeness"}):
        edits = E.extract_edits(pairs, compare_first=False, **extraction)
        typed = edits.withColumn("type", E.m2_type(F.col("op"), C.category_rules(F.col("o_str"), F.col("c_str"))))
        grouped = sinks.m2_blocks(pairs.select("sent_id", "original"), typed)
        straight = sinks.pair_blocks(pairs, **extraction)
        assert sorted(map(tuple, straight.collect())) == sorted(map(tuple, grouped.collect()))
        plan = straight._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" not in plan
