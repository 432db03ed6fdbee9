"""Registered queries: name to function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries import fixtures as X
from redpen.functions import metrics, text as T
from redpen.functions.charedits import apply_char_edits as char_edit
from redpen.operators import classify as C
from redpen.operators import display as D
from redpen.operators import edits as E
from redpen.operators import order as O
from redpen.operators import predict as P
from redpen.operators import rows as R
from redpen.operators import score as S
from redpen.operators.packed import ordered
from redpen.plans import evaluate as V
from redpen.plans.prepare import PrepareConfig, prepare
from redpen.plans.stages import ChainConfig, run_chain
from redpen.session import materialize, scratch_path
from redpen.sources import corpora, files, lines, m2, sinks
from redpen.streaming.check import check_stream as stream_check
from redpen.streaming.check import tag_stream as stream_tag

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

SEED = 42
N_EVAL = 200
VOCABULARY_MIN = 2
FAMILY_STEMS = 2
PREFIX = "Grammar:"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------- inputs


def token_pairs(spark: SparkSession, sf: str, corrected: str = "target_text") -> DataFrame:
    return X.pairs(spark, sf).select(
        "sent_id",
        T.tokenize(F.col("input_text")).alias("original"),
        T.tokenize(F.col(corrected)).alias("corrected"),
    )


def token_triples(spark: SparkSession, sf: str) -> DataFrame:
    return X.pairs(spark, sf).select(
        "sent_id",
        T.tokenize(F.col("input_text")).alias("original"),
        T.tokenize(F.col("target_text")).alias("corrected"),
        T.tokenize(F.col("hyp_text")).alias("prediction"),
    )


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    texts = X.pairs(spark, sf).select(T.tokenize(F.col("target_text")).alias("corrected"))
    return C.build_vocabulary(texts, min_count=VOCABULARY_MIN)


def raw_tokenized(spark: SparkSession, sf: str) -> DataFrame:
    """Padded tokenized pairs, some identical, some with a blank correction."""
    line = F.col("target_text")
    blank = F.contains(line, F.lit(" on "))
    return X.pairs(spark, sf).select(
        "sent_id",
        F.concat(F.lit(X.LEFT_PAD), T.tokenize(F.col("input_text"))).alias("original"),
        F.when(blank, X.RIGHT_PAD)
        .otherwise(F.concat(T.tokenize(line), F.lit(X.RIGHT_PAD)))
        .alias("corrected"),
    )


def raw_plain(spark: SparkSession, sf: str) -> DataFrame:
    return X.pairs(spark, sf).select(
        "sent_id", F.col("input_text").alias("input"), F.col("target_text").alias("output")
    )


def repair_model() -> Callable[[list[str]], list[str]]:
    """Stands in for a neural model: undoes two of the planted corruptions."""
    lead = len(T.clean_task_prefix(PREFIX)) + 2

    def predict(texts: list[str]) -> list[str]:
        return [t[lead:].replace(" teh ", " the ").replace(" very ", " ") for t in texts]

    return predict


def plain_repair_model() -> Callable[[list[str]], list[str]]:
    def predict(texts: list[str]) -> list[str]:
        return [t.replace(" teh ", " the ").replace(" very ", " ") for t in texts]

    return predict


# ---------------------------------------------------------------- text functions


@query
def tokenize(spark, sf):
    return X.clitics(spark, sf).select("sent_id", T.tokenize(F.col("text")).alias("tokenized"))


@query
def detokenize(spark, sf):
    return X.clitics(spark, sf).select(
        "sent_id", T.detokenize(T.tokenize(F.col("text"))).alias("detokenized")
    )


@query
def normalize_ws(spark, sf):
    return X.padded(spark, sf).select("doc_id", T.normalize_ws(F.col("text")).alias("clean"))


@query
def strip(spark, sf):
    return X.padded(spark, sf).select("doc_id", T.strip(F.col("text")).alias("stripped"))


@query
def split_tokens(spark, sf):
    tokens = T.tokens(F.col("text"))
    return X.padded(spark, sf).select(
        "doc_id", F.size(tokens).alias("n_tokens"), F.array_join(tokens, "_").alias("joined")
    )


@query
def literal_replace(spark, sf):
    docs = X.table(spark, sf, "documents")
    return docs.select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("one_line"))


@query
def strikeout(spark, sf):
    return X.table(spark, sf, "conversations").select(
        "conv_id", "turn", T.strikeout(F.col("text")).alias("struck")
    )


@query
def task_prefix(spark, sf):
    return X.pairs(spark, sf).select(
        "sent_id", T.with_task_prefix(F.col("input_text"), PREFIX).alias("model_input")
    )


@query
def training_frame(spark, sf):
    return R.training_frame(X.pairs(spark, sf), PREFIX)


@query
def edit_key_fields(spark, sf):
    """Edit keys built, cut to their first fields and parsed again."""
    lines_ = X.lines(spark, sf)
    key = T.edit_key(F.length("line"), F.length("line") + 1, F.concat(F.lit("R:"), "source"), F.col("line"))
    keyed = lines_.select("sent_id", F.concat(key, F.lit("|||REQUIRED|||-NONE-|||0")).alias("line"))
    cut = keyed.select("sent_id", T.first_fields(F.col("line"), 3).alias("edit_key"))
    parsed = cut.select("sent_id", "edit_key", E.parse_edit_key(F.col("edit_key")).alias("e"))
    return parsed.select(
        "sent_id", "edit_key", "e.o_start", "e.o_end", T.strip_operation(F.col("e.type")).alias("category"), "e.c_str"
    )


# ---------------------------------------------------------------- rows and corpora


@query
def explode_refs(spark, sf):
    rows = R.explode_references(X.multi_refs(spark, sf), "corrections", "corrected")
    return rows.withColumnRenamed("sentence", "original").select("sent_id", "original", "corrected")


@query
def clean_pairs(spark, sf):
    rows = raw_tokenized(spark, sf).withColumns(
        {c: T.strip(F.col(c)) for c in ("original", "corrected")}
    )
    return R.drop_identical(R.drop_empty(rows))


@query
def merlin_like(spark, sf):
    return corpora.MERLIN.pairs(raw_tokenized(spark, sf))


@query
def pie_like(spark, sf):
    return corpora.PIE.pairs(raw_tokenized(spark, sf))


@query
def c4_like(spark, sf):
    return corpora.C4_200M.pairs(raw_plain(spark, sf))


@query
def jfleg_like(spark, sf):
    return corpora.JFLEG.pairs(X.multi_refs(spark, sf))


@query
def wi_like(spark, sf):
    return corpora.WI.pairs(X.char_edits(spark, sf))


@query
def locness_like(spark, sf):
    return corpora.LOCNESS.pairs(X.char_edits(spark, sf))


@query
def batch_columns(spark, sf):
    """Two columns in, two out, by a function over whole Arrow batches."""

    def make():
        import pyarrow.compute as pc

        def compare(columns):
            left, right = columns["input_text"], columns["target_text"]
            gap = pc.subtract(pc.utf8_length(right), pc.utf8_length(left))
            return {"gap": gap, "longer": pc.if_else(pc.greater(gap, 0), right, left)}

        return compare

    rows = X.pairs(spark, sf).select("sent_id", "input_text", "target_text")
    return R.map_batches(rows, make, ["input_text", "target_text"], "gap INT, longer STRING").select("sent_id", "gap", "longer")


@query
def apply_char_edits(spark, sf):
    rows = X.char_edits(spark, sf)
    return rows.select("sent_id", char_edit(F.col("text"), F.col("edits")).alias("corrected"))


@query
def canonical_union(spark, sf):
    parts = {
        "train": R.concatenate([jfleg_like(spark, sf), c4_like(spark, sf)]),
        "test": merlin_like(spark, sf),
    }
    return R.stack_pairs(parts)


# ---------------------------------------------------------------- order


@query
def seeded_shuffle_topn(spark, sf):
    return O.seeded_head(c4_like(spark, sf), N_EVAL, SEED).select("sent_id", "input_text", "target_text")


@query
def seeded_sample(spark, sf):
    ids = O.seeded_sample(X.lines(spark, sf).select("sent_id"), 10, SEED)
    return O.rows_at(X.lines(spark, sf), ids).select("sent_id", "line")


@query
def prefix_take(spark, sf):
    return O.prefix_take(raw_plain(spark, sf), 2000)


@query
def prepare_train(spark, sf):
    return _prepared(spark, sf)["train"]


@query
def prepare_eval(spark, sf):
    return _prepared(spark, sf)["eval"]


@query
def prepare_test(spark, sf):
    return _prepared(spark, sf)["test"]


def _prepared(spark, sf):
    config = PrepareConfig(seed=SEED, n_eval=N_EVAL, gap=1)
    return prepare(jfleg_like(spark, sf), merlin_like(spark, sf), (c4_like(spark, sf),), config)


# ---------------------------------------------------------------- edits


@query
def token_distance(spark, sf):
    return E.token_distance(token_pairs(spark, sf))


def _edits(spark, sf, merge):
    return E.extract_edits(token_pairs(spark, sf), merge=merge, compare_first=False)


@query
def extract_edits(spark, sf):
    return _edits(spark, sf, "all-merge")


@query
def extract_edits_split(spark, sf):
    return _edits(spark, sf, "all-split")


@query
def extract_edits_equal(spark, sf):
    return _edits(spark, sf, "all-equal")


@query
def extract_edits_likeness(spark, sf):
    """Every operation by itself: alike words replace each other, moved blocks are one."""
    return E.extract_edits(X.phrases(spark, sf), merge="all-split", cost="likeness", compare_first=False)


@query
def extract_edits_rules(spark, sf):
    """Operations joined by rules."""
    return E.extract_edits(X.phrases(spark, sf), merge="rules", cost="likeness", compare_first=False)


@query
def edit_ops_count(spark, sf):
    return _edits(spark, sf, "all-merge").groupBy("op").agg(F.count("*").alias("n"))


@query
def edits_roundtrip(spark, sf):
    """The hypothesis rebuilt from the original and its edits."""
    rows = E.with_edits(token_pairs(spark, sf, "hyp_text"))
    return rows.select("sent_id", E.apply_edits(F.col("original"), F.col("edits")).alias("rebuilt"))


@query
def single_span_edit(spark, sf):
    return E.single_span(token_pairs(spark, sf))


@query
def collect_edits(spark, sf):
    rows = E.collect_edits(extract_edits(spark, sf))
    shown = lambda e: F.concat_ws("|", e["o_start"], e["o_end"], e["c_str"])
    return rows.select("sent_id", F.array_join(F.transform("edits", shown), " ; ").alias("edits"))


@query
def build_vocabulary(spark, sf):
    return vocabulary(spark, sf)


@query
def classify_edits(spark, sf):
    return C.classify(extract_edits(spark, sf), vocabulary(spark, sf)).select(
        "sent_id", "edit_no", "type", "category", "o_str", "c_str"
    )


@query
def classify_edits_features(spark, sf):
    """Features lie beside the texts as one array for each side."""
    rows = X.inflected(spark, sf).select(
        "sent_id",
        T.tokenize(F.col("input_text")).alias("original"),
        T.tokenize(F.col("target_text")).alias("corrected"),
    )
    words = C.build_vocabulary(rows, "corrected", VOCABULARY_MIN)
    sides = {"o_feats": "original", "c_feats": "corrected"}
    featured = rows.withColumns({f: X.feature_array(F.col(c)) for f, c in sides.items()})
    return C.classify_pairs(featured, words, ("o_feats", "c_feats")).select("sent_id", "o_start", "type", "o_str", "c_str")


def _planted(spark, sf):
    rows = X.planted(spark, sf)
    return rows, C.build_vocabulary(rows, "corrected", VOCABULARY_MIN)


@query
def classify_edits_families(spark, sf):
    """All categories, by word families mined from the corrected texts."""
    rows, words = _planted(spark, sf)
    edits = E.extract_edits(rows, merge="rules", cost="likeness")
    typed = C.classify_by_families(edits, words, min_stems=FAMILY_STEMS)
    return typed.select("sent_id", "category", "op", "o_str", "c_str")


@query
def score_by_families(spark, sf):
    """The category report of predictions, with a row for every category."""
    rows, words = _planted(spark, sf)
    return V.score_triples(rows, words, families=FAMILY_STEMS, merge="rules", cost="likeness")


@query
def show_edits(spark, sf):
    edits = extract_edits(spark, sf)
    category = C.category_rules(F.col("o_str"), F.col("c_str"))
    return D.show_edits(edits.withColumn("category", category))


# ---------------------------------------------------------------- scoring


def _typed_sides(spark, sf):
    """Gold and hypothesis edits with type and key (string and closed-class rules)."""
    sides = V.both_sides(token_triples(spark, sf), "original", "corrected", "prediction")
    category = C.category_rules(F.col("o_str"), F.col("c_str"))
    typed = sides.withColumn("type", E.m2_type(F.col("op"), category))
    return E.with_edit_key(typed)


@query
def score_strict(spark, sf):
    return S.score(S.flag_edits(_typed_sides(spark, sf), S.STRICT_KEY))


@query
def score_span(spark, sf):
    return S.score(V.flags_of_triples(token_triples(spark, sf), "original", "corrected", "prediction"))


@query
def score_by_category(spark, sf):
    return V.score_triples(token_triples(spark, sf), vocabulary(spark, sf))


@query
def match_flags(spark, sf):
    return V.flags_of_triples(token_triples(spark, sf), "original", "corrected", "prediction")


@query
def sentence_counts(spark, sf):
    return S.per_sentence(match_flags(spark, sf))


@query
def sentence_set_counts(spark, sf):
    """The same counts by array set operations on edits collected per sentence."""
    keyed = _typed_sides(spark, sf)
    side = lambda wanted: F.array_distinct(F.collect_list(F.when(F.col("_gold") == wanted, F.col("edit_key"))))
    sets = keyed.groupBy("sent_id").agg(side(True).alias("gold"), side(False).alias("hyp"))
    return S.per_sentence_sets(sets)


@query
def evaluate_metrics(spark, sf):
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = metrics.precision(tp, fp), metrics.recall(tp, fn)
    chosen = {
        "p": lambda counts: p,
        "r": lambda counts: r,
        "f05": lambda counts: metrics.f_beta(p, r),
        "f1": lambda counts: metrics.f_beta(p, r, 1.0),
    }
    return S.evaluate(match_flags(spark, sf), chosen)


@query
def zip_on_id(spark, sf):
    gold = X.pairs(spark, sf).select("sent_id", "target_text")
    return S.zip_on_id(gold, X.pairs(spark, sf).select("sent_id", "hyp_text"))


@query
def row_counts(spark, sf):
    frames = {"lines": X.lines(spark, sf), "documents": X.table(spark, sf, "documents")}
    return R.concatenate(
        [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in frames.items()]
    )


# ---------------------------------------------------------------- prediction and display


@query
def predict_unique(spark, sf):
    pairs = X.pairs(spark, sf).select("sent_id", "input_text")
    return P.tag(pairs, repair_model, PREFIX).select("sent_id", "prediction")


@query
def unique_inputs(spark, sf):
    return X.pairs(spark, sf).select("input_text").distinct()


@query
def fit_lexicon(spark, sf):
    return P.fit_lexicon(extract_edits_split(spark, sf), 2)


@query
def predict_lexicon(spark, sf):
    rows = X.pairs(spark, sf).select("sent_id", T.tokenize(F.col("hyp_text")).alias("original"))
    return P.predict_lexicon(rows, fit_lexicon(spark, sf)).select("sent_id", "prediction")


@query
def predict_phrases(spark, sf):
    """Corrections of several words, learnt from edits joined by rules."""
    rows = X.planted(spark, sf)
    edits = E.extract_edits(rows, merge="rules", cost="likeness")
    lexicon = P.fit_lexicon(edits, 2).where(F.col("o_str").isin("cat dog", "teh", "doges"))
    return P.predict_lexicon(rows.select("sent_id", "original"), lexicon).select("sent_id", "prediction")


@query
def highlight(spark, sf):
    return D.highlight(token_pairs(spark, sf))


@query
def highlight_compat(spark, sf):
    return D.highlight(token_pairs(spark, sf), compat=True)


@query
def highlight_segments(spark, sf):
    return D.segments(token_pairs(spark, sf))


@query
def markup_segments(spark, sf):
    return D.segments_of_markup(highlight(spark, sf))


@query
def check(spark, sf):
    return D.check(X.pairs(spark, sf), plain_repair_model)


@query
def check_stream(spark, sf):
    """The same over a stream that reads the documents' file until its end."""
    stream = X.stream(spark, sf, "documents")
    texts = stream.select(F.col("doc_id").alias("sent_id"), X.replace_all(F.col("text"), X.MISSPELLED).alias("input_text"))
    out = scratch_path(spark, "checked")
    stream_check(texts, plain_repair_model, out, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(out).select("sent_id", "output_text", "markup")


@query
def tag_stream(spark, sf):
    """Deduplicated prediction per micro-batch."""
    stream = X.stream(spark, sf, "conversations")
    texts = stream.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("sent_id"),
        X.replace_all(F.col("text"), X.MISSPELLED).alias("input_text"),
    )
    out, once = scratch_path(spark, "tagged"), scratch_path(spark, "predicted")
    stream_tag(texts, repair_model, PREFIX, out, scratch_path(spark, "progress"), predictions=once).awaitTermination()
    return spark.read.parquet(out).select("sent_id", "prediction")


# ---------------------------------------------------------------- files


@query
def csv_roundtrip(spark, sf):
    quote = F.concat(F.lit(' "a, b" '), F.col("text"), F.lit('\\ "'))
    docs = X.padded(spark, sf).select(
        F.col("doc_id").alias("sent_id"), quote.alias("input_text"), F.lit("").alias("target_text")
    )
    path = scratch_path(spark, "csv")
    sinks.write_pair_csv(docs, path, keep_id=True)
    return files.read_pair_csv(spark, path, f"sent_id BIGINT, {files.PAIR_CSV}")


@query
def text_roundtrip(spark, sf):
    """Two line-aligned files, read back and zipped by line number."""
    pairs = merlin_like(spark, sf)
    left, right = scratch_path(spark, "input"), scratch_path(spark, "target")
    sinks.write_parallel_text(pairs, left, right)
    return S.zip_on_id(lines.read_lines(spark, left, "original"), lines.read_lines(spark, right, "corrected"))


@query
def predictions_file(spark, sf):
    tagged = X.pairs(spark, sf).select("sent_id", F.col("hyp_text").alias("prediction"))
    path = scratch_path(spark, "predictions")
    sinks.write_predictions(tagged, path)
    return lines.read_lines(spark, path)


@query
def evaluation_files(spark, sf):
    """Targets and predictions of one evaluation, written side by side and zipped again."""
    root = scratch_path(spark, "evaluation")
    sinks.write_evaluation(X.pairs(spark, sf).withColumnRenamed("hyp_text", "prediction"), root, "run-1")
    sides = [lines.read_lines(spark, f"{root}/run-1/{name}", name) for name in ("targets", "predictions")]
    return S.zip_on_id(*sides)


@query
def split_files(spark, sf):
    """Both parts as CSV, the test part as aligned text files too; all read back."""
    root = scratch_path(spark, "splits")
    sinks.write_splits({"train": c4_like(spark, sf), "test": merlin_like(spark, sf)}, root)
    csv = [files.read_pair_csv(spark, f"{root}/{name}.csv").select(F.lit(name).alias("part"), "*") for name in ("train", "test")]
    sides = [lines.read_lines(spark, f"{root}/test-{side}.txt", f"{side}_text") for side in ("input", "target")]
    text = S.zip_on_id(*sides).select(F.lit("text").alias("part"), "input_text", "target_text")
    return csv[0].unionByName(csv[1]).unionByName(text)


@query
def json_lines_source(spark, sf):
    root = scratch_path(spark, "merlin")
    path = corpora.merlin_path(root, "german")
    raw_tokenized(spark, sf).orderBy("sent_id").select("original", "corrected").write.json(path)
    return corpora.MERLIN.load(spark, path, "json")


@query
def partitioned_split(spark, sf):
    path = scratch_path(spark, "splits")
    canonical_union(spark, sf).write.partitionBy("split").parquet(path)
    return files.read_split(files.read_table(spark, path, "parquet"), "test")


def _typed_pairs(pairs):
    edits = E.extract_edits(pairs, compare_first=False)
    category = C.category_rules(F.col("o_str"), F.col("c_str"))
    return edits.withColumn("type", E.m2_type(F.col("op"), category))


@query
def m2_roundtrip(spark, sf):
    """Edits written as M2 blocks and parsed again, one row per edit or noop."""
    path = scratch_path(spark, "m2")
    sinks.write_pairs_m2(token_pairs(spark, sf), path)
    return m2.m2_edits(m2.read_m2(spark, path), ignore_noop=False)


@query
def m2_sentences(spark, sf):
    """Every sentence read back, with the number of its edit lines (a noop counts)."""
    path = scratch_path(spark, "m2")
    pairs = token_pairs(spark, sf)
    sinks.write_m2(pairs.select("sent_id", "original"), _typed_pairs(pairs), path)
    return m2.read_m2(spark, path).select("sent_id", "sentence", F.size("edits").alias("n_edits"))


@query
def m2_line_ends(spark, sf):
    """M2 with CRLF, without blank lines and with repeated ones reads as the plain file does."""
    pairs = token_pairs(spark, sf)
    blocks = sinks.m2_blocks(pairs.select("sent_id", "original"), _typed_pairs(pairs))
    text = F.regexp_replace("block", "\n$", "")
    kind = F.pmod(F.col("sent_id"), F.lit(3))
    text = F.when(kind == 0, F.regexp_replace(text, "\n", "\r\n")).when(kind == 1, text).otherwise(
        F.concat(F.lit("\n\n"), text, F.lit("\n\n\n"))
    )
    path = scratch_path(spark, "m2-loose")
    blocks.orderBy("sent_id").select(text).write.text(path)
    return m2.m2_edits(m2.read_m2(spark, path), ignore_noop=False)


@query
def compare_files(spark, sf):
    """Parallel files to M2 for gold and hypothesis, then the category report."""
    triples = token_triples(spark, sf)
    paths = {c: scratch_path(spark, c) for c in ("gold", "hyp")}
    paths |= sinks.write_line_files(triples, scratch_path(spark, "lines"), ("original", "corrected", "prediction"), compression="gzip")
    words = materialize(C.build_vocabulary(triples, "corrected", VOCABULARY_MIN), "vocabulary")
    V.parallel_to_m2(spark, paths["original"], paths["corrected"], paths["gold"], vocabulary=words, compression="gzip")
    V.parallel_to_m2(spark, paths["original"], paths["prediction"], paths["hyp"], vocabulary=words, compression="gzip")
    return V.compare_m2(spark, paths["hyp"], paths["gold"])


def _evaluated_files(spark, sf, ignore_noop):
    """Originals as CSV, predictions as text and gold as M2, then the strict record of the files."""
    rows = X.pairs(spark, sf).select("sent_id", "input_text", "target_text", "hyp_text")
    csv, predictions, gold = (scratch_path(spark, x) for x in ("pairs", "predictions", "gold"))
    sinks.write_pair_csv(ordered(rows.drop("hyp_text"), "sent_id"), csv, compression="gzip")
    sinks.write_predictions(rows.withColumnRenamed("hyp_text", "prediction"), predictions, compression="gzip")
    tokenized = {"original": T.tokenize(F.col("input_text")), "corrected": T.tokenize(F.col("target_text"))}
    pairs = rows.select("sent_id", *[text.alias(name) for name, text in tokenized.items()])
    words = materialize(C.build_vocabulary(pairs, "corrected", VOCABULARY_MIN), "vocabulary")
    edits = C.classify(E.extract_edits(pairs), words)
    sinks.write_m2(pairs.select("sent_id", "original"), edits, gold, compression="gzip")
    return V.evaluate_files(spark, csv, predictions, gold, words, ignore_noop=ignore_noop)


@query
def evaluate_files(spark, sf):
    return _evaluated_files(spark, sf, ignore_noop=True)


@query
def evaluate_files_noop(spark, sf):
    return _evaluated_files(spark, sf, ignore_noop=False)


@query
def results_json(spark, sf):
    """The category report written as one JSON document and flattened again."""
    path = scratch_path(spark, "results")
    sinks.write_results(score_by_category(spark, sf), path)
    schema = "overall STRUCT<{0}>, cats MAP<STRING, STRUCT<{0}>>".format(
        "tp: BIGINT, fp: BIGINT, fn: BIGINT, p: DOUBLE, r: DOUBLE, `f0.5`: DOUBLE"
    )
    doc = spark.read.schema(schema).json(path)
    cats = doc.select(F.explode("cats").alias("category", "m"))
    everything = cats.unionByName(doc.select(F.lit(None).cast("string").alias("category"), F.col("overall").alias("m")))
    return everything.select("category", "m.tp", "m.fp", "m.fn", "m.p", "m.r", F.col("m")["f0.5"].alias("f05"))


@query
def run_log(spark, sf):
    """Run tables: parameters, results and predictions of one run."""
    root = scratch_path(spark, "runs")
    results, predictions = scratch_path(spark, "results"), scratch_path(spark, "predictions")
    sinks.write_results(score_by_category(spark, sf), results)
    tagged = X.pairs(spark, sf).select("sent_id", F.col("hyp_text").alias("prediction"))
    sinks.write_predictions(tagged, predictions)
    config = files.flatten_config({"model_name": "lexicon", "batch_size": 16}, {"batch_size": 8})
    sinks.log_run(spark, root, "run-1", config, results, predictions)
    counts = [F.get_json_object("results", f"$.overall.{c}").cast("long").alias(c) for c in ("tp", "fp", "fn")]
    logged = spark.read.parquet(f"{root}/runs")
    runs = logged.select("run_id", F.col("config")["batch_size"].alias("batch_size"), *counts)
    return runs.join(spark.read.parquet(f"{root}/run_predictions"), "run_id")


@query
def stage_chain(spark, sf):
    """Prepare, gold edits, fit, tag and evaluate with tables in between."""
    config = ChainConfig(min_count=VOCABULARY_MIN, prepare=PrepareConfig(SEED, N_EVAL, 1))
    pool = c4_like(spark, sf)
    return run_chain(spark, scratch_path(spark, "chain"), pool, merlin_like(spark, sf), config=config)
