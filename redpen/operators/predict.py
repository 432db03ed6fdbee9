"""Deduplicated prediction with a user model, and a count-based one."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redpen.functions.text import tokenize, tokens, with_task_prefix
from redpen.operators.skew import lookup
from redpen.session import materialize

#: Called once per task to load the model; the result maps a list of texts to
#: a list of predictions.
Predictor = Callable[[], Callable[[list[str]], list[str]]]

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20


def predict_texts(
    df: DataFrame,
    predictor: Predictor,
    text: str = "model_input",
    output: str = "prediction",
    batch_size: int | None = None,
) -> DataFrame:
    """Adds the prediction for ``text``; the model is loaded once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor()
        for batch in batches:
            texts = batch.column(text).to_pylist()
            size = batch_size or max(len(texts), 1)
            results = []
            for at in range(0, len(texts), size):
                results.extend(predict(texts[at : at + size]))
            yield batch.append_column(output, pa.array(results, batch.column(text).type))

    schema = T.StructType(df.schema.fields + [T.StructField(output, T.StringType())])
    return df.mapInArrow(run, schema)


def tag(
    pairs: DataFrame,
    predictor: Predictor,
    task_prefix: str,
    tokenize_output: bool = True,
    batch_size: int | None = None,
    predict_partitions: int | None = None,
) -> DataFrame:
    """Predict each distinct input once and give every row its prediction.

    The distinct step counts each text (repeats combine before the shuffle) and
    its counts tell the join back which texts need spreading. Predictions are
    written once, so no later step calls the model again.
    ``predict_partitions`` spreads the model calls over that many tasks.
    """
    rows = pairs.withColumn("model_input", with_task_prefix(F.col("input_text"), task_prefix))
    unique = rows.groupBy("model_input").agg(F.count("*").alias("n"))
    if predict_partitions:
        unique = unique.repartition(predict_partitions)
    predicted = predict_texts(unique, predictor, batch_size=batch_size)
    predicted = materialize(predicted, "predictions")
    return expand(rows, predicted.drop("n"), predicted.select("model_input", "n"), tokenize_output)


def expand(rows: DataFrame, predicted: DataFrame, counts: DataFrame, tokenize_output: bool = True) -> DataFrame:
    """Every row with the prediction of its ``model_input``; ``counts`` says how many rows each has."""
    joined = lookup(rows, predicted, "model_input", F.col("sent_id"), counts)
    if tokenize_output:
        joined = joined.withColumn("prediction", tokenize(F.col("prediction")))
    return joined


def fit_lexicon(edits: DataFrame, min_count: int = 1) -> DataFrame:
    """The most frequent correction of each replaced or dropped span.

    Two aggregations, both combined before their shuffle. Ties go to the
    correction that sorts last.
    """
    counted = (
        edits.where(F.col("o_str") != "")
        .groupBy("o_str", "c_str")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_count)
    )
    best = F.max_by(F.struct("c_str", "n"), F.struct("n", "c_str"))
    return counted.groupBy("o_str").agg(best.alias("b")).select("o_str", "b.c_str", "b.n")


def _trie(entries: Iterable[tuple[str, str]]) -> dict:
    """Nested dicts from token to token; the correction of a whole phrase is under None."""
    root: dict = {}
    for phrase, correction in entries:
        node = root
        for token in phrase.split(" "):
            node = node.setdefault(token, {})
        node[None] = correction
    return root


def _longest(words: list[str], at: int, root: dict) -> tuple[int, str] | None:
    """Length and correction of the longest phrase that starts at a token."""
    node, found = root.get(words[at]), None
    step = at + 1
    while node is not None:
        if None in node:
            found = step - at, node[None]
        if step == len(words):
            break
        node, step = node.get(words[step]), step + 1
    return found


def _rewritten(words: list[str], match: Callable[[int], tuple[int, str] | None]) -> str:
    """From left to right: the longest phrase at each token is corrected as a whole."""
    out, at = [], 0
    while at < len(words):
        found = match(at)
        out.append(found[1] if found else words[at])
        at += found[0] if found else 1
    return " ".join(filter(None, out))


def predict_lexicon(
    df: DataFrame,
    lexicon: DataFrame,
    text: str = "original",
    output: str = "prediction",
    row_id: str = "sent_id",
) -> DataFrame:
    """Replace each phrase that the lexicon corrects, the longest first, from left to right.

    A lexicon whose measured size allows it is broadcast, and texts are rewritten where they
    are read. Beyond that, phrases of the lengths that the lexicon has
    are joined by shuffle, with frequent ones spread.
    """
    entries = lexicon.where(F.col("o_str") != "").select(F.col("o_str").alias("phrase"), "c_str")
    entries = materialize(entries, "lexicon")
    size = entries.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.octet_length("phrase") + F.octet_length("c_str") + 64), F.lit(0)).alias("b"),
    ).first()
    if size["n"] <= BROADCAST_ROWS and size["b"] <= BROADCAST_BYTES:
        rows = entries.toArrow()
        pairs = df.sparkSession.sparkContext.broadcast([rows[c].to_pylist() for c in ("phrase", "c_str")])
        tries: list[dict] = []

        @F.arrow_udf("string")
        def rewrite(texts: pa.Array) -> pa.Array:
            if not tries:
                tries.append(_trie(zip(*pairs.value)))
            trie = tries[0]
            split = (t if t is None else t.split() for t in texts.to_pylist())
            made = (t if t is None else _rewritten(t, lambda at, t=t: _longest(t, at, trie)) for t in split)
            return pa.array(list(made), pa.string())

        # Marked so that no filter above runs it twice.
        return df.withColumn(output, rewrite.asNondeterministic()(F.col(text)))

    words = tokens(F.col(text))
    lengths = [r.n for r in entries.select(F.size(F.split("phrase", " ")).alias("n")).distinct().collect()]

    def of_length(toks: Column, n: int) -> Column:
        none = F.array().cast("array<int>")
        starts = F.when(F.size(toks) >= n, F.sequence(F.lit(0), F.size(toks) - n)).otherwise(none)
        phrase = lambda at: F.array_join(F.slice(toks, at + 1, F.lit(n)), " ").alias("phrase")
        return F.transform(starts, lambda at: F.struct(at.alias("pos"), F.lit(n).alias("len"), phrase(at)))

    def phrases(toks: Column) -> Column:
        return F.flatten(F.array(*[of_length(toks, n) for n in lengths]))

    tokenized = df.select(row_id, words.alias("_words"))
    placed = tokenized.select(row_id, F.inline(phrases(F.col("_words"))))
    counts = placed.groupBy("phrase").agg(F.count("*").alias("n"))
    hits = lookup(placed, entries, "phrase", F.struct(row_id, "pos"), counts).where(F.col("c_str").isNotNull())
    found = hits.groupBy(row_id).agg(F.collect_list(F.struct("pos", "len", "c_str")).alias("_hits"))

    @F.arrow_udf("string")
    def apply(texts: pa.Array, hits: pa.Array) -> pa.Array:
        made = []
        for t, own in zip(texts.to_pylist(), hits.to_pylist()):
            best: dict = {}
            for hit in own or ():
                best[hit["pos"]] = max(best.get(hit["pos"], (0, "")), (hit["len"], hit["c_str"]))
            made.append(t if t is None else _rewritten(t, best.get))
        return pa.array(made, pa.string())

    return df.join(found, row_id, "left").withColumn(output, apply(words, F.col("_hits"))).drop("_hits")
